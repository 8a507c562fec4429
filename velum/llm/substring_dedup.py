"""Substring dedup: words covered by a window of ``window`` words that starts in another place as well.

First pass: a count-min sketch that can only overestimate. A window is represented by the least of the hashes of the
shorter runs of words in it (its minimizer); equal windows have equal minimizers in different places, so counting the
places of minimizers bounds the count of each window from above while about a tenth of the places is counted. Each task
sketches its texts as sparse cells; the partition sketches are merged by cell ranges, and all that leaves the merge is
one bit per cell: counted twice or more.

Second pass: only windows whose minimizer may repeat are hashed, and grouped exactly by minimizer and hash (128 bits
together). Neighbouring windows with one minimizer travel as one row. A minimizer with up to ``MANY`` such rows is a group
for one task. The windows of more frequent ones are dealt out one by one, by ranges of (hash, document, place), and sorted;
a window is then repeated if and only if a neighbour in that order is equal. A range border may cut a group of equal
windows: two border rows per range, counted together, settle the windows next to it. So no passage is too frequent for one
task, and none is lost.

The bits are sent to every task; ``cells`` bounds them (2 ** 27 cells in each of 2 rows are 32 MB). With far more text than
cells the sketch lets more windows through to the second pass, which stays exact.

Defined cases: a null or empty text has no words; texts shorter than a window lose nothing; rows that repeat a doc_id or
a whole row are texts of their own, so their windows repeat; rows without doc_id take part like others; an empty table
gives an empty result; further columns are untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from velum.llm.common import text_key
from velum.sources.sinks import written

WINDOW, RUN = 35, 18
CELL_BITS = 27
#: Cells of the sketch that are merged by one group.
CHUNK_BITS = 16
#: Odd multipliers: of the two rows of the sketch, of the two polynomial hashes.
ROWS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
BASES = (0x5851F42D4C957F2D, 0x2545F4914F6CDD1D)
#: Blocks of windows up to which a minimizer is a group for one task.
MANY = 1000
#: Minimizers gathered before a part of a sketch leaves its task.
PART = 1 << 20


def word_hashes(text: str, known: dict[bytes, int]) -> np.ndarray:
    """64-bit hashes of the words; ``known`` keeps those of frequent words."""
    words = text.encode().split()
    if len(known) > 500_000:
        known.clear()
    digest = xxhash.xxh3_64_intdigest
    out = np.empty(len(words), "u8")
    for i, w in enumerate(words):
        h = known.get(w)
        if h is None:
            h = known[w] = digest(w)
        out[i] = h
    return out


def run_hashes(words: np.ndarray, n: int, base: int) -> np.ndarray:
    """Mixed polynomial hash of every run of ``n`` words, joined from runs of doubling length."""
    total, have, power = None, 0, words
    length, mult = 1, np.uint64(base)
    while True:
        if n & length:
            if total is None:
                total, have = power, length
            else:
                size = len(words) - have - length + 1
                total = total[:size] * mult + power[have : have + size]
                have += length
        if have == n:
            break
        size = len(words) - 2 * length + 1
        power = power[:size] * mult + power[length : length + size]
        with np.errstate(over="ignore"):
            mult = mult * mult
        length *= 2
    h = total.copy()
    h ^= h >> np.uint64(31)
    h *= np.uint64(ROWS[0])
    return h ^ (h >> np.uint64(29))


def minimizers(words: np.ndarray, window: int, run: int) -> np.ndarray:
    """The least run hash inside each window; of equal ones any, for only its value is used with its place."""
    least = run_hashes(words, run, BASES[0])
    width, n = 1, window - run + 1
    while width < n:
        step = min(width, n - width)
        least = np.minimum(least[: len(least) - step], least[step:])
        width += step
    return least


def minimizer_places(words: np.ndarray, window: int, run: int) -> np.ndarray:
    """Hashes of the runs that are the minimizer of a window, each place once."""
    runs, least = run_hashes(words, run, BASES[0]), minimizers(words, window, run)
    n = window - run + 1
    # A place is the minimizer of some window if its hash equals the least of any window that covers it.
    padded = np.r_[np.zeros(n - 1, "u8"), least, np.zeros(n - 1, "u8")]
    width, top = 1, padded
    while width < n:
        step = min(width, n - width)
        top = np.maximum(top[: len(top) - step], top[step:])
        width += step
    return runs[runs <= top]


def cells(hashes: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (hashes * np.uint64(ROWS[row])) >> np.uint64(64 - bits)


def _texts(batches: Iterator[pa.RecordBatch], column: int = 0) -> Iterator[tuple]:
    known: dict[bytes, int] = {}
    for batch in batches:
        for i, text in enumerate(batch.column(column)):
            text = text.as_py()
            yield batch, i, word_hashes(text, known) if text else np.empty(0, "u8")


def sketch_part(window: int, run: int, bits: int):
    """Partition sketches as rows ``(row, chunk, cells, counts)``: places inside the chunk, counts of at most 2."""

    def rows(found: list[np.ndarray]) -> pa.RecordBatch:
        hashes = np.concatenate(found)
        which, chunk, places, counts = [], [], [], []
        for r in range(len(ROWS)):
            cell, n = np.unique(cells(hashes, r, bits), return_counts=True)
            cut = np.flatnonzero(np.diff(cell >> np.uint64(CHUNK_BITS))) + 1
            n = np.minimum(n, 2).astype("u1")
            for c, m in zip(np.split(cell, cut), np.split(n, cut)):
                if len(c):
                    which.append(r)
                    chunk.append(int(c[0]) >> CHUNK_BITS)
                    places.append((c & np.uint64((1 << CHUNK_BITS) - 1)).astype("<u2").tobytes())
                    counts.append(np.packbits(m == 2).tobytes())
        return pa.RecordBatch.from_arrays(
            [pa.array(which, pa.int32()), pa.array(chunk, pa.int32()), pa.array(places, pa.binary()), pa.array(counts, pa.binary())],
            ["row", "chunk", "places", "twice"],
        )

    def run_(batches):
        found, n = [], 0
        for _, _, words in _texts(batches):
            if len(words) >= window:
                found.append(minimizer_places(words, window, run))
                n += len(found[-1])
                if n >= PART:
                    yield rows(found)
                    found, n = [], 0
        if found:
            yield rows(found)

    return run_


def merge_chunk(key: tuple, parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One bit per cell of a chunk: counted twice or more in all partition sketches together."""
    count = np.zeros(1 << CHUNK_BITS, "u4")
    for part in parts:
        for places, twice in zip(part["places"], part["twice"]):
            p = np.frombuffer(places, "<u2")
            count[p] += 1 + np.unpackbits(np.frombuffer(twice, "u1"), count=len(p))
    bits = np.packbits(count >= 2)
    yield pd.DataFrame({"row": [key[0]], "chunk": [key[1]], "bits": [bits.tobytes()]})


def repeated_cells(texts: DataFrame, window: int, run: int, bits: int) -> list[np.ndarray]:
    """The merged sketch: for each of its rows the packed bits of cells that may repeat."""
    parts = texts.select("text").mapInArrow(
        sketch_part(window, run, bits), "row int, chunk int, places binary, twice binary"
    )
    merged = parts.groupBy("row", "chunk").applyInPandas(merge_chunk, "row int, chunk int, bits binary")
    out = [np.zeros(1 << (bits - 3), "u1") for _ in ROWS]
    size = 1 << (CHUNK_BITS - 3)
    for x in merged.collect():  # 2 ** (bits - CHUNK_BITS) rows of 8 kB for each row of the sketch at most
        out[x["row"]][x["chunk"] * size : (x["chunk"] + 1) * size] = np.frombuffer(x["bits"], "u1")
    return out


def may_repeat(hashes: np.ndarray, sketch: list[np.ndarray], bits: int) -> np.ndarray:
    found = np.ones(len(hashes), bool)
    for r, packed in enumerate(sketch):
        c = cells(hashes, r, bits)
        found &= (packed[(c >> np.uint64(3)).astype("i8")] >> (np.uint64(7) - (c & np.uint64(7))).astype("u1")) & 1 == 1
    return found


def candidate_blocks(sketch, window: int, run: int, bits: int):
    """Rows of :data:`BLOCK_SCHEMA`: neighbouring windows that may repeat and have the same minimizer, with their hashes."""

    def run_(batches):
        for batch in batches:
            got = []
            others = list(zip(*[batch.column(i).to_pylist() for i in range(3)]))
            for _, i, words in _texts([batch], 3):
                if len(words) < window:
                    continue
                least = minimizers(words, window, run)
                pos = np.flatnonzero(may_repeat(least, sketch.value, bits))
                if len(pos):
                    least, hashes = least[pos], run_hashes(words, window, BASES[1])[pos]
                    begins = np.r_[True, (np.diff(pos) != 1) | (least[1:] != least[:-1])]
                    place = np.arange(len(pos))
                    begins |= (place - np.maximum.accumulate(np.where(begins, place, 0))) % BLOCK == 0
                    first = np.flatnonzero(begins)
                    got.append((least[first], pos[first], np.diff(np.r_[first, len(pos)]), hashes, others[i]))
            if got:
                n = [len(g[0]) for g in got]
                ends = 8 * np.cumsum(np.concatenate([g[2] for g in got]))
                hashes = pa.py_buffer(np.concatenate([g[3] for g in got]).tobytes())
                offsets = pa.py_buffer(np.r_[0, ends].astype("i4").tobytes())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([g[0] for g in got]).view("i8")),
                        pa.array(np.repeat(np.array([g[4][0] for g in got]), n)),
                        pa.array(np.repeat(np.array([g[4][1] for g in got], "i8"), n)),
                        pa.array(np.repeat(np.array([g[4][2] for g in got], "i8"), n)),
                        pa.array(np.concatenate([g[1] for g in got]).astype("i4")),
                        pa.Array.from_buffers(pa.binary(), len(ends), [None, offsets, hashes]),
                    ],
                    BLOCK_NAMES,
                )

    return run_


#: Windows of a block at most: as many as a long has bits, less one.
BLOCK = 63
BLOCK_NAMES = ["least", "no_id", "doc_id", "text_key", "pos", "hashes"]
BLOCK_SCHEMA = "least long, no_id boolean, doc_id long, text_key long, pos int, hashes binary"
#: Repeated windows of a block: bit i stands for the window at ``pos + i``.
FOUND_NAMES = ["no_id", "doc_id", "text_key", "pos", "bits"]
FOUND_SCHEMA = "no_id boolean, doc_id long, text_key long, pos int, bits long"


def _windows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window of the blocks: its block, its place in it, its hash."""
    data = batch.column(5).to_pylist()
    n = np.array([len(x) // 8 for x in data], "i8")
    block = np.repeat(np.arange(len(n)), n)
    return block, np.arange(len(block)) - np.repeat(np.cumsum(n) - n, n), np.frombuffer(b"".join(data), "<i8")


def group_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated windows of blocks sorted by minimizer; the last minimizer of a batch waits for the next one.

    No minimizer that comes here has more than ``MANY`` blocks.
    """
    held: pa.Table | None = None

    def found(table: pa.Table) -> pa.RecordBatch:
        batch = table.combine_chunks().to_batches()[0]
        block, place, hashes = _windows(batch)
        least = batch.column(0).to_numpy()[block]
        order = np.lexsort((hashes, least))
        same = (hashes[order][1:] == hashes[order][:-1]) & (least[order][1:] == least[order][:-1])
        repeated = np.zeros(len(order), bool)
        repeated[order[1:][same]] = True
        repeated[order[:-1][same]] = True
        bits = np.zeros(batch.num_rows, "i8")
        np.bitwise_or.at(bits, block[repeated], np.int64(1) << place[repeated])
        some = pa.array(bits != 0)
        columns = [*[batch.column(i) for i in range(1, 5)], pa.array(bits)]
        return pa.RecordBatch.from_arrays([c.filter(some) for c in columns], FOUND_NAMES)

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        least = table.column(0).to_numpy()
        cut = int(np.searchsorted(least, least[-1]))
        held = table.slice(cut)
        if cut:
            yield found(table.slice(0, cut))
    if held is not None:
        yield found(held)


def single_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks as rows ``(h1, h2, no_id, doc_id, text_key, pos)``, one for each window."""
    for batch in batches:
        block, place, hashes = _windows(batch)
        least, no_id, doc_id, key, pos = (batch.column(i).to_numpy(zero_copy_only=False)[block] for i in range(5))
        yield pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (hashes, least, no_id, doc_id, key, (pos + place).astype("i4"))],
            ["h1", "h2", "no_id", "doc_id", "text_key", "pos"],
        )


MARK_SCHEMA = "kind byte, h1 long, h2 long, no_id boolean, doc_id long, text_key long, pos int, n long"
REPEATED, ALONE, BORDER = 0, 1, 2


def _marks(kind: int, rows: np.ndarray, n: int = 0) -> pa.RecordBatch:
    keyed = kind != REPEATED  # the hash has served its purpose then
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(len(rows), kind, "i1")),
            *[pa.array(np.ascontiguousarray(rows[:, c]) if keyed else np.zeros(len(rows), "i8")) for c in (0, 1)],
            pa.array(rows[:, 2] == 1),
            *[pa.array(np.ascontiguousarray(rows[:, c])) for c in (3, 4)],
            pa.array(rows[:, 5].astype("i4")),
            pa.array(np.full(len(rows), n, "i8")),
        ],
        ["kind", "h1", "h2", "no_id", "doc_id", "text_key", "pos", "n"],
    )


def stream_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marks for one sorted range; the last row of a batch waits for the next one.

    The first and the last group of a range leave a border row with their count, and if that is 1, the row as ``ALONE``.
    """
    held, equal_before = np.empty((0, 6), "i8"), False  # a row, and whether the row before it is equal
    first: np.ndarray | None = None
    first_n, first_ended, group_n = 0, False, 0
    for batch in batches:
        new = np.stack([c.to_numpy(zero_copy_only=False).astype("i8") for c in batch.columns], axis=1)
        if not len(new):
            continue
        rows = np.concatenate([held, new])
        same = (rows[1:, :2] == rows[:-1, :2]).all(axis=1)
        before = np.r_[equal_before, same]
        repeated = before[:-1] | same
        body = rows[:-1]
        if first is None:
            first = rows[0]
        if not first_ended:
            own = (rows[:, :2] == first[:2]).all(axis=1)
            first_n = max(first_n, 0) + int(own[len(held) :].sum())
            if not own.all():
                first_ended = True
                yield _marks(BORDER, first[None], first_n)
                if first_n == 1:
                    yield _marks(ALONE, first[None])
        yield _marks(REPEATED, body[repeated])
        held, equal_before = rows[-1:], bool(before[-1])
        changes = np.flatnonzero(~same)
        group_n = len(rows) - 1 - changes[-1] if len(changes) else group_n + len(new)
    if len(held):
        if equal_before:
            yield _marks(REPEATED, held)
        n = group_n if first_ended else first_n
        yield _marks(BORDER, held, int(n))
        if n == 1:
            yield _marks(ALONE, held)


def repeated_windows(docs: DataFrame, window: int = WINDOW, run: int = RUN, bits: int = CELL_BITS, many: int = MANY) -> DataFrame:
    """Repeated windows as rows of :data:`FOUND_SCHEMA`; ``no_id`` marks rows without doc_id."""
    texts = docs.select(F.col("doc_id").cast("long"), text_key(F.col("text")).alias("text_key"), "text")
    sketch = docs.sparkSession.sparkContext.broadcast(repeated_cells(texts, window, run, bits))
    keyed = texts.select(
        F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "text_key", "text"
    )
    blocks = written(keyed.mapInArrow(candidate_blocks(sketch, window, run, bits), BLOCK_SCHEMA), "window-blocks")
    frequent = written(blocks.groupBy("least").count().filter(F.col("count") > many).select("least"), "window-frequent")
    # Windows with equal hashes have equal minimizers, so a minimizer is a group to itself; frequent ones go by windows.
    rest = blocks.join(frequent, "least", "left_anti").select(BLOCK_NAMES)
    grouped = rest.repartition("least").sortWithinPartitions("least").mapInArrow(group_blocks, FOUND_SCHEMA)
    single = blocks.join(frequent, "least", "left_semi").select(BLOCK_NAMES)
    order = ["h1", "h2", "no_id", "doc_id", "text_key", "pos"]
    windows = single.mapInArrow(single_windows, "h1 long, h2 long, no_id boolean, doc_id long, text_key long, pos int")
    ranges = written(windows, "windows").repartitionByRange(*order).sortWithinPartitions(*order)
    marks = written(ranges.mapInArrow(stream_windows, MARK_SCHEMA), "window-marks")
    cut = (  # two rows for each range at most, so it can be broadcast
        marks.filter(F.col("kind") == BORDER).groupBy("h1", "h2").agg(F.sum("n").alias("all")).filter(F.col("all") > 1)
    )
    alone = marks.filter(F.col("kind") == ALONE).join(F.broadcast(cut), ["h1", "h2"], "left_semi")
    columns = ["no_id", "doc_id", "text_key", "pos"]
    ranged = marks.filter(F.col("kind") == REPEATED).select(columns).union(alone.select(columns))
    return grouped.union(ranged.withColumn("bits", F.lit(1).cast("long")))


KEPT = T.StructType([T.StructField("kept", T.StringType()), T.StructField("n_removed", T.LongType())])


@F.pandas_udf(KEPT)
def without_windows(text: pd.Series, starts: pd.Series, window: pd.Series) -> pd.DataFrame:
    """The words outside all given windows, joined by one space; ``starts`` null: all words.

    ``starts`` has places and bits: bit i stands for the window at the place + i.
    """
    kept, removed = [], []
    for t, s, width in zip(text, starts, window):
        words = (t or "").encode().split()
        if s is not None and len(s):
            place = np.array([x["pos"] for x in s], "i8")[:, None] + np.arange(BLOCK)
            bits = np.array([x["bits"] for x in s], "i8")[:, None] >> np.arange(BLOCK) & 1
            place = place[bits == 1]
            edge = np.zeros(len(words) + 1, "i4")
            np.add.at(edge, place, 1)
            np.subtract.at(edge, place + width, 1)
            stays = np.cumsum(edge[:-1]) == 0
            words, n = [w for w, k in zip(words, stays.tolist()) if k], int((~stays).sum())
        else:
            n = 0
        kept.append(b" ".join(words).decode())
        removed.append(n)
    return pd.DataFrame({"kept": kept, "n_removed": removed})


def dedup_substrings(
    docs: DataFrame, window: int = WINDOW, run: int = RUN, bits: int = CELL_BITS, many: int = MANY
) -> DataFrame:
    """The documents with ``kept_text`` and ``n_removed_words``; all other columns stay."""
    starts = (
        repeated_windows(docs.select("doc_id", "text"), window, run, bits, many)
        .groupBy(
            F.when(~F.col("no_id"), F.col("doc_id")).alias("_velum_doc"),
            F.col("text_key").alias("_velum_key"),
        )
        .agg(F.collect_set(F.struct("pos", "bits")).alias("_velum_starts"))
    )
    on = F.col("doc_id").eqNullSafe(F.col("_velum_doc")) & (text_key(F.col("text")) == F.col("_velum_key"))
    joined = docs.join(starts, on, "left")
    done = joined.withColumn("_velum_done", without_windows("text", "_velum_starts", F.lit(window)))
    others = [c for c in docs.columns if c not in ("kept_text", "n_removed_words")]
    return done.select(
        *others, F.col("_velum_done.kept").alias("kept_text"), F.col("_velum_done.n_removed").alias("n_removed_words")
    )


def op7_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    kept = dedup_substrings(docs)
    left = F.when(F.col("kept_text") == "", F.lit(0)).otherwise(
        F.length("kept_text") - F.length(F.replace("kept_text", F.lit(" "), F.lit(""))) + 1
    )
    return kept.select(
        "doc_id",
        (left + F.col("n_removed_words")).cast("long").alias("n_words"),
        F.col("n_removed_words").alias("n_removed"),
        F.sha2("kept_text", 256).alias("kept_sha256"),
    )


ORACLE_SQL = rf"""
WITH w AS (
  SELECT row_number() OVER () AS rid, doc_id,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
),
win AS (
  SELECT rid, i, md5(array_to_string(ws[i : i + {WINDOW - 1}], ' ')) AS g
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w)
),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY g) AS c FROM win) WHERE c > 1),
wp AS (SELECT rid, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM w),
marked AS (
  SELECT wp.rid, wp.pos, wp.word, r.i IS NOT NULL AND wp.pos < r.i + {WINDOW} AS gone
  FROM wp ASOF LEFT JOIN rep r ON r.rid = wp.rid AND r.i <= wp.pos
),
m AS (
  SELECT rid, count(*) AS n, count(*) FILTER (gone) AS g, string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone) AS kept
  FROM marked GROUP BY rid
)
SELECT w.doc_id, coalesce(m.n, 0)::BIGINT AS n_words, coalesce(m.g, 0)::BIGINT AS n_removed,
  sha256(coalesce(m.kept, '')) AS kept_sha256
FROM w LEFT JOIN m USING (rid)
"""
