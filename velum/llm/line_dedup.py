"""Line dedup: lines found in several documents stay in one of them only.

Every line of at least ``min_chars`` code points becomes a row of its key's 128-bit hash, document and position. These
rows are dealt out by ranges of (hash, document) and sorted within each range by hash, document from the largest down,
and position; a task streams through its range and marks all lines of a group but those of its first document. A range
border may cut a large group, so no hash is too frequent for one task: lines of a cut group are set aside as open, and
two border rows per range tell in how many documents the whole group is found and which comes first. What leaves the
pass are positions, gathered per document as a compressed bitmap of the lines to keep; text moves only once, to meet its
bitmap.

Defined cases: a null text is one empty line, as is an empty one; rows without doc_id keep all lines and are counted
nowhere; rows that repeat a doc_id are one document for counting, and each keeps or loses lines by its own text; an
empty table gives an empty result; further columns are untouched.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from velum.llm.common import SPACES, text_key
from velum.sources.sinks import written

MIN_CHARS, MIN_DOCS = 40, 5
KEY_SCHEMA = "h1 long, h2 long, doc_id long, text_key long, pos int"
MARK_SCHEMA = "kind byte, h1 long, h2 long, doc_id long, text_key long, pos int, n_docs long"
DROP, OPEN, BORDER = 0, 1, 2


def line_keys(min_chars: int):
    """Rows of :data:`KEY_SCHEMA` for the long lines of each batch of (doc_id, text_key, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, docs, keys, places = [], [], [], []
            ids, text_keys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, text in enumerate(batch.column(2)):
                text = text.as_py()
                if text is None or ids[i] is None:
                    continue
                for pos, line in enumerate(text.split("\n")):
                    if len(line) >= min_chars and len(line := line.strip(SPACES)) >= min_chars:
                        digests.append(xxhash.xxh3_128_digest(line.encode().lower()))  # bytes: A-Z only
                        docs.append(ids[i])
                        keys.append(text_keys[i])
                        places.append(pos)
            h = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.ascontiguousarray(h[:, 0])),
                    pa.array(np.ascontiguousarray(h[:, 1])),
                    pa.array(docs, pa.int64()),
                    pa.array(keys, pa.int64()),
                    pa.array(places, pa.int32()),
                ],
                ["h1", "h2", "doc_id", "text_key", "pos"],
            )

    return run


def _marks(kind: int, rows: np.ndarray, n_docs: int | np.ndarray = 0) -> pa.RecordBatch:
    n = len(rows)
    keyed = kind != DROP  # the hash has served its purpose then
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(n, kind, "i1")),
            *[pa.array(np.ascontiguousarray(rows[:, c]) if keyed else np.zeros(n, "i8")) for c in (0, 1)],
            *[pa.array(np.ascontiguousarray(rows[:, c])) for c in (2, 3)],
            pa.array(rows[:, 4].astype("i4")),
            pa.array(np.full(n, n_docs, "i8")),
        ],
        ["kind", "h1", "h2", "doc_id", "text_key", "pos", "n_docs"],
    )


def stream_groups(min_docs: int):
    """Marks for one sorted range. Memory: a batch, and of a group fewer than ``min_docs`` documents.

    The group at hand is in one of three states: held back while too few documents are seen; decided, when enough are
    (its first document was seen here); or open, when it is the range's first and may have begun in an earlier one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((0, 5), "i8")
        top = None  # first row of the group at hand, once decided or open
        n_docs, last_doc, is_open, begun = 0, None, False, False
        for batch in batches:
            new = np.stack([c.to_numpy(zero_copy_only=False).astype("i8") for c in batch.columns], axis=1)
            if not len(new):
                continue
            rows = np.concatenate([held, new]) if len(held) else new
            held = held[:0]
            starts = np.flatnonzero(np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)])
            if not begun:
                begun, is_open, top, n_docs, last_doc = True, True, rows[0], 0, None
            if top is not None:
                if (rows[0, :2] == top[:2]).all():
                    end = starts[1] if len(starts) > 1 else len(rows)
                    part, rows, starts = rows[:end], rows[end:], starts[1:] - end
                    n_docs += int((part[1:, 2] != part[:-1, 2]).sum()) + int(last_doc is None or part[0, 2] != last_doc)
                    last_doc = part[-1, 2]
                    yield _marks(OPEN, part) if is_open else _marks(DROP, part[part[:, 2] != top[2]])
                if not len(rows):
                    continue
                if is_open:
                    yield _marks(BORDER, top[None], n_docs)
                top = None
            group = np.cumsum(np.bincount(starts, minlength=len(rows))) - 1
            new_doc = np.r_[True, (rows[1:, :3] != rows[:-1, :3]).any(axis=1)]
            docs = np.add.reduceat(new_doc.astype("i8"), starts)
            first = rows[starts[group], 2]
            drop = (docs[group] >= min_docs) & (rows[:, 2] != first)
            yield _marks(DROP, rows[drop])
            if docs[-1] >= min_docs:
                is_open, top, n_docs, last_doc = False, rows[starts[-1]], int(docs[-1]), rows[-1, 2]
            else:
                held = rows[starts[-1] :]
        if len(held):
            yield _marks(OPEN, held)
            yield _marks(BORDER, held[:1], len(np.unique(held[:, 2])))
        elif top is not None:
            yield _marks(BORDER, top[None], n_docs)

    return run


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Lines to drop as ``(doc_id, text_key, pos)``."""
    keyed = docs.select(F.col("doc_id").cast("long"), text_key(F.col("text")).alias("text_key"), "text")
    keys = written(keyed.mapInArrow(line_keys(min_chars), KEY_SCHEMA), "line-keys")
    order = ["h1", "h2", F.desc("doc_id")]
    ranges = keys.repartitionByRange(*order).sortWithinPartitions(*order, "text_key", "pos")
    marks = written(ranges.mapInArrow(stream_groups(min_docs), MARK_SCHEMA), "line-marks")
    cut = (  # two rows for each range at most, so it can be broadcast
        marks.filter(F.col("kind") == BORDER)
        .groupBy("h1", "h2")
        .agg(F.sum("n_docs").alias("all_docs"), F.max("doc_id").alias("top"))
        .filter(F.col("all_docs") >= min_docs)
    )
    opened = marks.filter(F.col("kind") == OPEN).drop("n_docs").join(F.broadcast(cut), ["h1", "h2"]).filter("doc_id <> top")
    columns = ["doc_id", "text_key", "pos"]
    return marks.filter(F.col("kind") == DROP).select(columns).union(opened.select(columns))


@F.pandas_udf(T.BinaryType())
def keep_bitmap(dropped: pd.Series) -> pd.Series:
    """A deflated bitmap with a zero bit for each dropped line; lines past its end stay."""

    def one(places: np.ndarray) -> bytes:
        bits = np.ones(places.max() // 8 * 8 + 8, bool)
        bits[places] = False
        return zlib.compress(np.packbits(bits).tobytes())

    return dropped.map(one)


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``(doc_id, text_key, n_dropped, bitmap)`` of every document that loses a line."""
    lines = dropped_lines(docs, min_chars, min_docs).groupBy("doc_id", "text_key").agg(F.collect_set("pos").alias("places"))
    return lines.select(
        "doc_id", "text_key", F.size("places").cast("long").alias("n_dropped"), keep_bitmap("places").alias("bitmap")
    )


@F.pandas_udf(T.StringType())
def kept_text(text: pd.Series, bitmap: pd.Series) -> pd.Series:
    """The lines of each text whose bit is set, joined again; null where there is no bitmap."""

    def one(t: str | None, packed: bytes | None) -> str | None:
        if packed is None or t is None:
            return None
        bits = np.unpackbits(np.frombuffer(zlib.decompress(packed), "u1"))
        return "\n".join(line for i, line in enumerate(t.split("\n")) if i >= len(bits) or bits[i])

    return pd.Series([one(t, b) for t, b in zip(text, bitmap)], dtype=object)


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """The documents and ``_velum_kept_text``, null where nothing is dropped, and ``_velum_dropped``; all columns stay."""
    maps = written(keep_bitmaps(docs.select("doc_id", "text"), min_chars, min_docs), "line-bitmaps").select(
        F.col("doc_id").alias("_velum_doc"),
        F.col("text_key").alias("_velum_key"),
        F.col("n_dropped").alias("_velum_dropped"),
        F.col("bitmap").alias("_velum_bitmap"),
    )
    on = (F.col("doc_id") == F.col("_velum_doc")) & (text_key(F.col("text")) == F.col("_velum_key"))
    rest = docs.columns
    joined = docs.join(maps, on, "left")
    changed = kept_text(F.when(F.col("_velum_bitmap").isNotNull(), F.col("text")), F.col("_velum_bitmap"))
    dropped = F.coalesce("_velum_dropped", F.lit(0)).cast("long")
    return joined.select(*rest, changed.alias("_velum_kept_text"), dropped.alias("_velum_dropped"))


def op2_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    text = F.coalesce("text", F.lit(""))
    return dedup_lines(docs).select(
        "doc_id",
        (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
        F.col("_velum_dropped").alias("n_dropped"),
        F.sha2(F.coalesce("_velum_kept_text", text), 256).alias("kept_sha256"),
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """The documents without the dropped lines; ``n_chars``, if there, follows the text."""
    done = dedup_lines(docs)
    counted = F.coalesce(F.length("_velum_kept_text").cast("long"), F.col("n_chars")).alias("n_chars")
    return done.select(
        *[
            {"text": F.coalesce("_velum_kept_text", "text").alias("text"), "n_chars": counted}.get(c, F.col(c))
            for c in docs.columns
        ]
    )


ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT rid, doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS pos FROM d),
k AS (
  SELECT rid, doc_id, pos, line,
    translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
),
hot AS (
  SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= {MIN_CHARS}
  GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_DOCS}
),
m AS (SELECT k.*, hot.key IS NOT NULL AND k.doc_id <> hot.top AS gone FROM k LEFT JOIN hot ON k.key = hot.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY rid, doc_id
"""
