"""SimHash near-duplicates: documents whose 64-bit fingerprints differ in at most two bits, and all they reach.

Links are sought among distinct fingerprints by a self-join of a binary trie: node pairs are traversed together, each
pair carries the bits in which its prefixes differ, and a pair over the budget is dropped with all below it. Two bits
cannot touch all three thirds of a fingerprint; so each fingerprint enters three tries, with another third of its bits
turned to the top each time, and in each trie only pairs that agree in the first 21 bits are followed. A group with the
same top is a subtrie, and subtries are dealt out and sorted by Spark; a task walks many of them at once, level by level,
as numpy arrays. A subtrie of more than ``LIMIT`` fingerprints is cut once more: its nodes twelve bits further down form
pairs within the budget, and each pair is a task's group of its own.

A task returns for each fingerprint it could link a single edge to the least one it reaches there, never all pairs. The
edges of all tries meet in :func:`velum.llm.components.components`.

Defined cases: a text without words, null included, has fingerprint zero, linked like any other; rows without doc_id get
the component of their fingerprint; rows that repeat a doc_id are linked each by its own text; an empty table gives an
empty result; further columns are untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from velum.llm.common import text_key
from velum.llm.components import components
from velum.sources.sinks import written

SHINGLE, SEED, BUDGET = 3, 42, 2
TOP, CUT = 21, 12
LIMIT = 50_000
#: Left turns that bring each third of the bits to the top.
TURNS = (0, 21, 42)


def fingerprint(text: str | None) -> int:
    """Unsigned; a bit is set if it is set in over half of the hashes of the text's shingles."""
    words = (text or "").encode().lower().split()  # bytes: A-Z, and the six ASCII spaces
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < SHINGLE:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), "i8", len(words)) + 1) - 1
    starts = np.r_[0, ends[: -SHINGLE] + 1].tolist()
    ends = ends[SHINGLE - 1 :].tolist()
    digest, n = xxhash.xxh64_intdigest, len(starts)
    counts = np.zeros(64, "i8")
    for a in range(0, n, 50_000):
        hashes = np.array([digest(joined[s:e], SEED) for s, e in zip(starts[a : a + 50_000], ends[a : a + 50_000])], "<u8")
        counts += np.unpackbits(hashes.view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype="u4")
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array([fingerprint(t.as_py()) for t in batch.column(2)], "u8").view("i8")
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(prints)], ["doc_id", "text_key", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, text_key, fp)``, the fingerprint as a signed long."""
    rows = docs.select(F.col("doc_id").cast("long"), text_key(F.col("text")).alias("text_key"), "text")
    return rows.mapInArrow(_fingerprints, "doc_id long, text_key long, fp long")


def _close_pairs(keys: np.ndarray, starts: np.ndarray, ends: np.ndarray, cross: np.ndarray) -> Iterator[tuple]:
    """Places of keys within the budget of each other; the keys of a group ``[start, end)`` share their top bits.

    In a group marked ``cross`` two nodes ``CUT`` bits below the top are joined with each other only.
    """
    deeper = np.empty((0, 5), "i8")
    if cross.any():
        s, e = starts[cross], ends[cross]
        shift = np.uint64(64 - TOP - CUT)
        node = keys >> shift
        mid = np.array([a + np.searchsorted(node[a:b], node[b - 1]) for a, b in zip(s, e)], "i8")
        differ = np.bitwise_count(node[s] ^ node[e - 1]).astype("i8")
        deeper = np.stack([s, mid, mid, e, differ], axis=1)[mid > s]
    s, e = starts[~cross], ends[~cross]
    pairs = np.stack([s, e, s, e, np.zeros(len(s), "i8")], axis=1)
    for bit in range(63 - TOP, -1, -1):
        if bit == 63 - TOP - CUT and len(deeper):
            pairs = np.concatenate([pairs, deeper])
        if not len(pairs) and not (len(deeper) and bit > 63 - TOP - CUT):
            return
        area = (pairs[:, 1] - pairs[:, 0]) * (pairs[:, 3] - pairs[:, 2])
        small = area <= 64
        yield from _compare(keys, pairs[small], area[small])
        pairs = pairs[~small]
        if not len(pairs):
            continue
        ones = np.r_[0, np.cumsum((keys >> np.uint64(bit)) & np.uint64(1)).astype("i8")]
        a0, a1, b0, b1, d = pairs.T
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
        own = a0 == b0
        down = [
            np.stack([a0, am, b0, bm, d], axis=1),
            np.stack([am, a1, bm, b1, d], axis=1),
            np.stack([a0, am, bm, b1, d + 1], axis=1),
            np.stack([am, a1, b0, bm, d + 1], axis=1)[~own],  # a node with itself: its two children once
        ]
        pairs = np.concatenate(down)
        pairs = pairs[(pairs[:, 1] > pairs[:, 0]) & (pairs[:, 3] > pairs[:, 2]) & (pairs[:, 4] <= BUDGET)]
    area = (pairs[:, 1] - pairs[:, 0]) * (pairs[:, 3] - pairs[:, 2])
    yield from _compare(keys, pairs, area)


def _compare(keys: np.ndarray, pairs: np.ndarray, area: np.ndarray) -> Iterator[tuple]:
    """Small node pairs, key by key."""
    for a in range(0, len(pairs), 100_000):
        p, n = pairs[a : a + 100_000], area[a : a + 100_000]
        which = np.repeat(np.arange(len(p)), n)
        place = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        width = (p[:, 3] - p[:, 2])[which]
        i, j = p[which, 0] + place // width, p[which, 2] + place % width
        near = (i != j) & (np.bitwise_count(keys[i] ^ keys[j]) <= BUDGET)
        yield i[near], j[near]


def _least_reached(n: int, links: Iterator[tuple]) -> np.ndarray:
    """For each place the least place it is linked with."""
    root = np.arange(n)
    for i, j in links:
        while len(i):
            a, b = root[i], root[j]
            differ = a != b
            i, j, a, b = i[differ], j[differ], a[differ], b[differ]
            if not len(i):
                break
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (root[root] != root).any():
                root = root[root]
    return root


def _join_tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges from sorted rows (turn, top, pair, key, fp); the last group of a batch waits for the next one."""
    held = None
    for batch in _with_end(batches):
        if batch is not None:
            new = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
            rows = new if held is None else np.concatenate([held, new])
            if not len(rows):
                continue
            changes = np.flatnonzero((rows[1:, :3] != rows[:-1, :3]).any(axis=1)) + 1
            cut = changes[-1] if len(changes) else 0
            held, rows = rows[cut:], rows[:cut]
        else:
            rows = held if held is not None else np.empty((0, 5), "i8")
        if not len(rows):
            continue
        starts = np.r_[0, np.flatnonzero((rows[1:, :3] != rows[:-1, :3]).any(axis=1)) + 1]
        ends = np.r_[starts[1:], len(rows)]
        pair = rows[starts, 2]
        cross = (pair >= 0) & (pair >> CUT != pair & ((1 << CUT) - 1))
        keep = ends - starts > 1
        # Keys were sorted as signed numbers with the top bit flipped; flip it back.
        keys = rows[:, 3].astype("i8").view("u8") ^ np.uint64(1 << 63)
        root = _least_reached(len(rows), _close_pairs(keys, starts[keep], ends[keep], cross[keep]))
        linked = np.flatnonzero(root != np.arange(len(rows)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows[linked, 4]), pa.array(rows[root[linked], 4])], ["u", "v"]
        )


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def links(prints: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Edges ``(u, v)`` that link all fingerprints ``fp`` within the budget of each other; ``fp`` must be distinct."""
    turned = prints.select(
        "fp",
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(i).cast("long").alias("turn"),
                        (F.shiftleft("fp", t).bitwiseOR(F.shiftrightunsigned("fp", 64 - t)) if t else F.col("fp")).alias("key"),
                    )
                    for i, t in enumerate(TURNS)
                ]
            )
        ).alias("x"),
    ).select("fp", "x.*")
    tops = written(turned.withColumn("top", F.shiftrightunsigned("key", 64 - TOP)), "simhash-tries")
    large = written(tops.groupBy("turn", "top").agg(F.count("*").alias("n")).filter(F.col("n") > limit), "simhash-large")
    known = tops.join(large, ["turn", "top"], "left")
    node = F.shiftrightunsigned("key", 64 - TOP - CUT).bitwiseAND(F.lit((1 << CUT) - 1))
    near = [0, *[1 << i for i in range(CUT)], *[1 << i | 1 << j for i in range(CUT) for j in range(i)]]
    others = F.transform(F.array(*[F.lit(m).cast("long") for m in near]), lambda m: node.bitwiseXOR(m))
    paired = F.transform(
        others, lambda o: F.shiftleft(F.least(node, o), CUT).bitwiseOR(F.greatest(node, o))
    )
    grouped = known.select(
        "turn",
        "top",
        F.explode(F.when(F.col("n").isNull(), F.array(F.lit(-1).cast("long"))).otherwise(paired)).alias("pair"),
        F.col("key").bitwiseXOR(F.lit(-(1 << 63))).alias("key"),
        "fp",
    )
    dealt = grouped.repartition("turn", "top", "pair").sortWithinPartitions("turn", "top", "pair", "key")
    return dealt.mapInArrow(_join_tries, "u long, v long")


def near_duplicates(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``(doc_id, text_key, fp, component_id)`` per document; the least doc_id reachable names the component."""
    prints = written(fingerprints(docs), "simhash-prints")
    classes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first_doc")), "simhash-classes")
    roots = components(links(classes.select("fp"), limit))
    linked = classes.join(roots, classes["fp"] == roots["node"], "left").select(
        "fp", "first_doc", F.coalesce("root", "fp").alias("root")
    )
    names = linked.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    named = written(linked.join(names, "root").select("fp", "component_id"), "simhash-components")
    return prints.join(named, "fp").select("doc_id", "text_key", "fp", "component_id")


def op10_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """One document of each component, the one with the least doc_id; rows without doc_id stay.

    Of rows that repeat that doc_id one stays, with the least text hash.
    """
    narrow = near_duplicates(docs.select("doc_id", "text"), limit).filter("doc_id = component_id")
    chosen = narrow.groupBy(F.col("doc_id").alias("_velum_doc")).agg(
        F.min("text_key").alias("_velum_key"), F.count("*").alias("_velum_rows")
    )
    on = (F.col("doc_id") == F.col("_velum_doc")) & (text_key(F.col("text")) == F.col("_velum_key"))
    joined = docs.join(chosen, on)
    number = F.row_number().over(Window.partitionBy("_velum_doc").orderBy("_velum_key"))
    repeated = joined.filter("_velum_rows > 1").withColumn("_velum_row", number).filter("_velum_row = 1")
    once = joined.filter("_velum_rows = 1")
    return once.select(*docs.columns).union(repeated.select(*docs.columns)).union(docs.filter("doc_id IS NULL"))
