"""Cross-entropy difference: how much more a text looks like the target documents than like the whole corpus.

Two bigram models are matched in all but their counts: one vocabulary, one set of word pairs, one smoothing. The target
model counts the target documents, the background model all documents. A text's score is the mean over its words of the
loss under the target model minus the loss under the background model; the lower, the nearer to the target.

All words and word pairs of all documents are counted exactly, told apart by 64-bit hashes, and every count is used. A
model that has counted a text would know it by heart: the text's own counts are taken off before it is scored.

Texts are written as blocks of about ``BLOCK`` words, as numbers of the block's own word list, and never shuffled: the
blocks are a bucketed table, and what is to meet them goes to their buckets. What is shuffled are not pairs but packed
columns: a block counts its distinct pairs and words and sends one row per range of hashes, with sorted hashes and counts.
A task adds up the blocks of a range and sends each of them, in the order it asked, what the *other* blocks counted. Back
at the block the sums are complete and all its texts are scored. The ranges grow in number with the corpus; a range has at
most one entry per block for any hash, so no frequent word or pair weighs on a task. There are never more rows than
distinct pairs and words per block, however many blocks and ranges there are. How many pairs begin with a word is how
often it stands, less how often it ends a text.

    P(w | v) = (count(v w) + STRENGTH * P(w)) / (count(v .) + STRENGTH),  P(w) = (count(w) + 1) / (words + types)

Defined cases: a text without words, null included, has 0 words and null losses; rows that repeat a doc_id are counted and
scored each; labels without a document, or that repeat, change nothing; without target documents the target model knows
nothing and all its words are alike; a text longer than a block is a block of its own, never cut; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velum.sources.sinks import shared_path, written

STRENGTH = 8.0
#: Words of a block, words of the corpus per range of hashes, and distinct words a task remembers; none changes a result.
BLOCK, RANGE, REMEMBERED = 1_000_000, 1_000_000, 500_000
#: The word before a text's first; no hash of a word is negative.
START = -1
PAIR, WORD, TARGET = range(3)
BLOCKS = "doc_ids array<long>, sizes array<long>, words binary, numbers binary"
#: Counts are packed columns of all and of target occurrences, and of those that end a text.
COUNTED = "block long, kind int, range long, keys binary, n binary, n_target binary, last binary, last_target binary"
#: A row of kind TARGET has the place of a target document in its block as its range.
OTHERS = "block long, kind int, range long, n binary, n_target binary, last binary, last_target binary, fresh long"
SCORED = "doc_id long, n_tokens long, ce_target double, ce_background double"


def names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def packed(x: np.ndarray) -> bytes:
    """Longs as bytes, the first bytes of all numbers first, then the second ones: most of them are zeros."""
    return zstandard.compress(x.astype("<i8").view("u1").reshape(-1, 8).T.tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), "u1")
    return np.ascontiguousarray(raw.reshape(8, -1).T).view("<i8").ravel()


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().split()


class Words:
    """Numbers of a task's words in order of their appearance, from 1; 0 stands before a text."""

    def __init__(self):
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = defaultdict()
        self.known.default_factory = lambda: len(self.known) + 1
        self.keys = np.array([START])

    def numbers(self, text: str | None) -> np.ndarray:
        words = words_of(text)
        return np.fromiter(map(self.known.__getitem__, words), "i8", len(words))

    def hashes(self) -> np.ndarray:
        """The hash of each word by its number."""
        done = len(self.keys) - 1
        if done < len(self.known):
            new = list(self.known)[done:]
            found = np.fromiter((xxhash.xxh64_intdigest(w) >> 1 for w in new), "i8", len(new))
            self.keys = np.concatenate([self.keys, found])
        return self.keys


def parts(batches: Iterator[pa.RecordBatch], words: Words, most: int):
    """Texts in parts of about ``most`` words: the rows without the texts, and the words of each text."""
    rows, texts, size = [], [], 0
    for batch in batches:
        for *row, text in zip(*(c.to_pylist() for c in batch.columns[:-1]), batch.columns[-1]):
            numbers = words.numbers(text.as_py())
            rows.append(row)
            texts.append(numbers)
            size += len(numbers)
            if size > most:
                yield rows, texts
                rows, texts, size = [], [], 0
                if len(words.known) > REMEMBERED:
                    words.forget()
    if rows:
        yield rows, texts


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts ``(doc_id, text)`` as blocks."""
    words = Words()
    for rows, texts in parts(batches, words, BLOCK):
        used, numbers = np.unique(np.concatenate(texts), return_inverse=True)
        made = [[r[0] for r in rows], [len(t) for t in texts], packed(words.hashes()[used]), packed(numbers + 1)]
        types = [pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(made, types)], names(BLOCKS))


def pair_keys(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of pairs from the hashes of both words."""
    x = before.astype("u8") * np.uint64(0x9E3779B97F4A7C15) + word.astype("u8")
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Block:
    """The words of a block's texts and, per kind, its sorted distinct keys, their counts and each word's place there."""

    def __init__(self, blocks: pa.Table, targets: np.ndarray):
        number, self.doc_ids, sizes, words, numbers = (c.to_pylist()[0] for c in blocks.columns)
        self.number, self.sizes = number, np.array(sizes, "i8")
        self.targets = np.zeros(len(sizes), bool)
        self.targets[targets] = True
        self.word = unpacked(numbers)
        self.before = np.r_[0, self.word][: len(self.word)]
        ends = np.cumsum(self.sizes)[self.sizes > 0]
        self.before[np.r_[0, ends[:-1]][: len(ends)]] = 0
        self.text = np.repeat(np.arange(len(self.sizes)), self.sizes)
        last = np.zeros(len(self.word), bool)
        last[ends - 1] = True
        hashes = np.r_[START, unpacked(words)]
        self.span = len(hashes)
        pairs, pair_at = np.unique(self.before * self.span + self.word, return_inverse=True)
        # Words are pairs with what no hash of a word is.
        self.kinds = [
            self._counted(pair_keys(hashes[pairs // self.span], hashes[pairs % self.span]), pair_at, np.zeros_like(last)),
            self._counted(pair_keys(np.full(self.span - 1, -2), hashes[1:]), self.word - 1, last),
        ]

    def _counted(self, keys: np.ndarray, at: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        order = np.argsort(keys)
        place = np.empty(len(keys), "i8")
        place[order] = np.arange(len(keys))
        at, target = place[at], self.targets[self.text]
        return keys[order], [np.bincount(at[x], minlength=len(keys)) for x in (slice(None), target, last, last & target)], at


def _counts(bits: int):
    """A block's counts, a row per kind and range; a range is the first ``bits`` bits of a key."""

    def run(blocks: pa.Table, targets: pa.Table) -> pa.Table:
        block, made = Block(blocks, targets.column("range").to_numpy()), []
        for kind, (keys, counts, _) in enumerate(block.kinds):
            ranges = keys >> np.uint64(1) >> np.uint64(63 - bits)
            starts = np.flatnonzero(np.r_[True, ranges[1:] != ranges[:-1]][: len(keys)])
            for a, b in zip(starts, np.r_[starts[1:], len(keys)]):
                steps = np.diff(keys[a:b], prepend=np.uint64(0)).view("i8")
                made.append((block.number, kind, int(ranges[a]), packed(steps), *(packed(n[a:b]) for n in counts)))
        return pa.Table.from_batches([_batch(made, COUNTED)])

    return run


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64()}
    kinds = [types[c.split()[1]] for c in schema.split(", ")]
    columns = zip(*rows) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names(schema))


def _others(table: pa.Table) -> pa.Table:
    """For each block's keys of a range and kind the counts of all other blocks; ``fresh`` adds up to the distinct keys."""
    blocks, kinds, ranges, *data = (c.to_pylist() for c in table.columns)
    keys = [np.cumsum(unpacked(x).view("u8")) for x in data[0]]
    distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
    ends = np.cumsum([len(k) for k in keys])
    rest = []
    for packs in data[1:]:
        own = np.concatenate([unpacked(x) for x in packs])
        total = np.zeros(len(distinct), "i8")
        np.add.at(total, place, own)
        rest.append([packed(x) for x in np.split(total[place] - own, ends[:-1])])
    fresh = [len(distinct), *[0] * (len(keys) - 1)]
    return pa.Table.from_batches([_batch(list(zip(blocks, kinds, ranges, *rest, fresh)), OTHERS)])


def summed(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each element the sum of ``n`` over all elements equal to it."""
    _, place = np.unique(x, return_inverse=True)
    return np.bincount(place, n).astype("i8")[place] if len(x) else place


def _scores(totals: tuple[int, int], begun: tuple[int, int], types: int):
    """Texts of a block with their mean losses, from the block and what the other blocks counted.

    ``totals`` and ``begun`` are the words and the texts with a word of all and of the target documents.
    """

    def run(blocks: pa.Table, others: pa.Table) -> pa.Table:
        _, kinds, ranges, *rest = (c.to_pylist() for c in others.columns[:7])
        order = sorted(range(len(kinds)), key=lambda i: (kinds[i], ranges[i]))
        block = Block(blocks, np.array([r for k, r in zip(kinds, ranges) if k == TARGET], "i8"))
        counts = []
        for kind, (_, own, _) in enumerate(block.kinds):
            mine, none = [i for i in order if kinds[i] == kind], np.zeros(0, "i8")
            counts.append([x + np.concatenate([none, *(unpacked(r[i]) for i in mine)]) for x, r in zip(own, rest)])
        # By a word's number, 0 before a text, how many pairs begin with it.
        at = np.zeros(block.span - 1, "i8")
        at[block.word - 1] = block.kinds[WORD][2]
        begins = [np.r_[b, (n - last)[at]] for b, n, last in zip(begun, counts[WORD][:2], counts[WORD][2:])]
        # Distinct pairs of each text, by the place where each stands first.
        many = max(len(block.kinds[PAIR][0]), 1)
        _, first, times = np.unique(block.text * many + block.kinds[PAIR][2], return_index=True, return_counts=True)
        t = block.text[first]
        own_word, own_before = (summed(t * block.span + x[first], times) for x in (block.word, block.before))
        pair, word = (block.kinds[k][2][first] for k in (PAIR, WORD))
        losses = []
        for model, learned in ((1, block.targets[t]), (0, np.ones(len(t), bool))):
            total = totals[model] - block.sizes[t] * learned + types
            p = STRENGTH * (counts[WORD][model][word] - own_word * learned + 1) / total
            p += counts[PAIR][model][pair] - times * learned
            loss = -times * np.log(p / (begins[model][block.before[first]] - own_before * learned + STRENGTH))
            losses.append(np.bincount(t, loss, len(block.sizes)) / np.maximum(block.sizes, 1))
        none = block.sizes == 0
        made = [pa.array(block.doc_ids, pa.int64()), pa.array(block.sizes), *(pa.array(x, pa.float64(), mask=none) for x in losses)]
        return pa.Table.from_arrays(made, names(SCORED))

    return run


def bucketed(blocks: DataFrame) -> DataFrame:
    """The blocks written by their bucket: joins on ``block`` do not move them.

    A name in the catalog is needed for writing only; the files stay in the shared folder.
    """
    spark = blocks.sparkSession
    path = shared_path(spark, "lm-blocks")
    name = path.rsplit("/", 1)[1].replace("-", "_")
    n = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 10_000)
    blocks.write.bucketBy(n, "block").option("path", path).saveAsTable(name)
    try:
        return spark.table(name)
    finally:
        spark.sql(f"DROP TABLE {name}")


def cross_entropy_difference(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """Scores of all documents; ``targets`` has the doc_id of each target document."""
    chosen = targets.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id IS NOT NULL").distinct()
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    blocks = bucketed(rows.mapInArrow(_blocks, BLOCKS).withColumn("block", F.monotonically_increasing_id()))
    blocks = blocks.select("block", "doc_ids", "sizes", "words", "numbers")
    places = blocks.select("block", F.posexplode("doc_ids").alias("range", "doc_id"), "sizes")
    places = places.select("block", "range", "doc_id", F.expr("sizes[range]").alias("size"))
    # Target documents grow with the corpus: never broadcast.
    flags = places.join(chosen.withColumn("target", F.lit(True)).hint("merge"), "doc_id", "left")
    flags = written(flags.select("block", F.col("range").cast("long"), "size", F.col("target").isNotNull().alias("target")), "lm-flags")
    sums = [F.coalesce(F.sum(x), F.lit(0)) for x in (F.col("size"), (F.col("size") > 0).cast("long"))]
    n, texts = flags.agg(*sums).first()
    n_target, texts_target = flags.filter("target").agg(*sums).first()
    flags = flags.filter("target").select("block", F.lit(TARGET).alias("kind"), "range")
    counted = blocks.groupBy("block").cogroup(flags.groupBy("block")).applyInArrow(_counts((n // RANGE).bit_length()), COUNTED)
    others = written(counted.groupBy("range", "kind").applyInArrow(_others, OTHERS), "lm-others")
    types = others.filter(F.col("kind") == WORD).agg(F.coalesce(F.sum("fresh"), F.lit(0))).first()[0] + 1
    met = blocks.groupBy("block").cogroup(others.unionByName(flags, allowMissingColumns=True).groupBy("block"))
    scored = met.applyInArrow(_scores((n, n_target), (texts, texts_target), types), SCORED)
    return scored.withColumn("score", F.col("ce_target") - F.col("ce_background"))


def op5_lm_scoring(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1")
    return cross_entropy_difference(docs, labels)
