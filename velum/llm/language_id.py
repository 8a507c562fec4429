"""Language identification with a string kernel.

A text is the set of its letter n-grams (n = 1 to 3, letters in lower case, other characters as one space), hashed to
``2 ** BITS`` places. The kernel of two texts is the number of n-grams they share over the geometric mean of their own
numbers: a blended-spectrum presence kernel. A few training texts are the Nystrom landmarks; kernels to the landmarks,
whitened by the landmarks' own kernel matrix, are the features of a one-versus-rest kernel ridge regression.

The classifier is fitted on the driver from a bounded sample, ``TRAIN`` texts at most, the same number for each language,
chosen by a hash of the doc_id. What reaches the driver are sets of fixed size, however long the texts are. Prediction is
one pass over all whole texts: batches of presence rows times the landmark matrix, times the dual weights.

Defined cases: a null text, or one without a letter, is ``und`` with score 0, as is every text if nothing can be learned;
rows without doc_id are predicted but never learned from; repeated rows are predicted each; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from velum.sources.sinks import written

ORDERS, BITS = (1, 2, 3), 15
#: Training texts of all languages together, and of one; landmarks; ridge; texts scored at once.
TRAIN, PER_LANGUAGE, LANDMARKS, RIDGE, BATCH = 2400, 400, 128, 1e-2, 64
UNKNOWN = "und"
OTHER = re.compile(r"[\W\d_]+")


def gram_places(text: str) -> np.ndarray:
    """Places of the text's n-grams, some of them several times."""
    letters = f" {OTHER.sub(' ', text.lower()).strip()} "
    code = np.frombuffer(letters.encode("utf-32-le", "surrogatepass"), "<u4").astype("u8")
    out = []
    for n in ORDERS:
        if len(code) >= n:
            size = len(code) - n + 1
            h = np.full(size, n, "u8")
            for i in range(n):
                h = (h ^ code[i : i + size]) * np.uint64(0x9E3779B97F4A7C15)
            out.append((h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - BITS))
    return np.concatenate(out).astype("i8")


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def presence(texts: list[str]) -> np.ndarray:
    """A row of zeros and ones for each text."""
    rows = np.zeros((len(texts), 1 << BITS), "f4")
    for row, text in zip(rows, texts):
        row[gram_places(text)] = 1
    return rows


@dataclass
class Model:
    languages: list[str]
    landmarks: np.ndarray  # packed bits
    weights: np.ndarray  # landmarks x languages
    bias: np.ndarray

    def matrix(self) -> np.ndarray:
        rows = np.unpackbits(self.landmarks, axis=1).astype("f4")
        return np.ascontiguousarray((rows / np.sqrt(rows.sum(axis=1, keepdims=True))).T)


def kernel(rows: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    return (rows @ matrix) / np.sqrt(np.maximum(rows.sum(axis=1, keepdims=True), 1))


def fit(labels: list[str], packed: np.ndarray) -> Model:
    """The classifier for presence rows ``packed`` as bits; rows must come in a fixed order."""
    languages = sorted(set(labels))
    y = np.array([languages.index(x) for x in labels])
    # Landmarks: taken from the languages in turn.
    turn = np.empty(len(y), "i8")
    for c in range(len(languages)):
        turn[y == c] = np.arange((y == c).sum())
    chosen = np.lexsort((y, turn))[:LANDMARKS]
    model = Model(languages, packed[chosen], np.empty(0), np.empty(0))
    matrix = model.matrix()
    k = np.concatenate([kernel(np.unpackbits(packed[a : a + 256], axis=1).astype("f4"), matrix) for a in range(0, len(y), 256)])
    values, vectors = np.linalg.eigh(k[chosen].astype("f8"))
    good = values > 1e-6 * values.max()
    whiten = vectors[:, good] / np.sqrt(values[good])
    features = np.c_[k @ whiten, np.ones(len(y))]
    weight = 1 / np.bincount(y)[y]  # each language counts the same
    targets = np.where(y[:, None] == np.arange(len(languages)), 1.0, -1.0)
    ridge = RIDGE * np.eye(features.shape[1])
    ridge[-1, -1] = 1e-9
    solved = np.linalg.solve((features * weight[:, None]).T @ features + ridge, (features * weight[:, None]).T @ targets)
    model.weights, model.bias = whiten @ solved[:-1], solved[-1]
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [np.packbits(presence([t.as_py()])[0].astype(bool)).tobytes() for t in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.binary())], ["lang", "at", "bits"])


def training_sample(docs: DataFrame) -> DataFrame:
    """``(lang, at, bits)`` of at most ``TRAIN`` texts; ``at`` is their order."""
    usable = docs.filter(
        F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")
    ).withColumn("at", F.xxhash64("doc_id", "text"))
    # Rows that repeat both id and text are one sample.
    keys = written(usable.select("lang", "at").distinct(), "language-keys")
    counts = {r["lang"]: r["count"] for r in keys.groupBy("lang").count().collect()}  # a row per language
    if not counts:
        return usable.limit(0).select("lang", "at", F.lit(b"").alias("bits"))
    each = max(1, min(PER_LANGUAGE, TRAIN // len(counts)))
    # The lowest hashes are wanted: below twice the share that should do, only few rows are left to be ranked. Where chance
    # leaves too few, the share is raised until there are enough.
    share = {x: 2 * each / n for x, n in counts.items()}
    while True:
        bound = [F.lit(v) for x, y in share.items() for v in (x, int(min(2**63 - 1, -(2**63) + 2**64 * y)))]
        near = keys.filter(F.col("at") <= F.create_map(*bound)[F.col("lang")])
        found = {r["lang"]: r["count"] for r in near.groupBy("lang").count().collect()}
        short = [x for x, n in counts.items() if found.get(x, 0) < min(each, n)]
        if not short:
            break
        share |= {x: 4 * share[x] for x in short}
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("at")))
    last = ranked.filter(F.col("rank") <= each).groupBy("lang").agg(F.max("at").alias("last")).collect()
    upto = F.create_map(*[F.lit(x) for row in last for x in (row["lang"], row["last"])])
    chosen = usable.filter(F.col("at") <= upto[F.col("lang")]).select("lang", "at", "text").dropDuplicates(["lang", "at"])
    return chosen.mapInArrow(_packed, "lang string, at long, bits binary")


def learn(docs: DataFrame) -> Model | None:
    rows = training_sample(docs).collect()  # bounded: TRAIN rows of 2 ** BITS bits
    if not rows:
        return None
    rows.sort(key=lambda r: (r["lang"], r["at"]))
    packed = np.stack([np.frombuffer(r["bits"], "u1") for r in rows])
    return fit([r["lang"] for r in rows], packed)


def predictor(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model | None = model.value
        matrix = None if m is None else m.matrix()
        for batch in batches:
            n = batch.num_rows
            lang, score = [UNKNOWN] * n, np.zeros(n)
            waiting: list[tuple[int, str]] = []

            def flush():
                f = kernel(presence([t for _, t in waiting]), matrix) @ m.weights + m.bias
                for (i, _), c, v in zip(waiting, f.argmax(axis=1), f.max(axis=1)):
                    lang[i], score[i] = m.languages[c], min(1.0, max(0.0, (v + 1) / 2))
                waiting.clear()

            if m is not None:
                for i, text in enumerate(batch.column(2)):
                    text = text.as_py()
                    if has_letter(text):
                        waiting.append((i, text))
                        if len(waiting) == BATCH:
                            flush()
                if waiting:
                    flush()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score)],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    return run


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` for every row; only the text is used."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # landmarks and weights, half a megabyte
    rows = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(predictor(shared), "doc_id long, held_out boolean, lang_pred string, score double")


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return identify(docs, learn(docs))
