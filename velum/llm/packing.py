"""Best-fit packing of token sequences by patterns of lengths.

Documents become pieces of at most ``size`` tokens; only a longer document is cut, its first piece being the shorter one.
All that packing needs is how many pieces there are of each length: at most ``size`` numbers, whatever the input. On that
histogram the driver enumerates all patterns of two or three lengths that fill a sequence exactly, fits their repeat counts
by non-negative least squares, rounds them down, and packs what remains by best fit from the longest down, again for all
pieces of a length at once. The plan is a list of runs: the pieces of a length with ranks from ``first`` on go to sequences
from ``base`` on. Each piece finds its run by its rank; ranks within a length are counted in parts
(:func:`velum.llm.common.rank_within`), so no length is too frequent for one task.

Ids are those of the ``tokenizers`` file. The same vocabulary in its rank form gives the same ids several times faster
(``tests/llm`` compares them); a text that holds a special token's string, or that the fast encoder refuses, goes through
``tokenizers`` itself.

Defined cases: a null text is empty and is the one end token; rows that repeat a doc_id are packed each; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from velum.llm.common import rank_within
from velum.sources.sinks import written

SIZE, END = 1024, 2
TOKENIZER, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
PIECE_SCHEMA = "doc_id long, text_key long, piece int, start long, length long, ids_crc32 long"
PLACED = T.StructType([T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
STEPS, EMPHASIS = 400, (0.0, 1.0)


class Encoder:
    """Token ids of a text; made once per task."""

    def __init__(self, tokenizer: str, ranks: str):
        import tiktoken

        with open(ranks, "rb") as lines:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding(
            "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={}
        )
        self.tokenizer, self.exact, self.special = tokenizer, None, None

    def slow(self):
        if self.exact is None:
            from tokenizers import Tokenizer

            self.exact = Tokenizer.from_file(self.tokenizer)
        return self.exact

    def __call__(self, text: str) -> list[int]:
        if self.special is None:
            self.special = [t.content for t in self.slow().get_added_tokens_decoder().values()]
        if not any(s in text for s in self.special):
            try:
                return self.fast.encode_ordinary(text)
            except Exception:  # noqa: BLE001  a text its pattern engine gives up on
                pass
        return self.slow().encode(text, add_special_tokens=False).ids


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """Start and length of each piece of ``n`` tokens; all but the first are full."""
    first = n if n <= size else n % size or size
    return [(0, first), *[(a, size) for a in range(first, n, size)]]


def tokenize(size: int, tokenizer: str, ranks: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(tokenizer, ranks)
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            ids, keys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, text in enumerate(batch.column(2)):
                tokens = np.array([*encode(text.as_py() or ""), END], "<u4")
                for piece, (start, length) in enumerate(cut(len(tokens), size)):
                    crc = zlib.crc32(tokens[start : start + length].tobytes())
                    for column, x in zip(out, (ids[i], keys[i], piece, start, length, crc)):
                        column.append(x)
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, types)],
                ["doc_id", "text_key", "piece", "start", "length", "ids_crc32"],
            )

    return run


def patterns(lengths: np.ndarray, size: int) -> np.ndarray:
    """All pairs and triples of the given lengths that sum up to ``size``, ascending; a pair has 0 in front."""
    there = np.zeros(size + 1, bool)
    there[lengths] = True
    there[0] = True
    a, b = np.meshgrid(np.flatnonzero(there), np.flatnonzero(there), indexing="ij")
    c = size - a - b
    good = (a <= b) & (b <= c) & (b > 0) & (c < size)
    a, b, c = a[good], b[good], c[good]
    return np.stack([a, b, c], axis=1)[there[c]]


def fit(counts: np.ndarray, found: np.ndarray, emphasis: float, steps: int = STEPS) -> np.ndarray:
    """Repeat counts ``x >= 0`` of the patterns nearest to the counts in least squares, by accelerated projected gradients.

    ``emphasis`` makes long pieces weigh more: what is left of short ones fills gaps more easily.
    """
    weight = (np.arange(len(counts)) / len(counts)) ** emphasis / np.sqrt(np.maximum(counts, 1.0))
    weight[0] = 0
    scaled = counts * weight
    n = len(counts)

    def lengths_of(x):
        return np.bincount(found.ravel(), np.repeat(x, 3), n) * weight

    def patterns_of(r):
        return (r * weight)[found].sum(axis=1)

    # Columns are scaled to the same length, so one step size suits all.
    norm = np.sqrt((weight[found] ** 2).sum(axis=1)) + 1e-12
    probe = np.ones(len(found))
    for _ in range(30):
        probe = patterns_of(lengths_of(probe / norm)) / norm
        bound = np.linalg.norm(probe)
        probe /= bound
    x = y = np.zeros(len(found))
    t = 1.0
    for _ in range(steps):
        gradient = patterns_of(lengths_of(y / norm) - scaled) / norm
        new = np.maximum(y - gradient / (1.05 * bound), 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x / norm


def best_fit(left: np.ndarray, size: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Best fit from the longest down; sequences with the same content are handled as one entry with a count."""
    room: dict[int, list] = {}  # free tokens -> [(content, count)]
    for length in range(size, 0, -1):
        n = int(left[length])
        while n:
            free = min((r for r in room if r >= length), default=None)
            if free is None:
                each = size // length
                for times, new in ((each, n // each), (n % each, 1)):
                    if times and new:
                        room.setdefault(size - times * length, []).append(([(length, times)], new))
                break
            content, count = room[free].pop()
            each = min(free // length, n)
            take = min(count, n // each)
            if take < count:
                room[free].append((content, count - take))
            if not room[free]:
                del room[free]
            room.setdefault(free - each * length, []).append(([*content, (length, each)], take))
            n -= take * each
    return [x for entries in room.values() for x in entries]


def fitted_plan(counts: np.ndarray, size: int, emphasis: float) -> list[tuple[list[tuple[int, int]], int]]:
    left = counts.copy()
    out = []
    found = patterns(np.flatnonzero(counts[:size]), size)
    if len(found):
        x = fit(counts[: size + 1].astype("f8"), found, emphasis)
        whole = np.floor(x + 1e-6).astype("i8")
        for p in np.argsort(-whole, kind="stable"):
            if not whole[p]:
                break
            length, times = np.unique(found[p][found[p] > 0], return_counts=True)
            n = int(min(whole[p], (left[length] // times).min()))
            if n > 0:
                left[length] -= n * times
                out.append(([(int(a), int(b)) for a, b in zip(length, times)], n))
    return out + best_fit(left, size)


def plan(counts: np.ndarray, size: int = SIZE) -> list[tuple[list[tuple[int, int]], int]]:
    """Contents ``[(length, times), ...]`` of sequences and how often each is used; ``counts[l]`` pieces have length l.

    Fitted with all lengths alike and with long ones weighing more; the plan with fewer sequences is taken.
    """
    return min((fitted_plan(counts, size, e) for e in EMPHASIS), key=lambda done: sum(n for _, n in done))


def runs(sequences: list[tuple[list[tuple[int, int]], int]]) -> dict[str, np.ndarray]:
    """The plan by length and rank: key, first sequence, pieces per sequence and offset of each run, sorted by key."""
    used: dict[int, int] = {}
    rows, base = [], 0
    for content, n in sequences:
        offset = 0
        for length, times in content:
            first = used.get(length, 0)
            rows.append((length << 52 | first, base, times, offset))
            used[length] = first + n * times
            offset += length * times
        base += n
    table = np.array(sorted(rows), "i8").reshape(-1, 4)
    return {"key": table[:, 0], "base": table[:, 1], "times": table[:, 2], "offset": table[:, 3]}


def pack(docs: DataFrame, size: int = SIZE, tokenizer: str | None = None, ranks: str | None = None) -> DataFrame:
    """One row per piece with ``sequence_id`` and ``offset``; the paths name the tokenizer and its rank form."""
    tokenizer = tokenizer or public_tokenizers.path(TOKENIZER)
    ranks = ranks or public_tokenizers.path(RANKS)
    texts = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), "text")
    pieces = written(texts.mapInArrow(tokenize(size, tokenizer, ranks), PIECE_SCHEMA), "pieces")
    counts = np.zeros(size + 1, "i8")
    for length, n in pieces.groupBy("length").count().collect():  # at most ``size`` rows
        counts[length] = n
    places = runs(plan(counts, size))  # a few runs for each length

    @F.pandas_udf(PLACED)
    def placed(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        key = (length.to_numpy() << 52) | rank.to_numpy()
        run = np.searchsorted(places["key"], key, "right") - 1
        inside, times = key - places["key"][run], places["times"][run]
        return pd.DataFrame(
            {
                "sequence_id": places["base"][run] + inside // times,
                "offset": places["offset"][run] + inside % times * length.to_numpy(),
            }
        )

    order = ["doc_id", "text_key", "piece"]
    ranked = rank_within(pieces, ["length"], order)
    return ranked.withColumn("_placed", placed("length", "rank0")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "_placed.sequence_id", "_placed.offset"
    )


def op9_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
