"""Spelling variants: words one edit apart, each pointing at a much more frequent near word.

Pairs of near words are the language of A o T o A: A accepts the vocabulary, T rewrites a word by exactly one inserted,
deleted or replaced character. The composed machine is cut by its initial states: a state is the shorter length ``m`` of a
pair, an interval ``[a, b]`` that holds the place of the edit (the length of the longest common prefix), and the characters
that both words must then share, the first ``a`` and the last ``m - 1 - b``. A word belongs to two states for each length it
may be paired with, the edit in the first or in the second half. States with more than ``LIMIT`` characters of words are cut
again by halving their interval, down to a single place, so no state is large and each pair belongs to exactly one state.

The words of some states at a time are made an acceptor by a task, sorted, merged into a trie and minimised from the leaves
upwards. The composition is enumerated breadth first on arrays: along the diagonal the two copies of A read the same, at a
place in the interval T edits, and from there on both copies must read the same until both accept. T is unambiguous: an edit
happens at the first place where the words differ. A state of the acceptor knows how many words it accepts, so an accepted
path is the number of a word. What leaves the task are sums per word, not pairs.

Defined cases: null and empty texts have no words; a null doc_id is written as nothing in the hash; a row that repeats a
doc_id counts again; of equally frequent near words the first in code-point order is taken; words have any length, and very
long texts are cut into runs some at a time; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velum.llm.common import split_bytes
from velum.sources.sinks import written

MIN_CHARS, MIN_COUNT, FACTOR, DAMAGED = 5, 3, 2, 97
#: Distinct words that a task holds before it hands them on, and characters it cuts into runs at once.
HELD, PIECE = 1_000_000, 1 << 20
#: Characters of the words of one state, of the states taken at once, and composed states stepped at once.
LIMIT, CHUNK, STEP = 1 << 21, 1 << 21, 1 << 20
COUNTS = "w binary, n long"
KEYED = "key binary, w binary, n long"
NEAR = "w binary, n_near long, best_n long, best binary"

# In Latin-1, where a byte is a code point: letters of the runs, A-Z in lower case, everything else parts them.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and their occurrences; a word is its Latin-1 bytes."""
    held: Counter = Counter()

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["w", "n"])

    for given in batches:
        for doc_id, text in zip(*(c.to_pylist() for c in given.columns)):
            start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
            for runs in split_bytes((text or "").encode("latin-1", "replace").translate(_FOLD), PIECE):
                for run, n in Counter(runs).items():
                    if len(run) < MIN_CHARS:
                        continue
                    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
                    if h % DAMAGED == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1 :]
                        if len(run) < MIN_CHARS:
                            continue
                    held[run] += n
            if len(held) > HELD:
                yield batch()
                held = Counter()
    if held:
        yield batch()


def vocabulary(docs: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """``(w, n)``: the words of all documents and how often they occur."""
    counted = docs.select(F.col("doc_id").cast("string"), "text").mapInArrow(_counts, COUNTS)
    return counted.groupBy("w").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


# ---- initial states ------------------------------------------------------------------------------------


def state_key(word: bytes, m: int, a: int, b: int) -> bytes:
    """The initial state of a word: pairs of shorter length ``m`` whose edit is at a place from ``a`` to ``b``."""
    rest = max(m - 1 - b, 0)
    return b"".join(x.to_bytes(4) for x in (m, a, b)) + word[:a] + word[len(word) - rest :]


def read_key(key: bytes) -> tuple[int, int, int]:
    return tuple(int.from_bytes(key[i : i + 4]) for i in (0, 4, 8))


def halves(a: int, b: int) -> list[tuple[int, int]]:
    middle = (a + b + 1) // 2
    return [(a, middle - 1), (middle, b)]


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words with their initial states; rows that already have one, a large one, get the halves of it."""
    for batch in batches:
        keys, words, counts = [], [], []
        given = [c.to_pylist() for c in batch.columns]
        for w, n, key in zip(*given) if len(given) == 3 else ((w, n, None) for w, n in zip(*given)):
            lengths = [(m, 0, m) for m in (len(w), len(w) - 1) if m >= MIN_CHARS] if key is None else [read_key(key)]
            for m, a, b in lengths:
                for half in halves(a, b):
                    keys.append(state_key(w, m, *half))
                    words.append(w)
                    counts.append(n)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(words, pa.binary()), pa.array(counts, pa.int64())], ["key", "w", "n"])


def by_state(words: DataFrame, limit: int) -> DataFrame:
    """Words by initial state, ``(key, w, n)``; no state that can be cut has more than ``limit`` characters."""
    done, rows = [], words.select("w", "n")
    while True:
        keyed = written(rows.mapInArrow(_keyed, KEYED), "spelling-states")
        size = keyed.groupBy("key").agg(F.sum(F.length("w")).alias("size"), F.count("*").alias("words"))
        one_place = F.substring("key", 5, 4) == F.substring("key", 9, 4)
        large = written(size.filter((F.col("size") > limit) & ~one_place).select("key"), "spelling-large")
        if large.isEmpty():
            done.append(keyed)
            break
        # At most one key per ``limit`` characters: the planner sends them to the rows, or shuffles and splits hot keys.
        done.append(keyed.join(large, "key", "left_anti"))
        rows = keyed.join(large, "key", "left_semi").select("w", "n", "key")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


# ---- the acceptor --------------------------------------------------------------------------------------


def spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ``counts[i]`` copies of each i: the i of every copy and its number among them."""
    of = np.repeat(np.arange(len(counts)), counts)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)


class Acceptor:
    """Minimal automaton of sorted words; each group of words has an initial state of its own.

    Edges are sorted by state and symbol. ``skip`` of an edge is the number of words of its state that come before those
    behind the edge, so the sum along a path is a word's number in its group.
    """

    def __init__(self, words: np.ndarray, lengths: np.ndarray, group: np.ndarray):
        width = words.dtype.itemsize
        cells = words.view(np.uint8).reshape(len(words), width)
        lcp = np.zeros(len(words), "i8")
        equal = np.cumprod(cells[1:] == cells[:-1], axis=1).sum(axis=1)
        lcp[1:] = np.where(group[1:] == group[:-1], np.minimum(equal, np.minimum(lengths[1:], lengths[:-1])), 0)
        groups = group[-1] + 1
        row, step = spread(lengths - lcp)
        depth, node = lcp[row] + step + 1, groups + np.arange(len(row))
        path = np.zeros((len(words), width + 1), "i4")
        path[:, 0] = group
        path[row, depth] = node
        np.maximum.accumulate(path[:, 1:], axis=0, out=path[:, 1:])
        parent, symbol = path[row, depth - 1].astype("i8"), cells[row, depth - 1].astype("i8")
        total = groups + len(row)
        final = np.zeros(total, bool)
        final[path[np.arange(len(words)), lengths]] = True
        height = np.zeros(total, "i4")
        by_depth = np.argsort(depth, kind="stable")
        for at in np.split(by_depth, np.cumsum(np.bincount(depth)))[::-1]:
            np.maximum.at(height, parent[at], height[node[at]] + 1)
        order = np.argsort(parent, kind="stable")
        symbol, child = symbol[order], node[order]
        degree = np.bincount(parent, minlength=total)
        first = np.cumsum(degree) - degree
        self._minimise(final, height, degree, first, symbol, child)
        self.roots = self.state[:groups]

    def _minimise(self, final, height, degree, first, symbol, child):
        """States with equal right languages become one, from the leaves upwards."""
        self.state = np.zeros(len(final), "i8")
        made, finals, sizes = 0, [], np.zeros(0, "i8")
        parts = {"source": [], "symbol": [], "target": [], "skip": []}
        by_height = np.argsort(height, kind="stable")
        for nodes in np.split(by_height, np.cumsum(np.bincount(height))[:-1]):
            sign, k = final[nodes].astype("i8"), degree[nodes]
            for j in range(k.max(initial=0)):
                on = np.flatnonzero(k > j)
                edge = first[nodes[on]] + j
                code = (sign[on] * 256 + symbol[edge]) * (made + 1) + self.state[child[edge]]
                sign[on] = sign.max() + 1 + np.unique(code, return_inverse=True)[1]
            _, which, same = np.unique(sign, return_index=True, return_inverse=True)
            self.state[nodes] = made + same
            kept = nodes[which]
            of, j = spread(degree[kept])
            edge = first[kept][of] + j
            target = self.state[child[edge]]
            behind = sizes[target] if len(target) else np.zeros(0, "i8")
            before = np.cumsum(behind) - behind
            own = final[kept].astype("i8")
            begin = np.cumsum(degree[kept]) - degree[kept]
            skip = before - (before[begin[of]] if len(of) else 0) + own[of]
            parts["source"].append(made + of)
            parts["symbol"].append(symbol[edge])
            parts["target"].append(target)
            parts["skip"].append(skip)
            finals.append(final[kept])
            sizes = np.concatenate([sizes, own + np.bincount(of, behind, len(kept)).astype("i8")])
            made += len(kept)
        self.source, self.symbol, self.target, self.skip = (np.concatenate(parts[c]) for c in ("source", "symbol", "target", "skip"))
        self.final = np.concatenate(finals)
        self.degree = np.bincount(self.source, minlength=made)
        self.first = np.cumsum(self.degree) - self.degree
        self.edge_key = self.source * 256 + self.symbol

    def edges(self, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All edges of the states: the place of the state each belongs to, and the edge."""
        of, j = spread(self.degree[state])
        return of, self.first[state][of] + j


# ---- the composition -----------------------------------------------------------------------------------


def _edited(acceptor: Acceptor, state: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Composed states after one edit at a diagonal state: rows ``state, word, state, word, forbidden symbol``.

    A replacement reads two different symbols; one copy alone reads a symbol that the other must not read next.
    """
    of, edge = acceptor.edges(state)
    later = acceptor.first[state[of]] + acceptor.degree[state[of]] - edge - 1
    one, j = spread(later)
    two = edge[one] + 1 + j
    moved = [acceptor.target[edge], word[of] + acceptor.skip[edge]]
    replaced = [moved[0][one], moved[1][one], acceptor.target[two], word[of[one]] + acceptor.skip[two], np.zeros(len(one), "i8")]
    read = [*moved, state[of], word[of], acceptor.symbol[edge]]
    return np.concatenate([np.array(replaced), np.array(read)], axis=1)


def _stepped(acceptor: Acceptor, block: np.ndarray) -> np.ndarray:
    """Both copies read the same symbol."""
    swap = acceptor.degree[block[0]] > acceptor.degree[block[2]]
    few, few_word = np.where(swap, block[2], block[0]), np.where(swap, block[3], block[1])
    many, many_word = np.where(swap, block[0], block[2]), np.where(swap, block[1], block[3])
    of, edge = acceptor.edges(few)
    allowed = acceptor.symbol[edge] != block[4][of]
    of, edge = of[allowed], edge[allowed]
    wanted = many[of] * 256 + acceptor.symbol[edge]
    other = np.minimum(np.searchsorted(acceptor.edge_key, wanted), len(acceptor.edge_key) - 1)
    there = acceptor.edge_key[other] == wanted
    of, edge, other = of[there], edge[there], other[there]
    return np.array(
        [
            acceptor.target[edge], few_word[of] + acceptor.skip[edge],
            acceptor.target[other], many_word[of] + acceptor.skip[other], np.zeros(len(of), "i8"),
        ]
    )


def accepted_pairs(acceptor: Acceptor, starts: np.ndarray, low: np.ndarray, high: np.ndarray, step: int):
    """Numbers of the words of all accepted pairs, some at a time; the edit is at a place from ``low`` to ``high``."""
    waiting = [(0, acceptor.roots, starts, np.arange(len(starts)))]
    while waiting:
        depth, state, word, group = waiting.pop()
        k = acceptor.degree[state]
        cost = np.cumsum(k * (k + 1) // 2)
        if len(state) > 1 and cost[-1] > step:
            cut = min(max(int(np.searchsorted(cost, cost[-1] // 2)), 1), len(state) - 1)
            waiting += [(depth, state[s], word[s], group[s]) for s in (slice(cut), slice(cut, None))]
            continue
        here = low[group] <= depth
        blocks = [_edited(acceptor, state[here], word[here])]
        while blocks:
            block = blocks.pop()
            if block.shape[1] > step:
                half = block.shape[1] // 2
                blocks += [block[:, :half], block[:, half:]]
                continue
            both = acceptor.final[block[0]] & acceptor.final[block[2]]
            if both.any():
                yield block[1][both], block[3][both]
            block = _stepped(acceptor, block)
            if block.shape[1]:
                blocks.append(block)
        on = high[group] > depth
        of, edge = acceptor.edges(state[on])
        if len(of):
            waiting.append((depth + 1, acceptor.target[edge], word[on][of] + acceptor.skip[edge], group[on][of]))


def near_words(keys: list[bytes], words: list[bytes], counts: np.ndarray, step: int) -> pa.RecordBatch | None:
    """Near words within each state, summed up per word; rows are sorted by key and word."""
    new = np.array([True] + [x != y for x, y in zip(keys[1:], keys)])
    group = np.cumsum(new) - 1
    several = np.bincount(group)[group] > 1
    if not several.any():
        return None
    at = np.flatnonzero(several)
    words, counts = [words[i] for i in at], counts[at]
    _, starts, group = np.unique(group[at], return_index=True, return_inverse=True)
    m, low, high = (np.array(x) for x in zip(*(read_key(keys[at[i]]) for i in starts)))
    lengths = np.array([len(w) for w in words])
    acceptor = Acceptor(np.array(words, dtype=f"S{lengths.max()}"), lengths, group)
    rank = np.empty(len(words), "i8")  # more frequent first, then the earlier word
    by_rank = np.lexsort((np.arange(len(words)), -counts))
    rank[by_rank] = np.arange(len(words))
    near, best = np.zeros(len(words), "i8"), np.full(len(words), len(words), "i8")
    for x, y in accepted_pairs(acceptor, starts, low, high, step):
        mine = np.minimum(lengths[x], lengths[y]) == m[group[x]]
        x, y = x[mine], y[mine]
        for i, j in ((x, y), (y, x)):
            near += np.bincount(i, minlength=len(words))
            np.minimum.at(best, i, rank[j])
    found = np.flatnonzero(near)
    chosen = by_rank[best[found]]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([words[i] for i in found], pa.binary()), pa.array(near[found]), pa.array(counts[chosen]),
            pa.array([words[i] for i in chosen], pa.binary()),
        ],
        ["w", "n_near", "best_n", "best"],
    )


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key and word: whole states are taken together until they have ``CHUNK`` characters."""
    keys, words, counts, border, size = [], [], [], 0, 0
    for batch in batches:
        for key, w, n in zip(*(batch.column(c).to_pylist() for c in ("key", "w", "n"))):
            if keys and key != keys[-1]:
                # The words are laid out in equal width, and states are sorted by length.
                width = int.from_bytes(keys[-1][:4]) + 1
                if width * len(keys) > CHUNK:
                    if (out := near_words(keys, words, np.array(counts), STEP)) is not None:
                        yield out
                    keys, words, counts = [], [], []
            keys.append(key)
            words.append(w)
            counts.append(n)
    if keys and (out := near_words(keys, words, np.array(counts), STEP)) is not None:
        yield out


def roots(forms: DataFrame) -> DataFrame:
    """``(w, root)`` of words with a form: forms are followed by doubling the steps until none leads further.

    A form is at least twice as frequent as its word, so there are no circles and few rounds.
    """
    at = written(forms.select("w", F.col("form").alias("root"), F.lit(True).alias("moved")), "spelling-roots")
    while not at.filter("moved").isEmpty():
        onward = at.select(F.col("w").alias("_w"), F.col("root").alias("_root"))
        at = written(
            at.join(onward, F.col("root") == F.col("_w"), "left").select(
                "w", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("moved")
            ),
            "spelling-roots",
        )
    return at.select("w", "root")


def spelling_variants(docs: DataFrame, min_count: int = MIN_COUNT, factor: int = FACTOR) -> DataFrame:
    """Every word with its near words counted, the form it is a variant of, and the root it leads to."""
    words = written(vocabulary(docs, min_count), "spelling-words")
    states = by_state(words, LIMIT).repartition("key").sortWithinPartitions("key", "w")
    summed = (
        states.mapInArrow(_near, NEAR)
        .groupBy("w")
        .agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("less"), "best")).alias("first"))
    )
    is_form = -F.col("first.less") >= factor * F.col("n")
    found = written(
        words.join(summed, "w", "left").select(
            "w",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(is_form, F.col("first.best")).alias("form"),
            F.when(is_form, -F.col("first.less")).alias("form_n"),
        ),
        "spelling-forms",
    )
    text = lambda c: F.decode(c, "ISO-8859-1")
    return found.join(roots(found.filter("form IS NOT NULL")), "w", "left").select(
        text("w").alias("word"), text("form").alias("form"), text(F.coalesce("root", "w")).alias("root"), "n", "n_near", "form_n"
    )


def op12_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return spelling_variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))
