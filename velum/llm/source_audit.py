"""Source divergence audit: how far the word use of each source is from every other one of its language.

Each language keeps the terms found in at least ``MIN_DOCS`` of its documents; a group is a source within a language. A
group's smoothed shares of all kept terms are one column over the language's vocabulary, and the distance of two groups is
the sum of absolute differences of their columns.

Columns are never written out term by term. The vocabulary is reordered so that terms with equal counts in the largest
groups are neighbours; along that order each column is run-length encoded, and a pair of columns is compared run by run:
the ends of both sets of runs are merged, and the difference on each common run is multiplied by its length.

The order is made by a range sort, cut into blocks of ``BLOCK`` terms; the sources of a language are dealt to tiles of
``TILE``. A task compares the columns of two tiles over one block, so neither a large vocabulary nor a language with very
many sources meets in one task; sums over the blocks are exact. All arithmetic is on integers.

Defined cases: null text, language and source are read as empty; rows that repeat a doc_id are documents of their own; a
language without kept terms has distances of 0; very long texts are counted in pieces of ``PIECE`` characters, cut between
terms; an empty table gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from velum.llm.common import rank_within, split_bytes
from velum.sources.sinks import written

MIN_DOCS, TOP_TERMS, PRIOR, SCALE = 30, 50, 5, 1_000_000_000
#: Terms of a block, sources of a tile, and largest groups whose counts order the vocabulary.
BLOCK, TILE, LEADING = 1 << 14, 32, 4
#: Distinct terms that a task holds before it hands them on, and characters it cuts into terms at once.
HELD, PIECE = 1_000_000, 1 << 20
COUNTS = "lang string, source string, term string, n long, docs long"
COLUMN = (
    "lang string, number long, tile long, n_tiles long, part int, block long, ends array<int>, shares array<long>"
)
DISTANCE = "lang string, a long, b long, value long"

# ASCII letters in lower case and all bytes of other characters stay, other ASCII characters part the terms.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term and group; each group also has one row without a term."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def batch():
        rows = [(*group, b"", 0, 0) for group in held]
        rows += [(*group, t, n, docs[t]) for group, (all_, docs) in held.items() for t, n in all_.items()]
        lang, source, term, n, docs = zip(*rows)
        columns = [pa.array(lang), pa.array(source), pa.array(term, pa.binary()).cast(pa.string()), pa.array(n), pa.array(docs)]
        return pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])

    size = 0
    for given in batches:
        for lang, source, text in zip(*(c.to_pylist() for c in given.columns)):
            if (lang, source) not in held:
                held[lang, source] = Counter(), Counter()
            all_, docs = held[lang, source]
            before, mine = len(all_), set()
            for words in split_bytes(text.encode().translate(_FOLD), PIECE):
                all_.update(words)
                mine.update(words)
            docs.update(mine)
            size += len(all_) - before
            if size > HELD:
                yield batch()
                held, size = {}, 0
    if held:
        yield batch()


def group_counts(docs: DataFrame) -> DataFrame:
    """``(lang, source, term, n, docs)`` over all documents; the term '' stands for the group itself."""
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    sums = [F.sum(c).alias(c) for c in ("n", "docs")]
    return rows.mapInArrow(_counts, COUNTS).groupBy("lang", "source", "term").agg(*sums)


def vocabulary(counts: DataFrame, groups: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """Kept terms in clustered order: ``(lang, term, total, part, block, slot)``.

    Terms are sorted by their counts in the largest groups of the language and by their total. ``part`` is a range of
    that order, ``block`` a piece of the range that holds one language, ``slot`` the place in the block.
    """
    largest = Window.partitionBy("lang").orderBy(F.desc("size"), "source")
    leading = groups.withColumn("lead", F.row_number().over(largest)).filter(F.col("lead") <= LEADING)
    led = counts.filter("term <> ''").join(leading.select("lang", "source", "lead"), ["lang", "source"], "left")
    by_lead = [F.coalesce(F.sum(F.when(F.col("lead") == k, F.col("n"))), F.lit(0)).alias(f"c{k}") for k in range(1, LEADING + 1)]
    kept = led.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), *by_lead)
    order = ["lang", *[f"c{k}" for k in range(1, LEADING + 1)], "total", "term"]
    kept = written(kept.filter(F.col("docs") >= min_docs).select(*order), "audit-terms")
    ranged = kept.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = written(
        ranged.select("lang", "term", "total", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")),
        "audit-order",
    )
    first = placed.groupBy("lang", "part").agg(F.min("at").alias("first"))
    place = F.col("at") - F.col("first")
    return placed.join(first, ["lang", "part"]).select(
        "lang", "term", "total", "part", F.expr(f"(at - first) div {BLOCK}").alias("block"), (place % BLOCK).cast("int").alias("slot")
    )


def share(n: str, total: str) -> Column:
    """``1 + floor(SCALE * (n + PRIOR) / total)``, in decimals: the product may be larger than a long."""
    return F.expr(f"1 + (CAST({SCALE} AS DECIMAL(10, 0)) * ({n} + {PRIOR})) div {total}")


def shares(n: np.ndarray, total: int) -> np.ndarray:
    """:func:`share` of whole numbers by long division, three digits at a time, which no total below 9e15 overflows."""
    rest, out = n.astype("i8") + PRIOR, np.zeros(len(n), "i8")
    for _ in range(3):
        rest *= 1000
        out = out * 1000 + rest // total
        rest %= total
    return out + 1


def runs(slots: np.ndarray, n: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """A column of ``width`` terms, zero but at ``slots`` (ascending), as the ends of its runs and the count of each."""
    gap_before = np.diff(slots, prepend=-1) > 1
    # Each cell ends at its own place; a gap before it is a run of zeros that ends where the cell begins.
    ends = np.column_stack([slots, slots + 1]).ravel()
    values = np.column_stack([np.zeros(len(n), "i8"), n]).ravel()
    there = np.column_stack([gap_before, np.ones(len(n), bool)]).ravel()
    ends, values = ends[there], values[there]
    if not len(ends) or ends[-1] < width:
        ends, values = np.append(ends, width), np.append(values, 0)
    last = np.append(values[1:] != values[:-1], True)
    return ends[last].astype("i4"), values[last].astype("i8")


def distance(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> int:
    """Sum of absolute differences of two columns: on the common runs, times their lengths."""
    ends = np.union1d(a[0], b[0])
    if not len(ends):
        return 0
    x, y = (v[np.searchsorted(e, ends)] for e, v in (a, b))
    return int((np.abs(x - y) * np.diff(ends, prepend=0)).sum())


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = []
        for width, total, cells in zip(*(batch.column(c).to_pylist() for c in ("width", "total", "cells"))):
            slots = np.array([c["slot"] for c in cells or []], "i8")
            n = np.array([c["n"] for c in cells or []], "i8")
            made.append((np.array([], "i4"), np.array([], "i8")) if width == 0 else runs(slots, n, width))
            made[-1] = made[-1][0], shares(made[-1][1], max(total, 1))
        columns = [batch.column(c) for c in ("lang", "number", "tile", "n_tiles", "part", "block")]
        columns.append(pa.array([e for e, _ in made], pa.list_(pa.int32())))
        columns.append(pa.array([v for _, v in made], pa.list_(pa.int64())))
        yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in COLUMN.split(", ")])


def _compared(table: pa.Table) -> pa.Table:
    """All pairs between two tiles, or within one, over one block."""
    lang, low, high = table.column("lang")[0].as_py(), table.column("low")[0].as_py(), table.column("high")[0].as_py()
    columns = {low: [], high: []}
    for tile, number, ends, values in zip(
        *(table.column(c).to_pylist() for c in ("tile", "number")),
        *([x.values.to_numpy() for x in table.column(c)] for c in ("ends", "shares")),
    ):
        columns[tile].append((number, (ends, values)))
    rows = [
        (lang, min(i, j), max(i, j), distance(x, y))
        for k, (i, x) in enumerate(columns[low])
        for j, y in (columns[low][k + 1 :] if low == high else columns[high])
    ]
    names = [c.split()[0] for c in DISTANCE.split(", ")]
    types = [pa.string(), pa.int64(), pa.int64(), pa.int64()]
    return pa.table({c: pa.array(v, t) for c, v, t in zip(names, zip(*rows) if rows else [[]] * 4, types)})


def columns_of(cells: DataFrame, groups: DataFrame, terms: DataFrame) -> DataFrame:
    """Every group's column, run-length encoded, a row per block; a language without terms has one empty block."""
    widths = terms.groupBy("lang", "part", "block").agg(F.count("*").cast("int").alias("width"))
    blocks = groups.select("lang").distinct().join(widths, "lang", "left").select(
        "lang", *[F.coalesce(c, F.lit(0)).cast(t).alias(c) for c, t in (("part", "int"), ("block", "long"), ("width", "int"))]
    )
    # Bounded: a group has at most as many cells in a block as the block has terms.
    filled = cells.groupBy("lang", "source", "part", "block").agg(
        F.sort_array(F.collect_list(F.struct("slot", "n"))).alias("cells")
    )
    grid = groups.join(blocks, "lang").join(filled, ["lang", "source", "part", "block"], "left")
    return grid.select("lang", "number", "tile", "n_tiles", "part", "block", "width", "total", "cells").mapInArrow(_encoded, COLUMN)


def distances(columns: DataFrame) -> DataFrame:
    """``(lang, a, b, value)`` for the numbers of all pairs of sources of a language, a below b."""
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_tiles") - 1))
    met = columns.withColumn("other", other).select(
        "lang", "part", "block", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"),
        "tile", "number", "ends", "shares",
    )
    return (
        met.groupBy("lang", "part", "block", "low", "high")
        .applyInArrow(_compared, DISTANCE)
        .groupBy("lang", "a", "b")
        .agg(F.sum("value").alias("value"))
    )


def source_audit(docs: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """Distances of all pairs of sources (part ``pair``) and the terms each source uses most above its language (``term``)."""
    counts = written(group_counts(docs), "audit-counts")
    groups = counts.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    terms = written(vocabulary(counts, groups, min_docs), "audit-vocabulary")
    cells = written(
        counts.filter("term <> ''").select("lang", "source", "term", "n").join(terms, ["lang", "term"]), "audit-cells"
    )
    langs = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_n"))
    own = cells.groupBy("lang", "source").agg(F.sum("n").alias("own_n"))
    numbered = rank_within(written(groups, "audit-groups"), ["lang"], ["source"])
    numbered = (
        numbered.join(numbered.groupBy("lang").agg(F.count("*").alias("n_sources")), "lang")
        .join(langs, "lang", "left")
        .join(own, ["lang", "source"], "left")
        .select(
            "lang",
            "source",
            F.col("rank0").alias("number"),
            F.expr(f"rank0 div {TILE}").alias("tile"),
            F.expr(f"(n_sources + {TILE - 1}) div {TILE}").alias("n_tiles"),
            (F.coalesce("own_n", F.lit(0)) + PRIOR * F.coalesce("v", F.lit(0))).alias("total"),
            (F.coalesce("lang_n", F.lit(0)) + PRIOR * F.coalesce("v", F.lit(0))).alias("lang_total"),
        )
    )
    numbered = written(numbered, "audit-sources")
    found = written(distances(columns_of(cells, numbered, terms)), "audit-distances")
    names = numbered.select("lang", "number", "source")
    directed = found.select("lang", F.col("a").alias("number"), F.col("b").alias("other"), "value").unionByName(
        found.select("lang", F.col("b").alias("number"), F.col("a").alias("other"), "value")
    )
    pairs = directed.join(names, ["lang", "number"]).join(
        names.select("lang", F.col("number").alias("other"), F.col("source").alias("item")), ["lang", "other"]
    )
    over = (
        cells.join(numbered.select("lang", "source", F.col("total").alias("group_total"), "lang_total"), ["lang", "source"])
        .withColumn("p", share("n", "group_total"))
        .withColumn("q", share("total", "lang_total"))
        .filter("p > q")
        .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    )
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    columns = ["lang", "source", "part", "item", "value", "rank"]
    over = over.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top_terms)
    pairs = pairs.withColumn("part", F.lit("pair")).withColumn("rank", F.row_number().over(best))
    return pairs.select(*columns).unionByName(over.select(*columns))


def op11_source_audit(spark, sf_dir: str) -> DataFrame:
    return source_audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents
),
w AS (SELECT rid, lang, source, unnest(regexp_extract_all(text, '[a-z\x{{80}}-\x{{10FFFF}}]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT rid) >= {MIN_DOCS}),
langs AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang),
cells AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL),
sources AS (
  SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS n FROM (SELECT DISTINCT lang, source FROM d) g
  LEFT JOIN cells c USING (lang, source) GROUP BY ALL
),
grid AS (
  SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n,
    1 + ({SCALE}::HUGEINT * (coalesce(c.n, 0) + {PRIOR})) // (s.n + {PRIOR} * l.v) AS p,
    1 + ({SCALE}::HUGEINT * (k.n + {PRIOR})) // (l.n + {PRIOR} * l.v) AS q
  FROM sources s JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN cells c USING (lang, source, term)
),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0)::BIGINT AS value
  FROM sources a JOIN sources b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (
    SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value
    FROM grid x JOIN grid y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL
  ) x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM grid WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank
  FROM (FROM pairs UNION ALL FROM terms)
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= {TOP_TERMS}
"""
