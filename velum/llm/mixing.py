"""Mixing sources to target weights by entropy balancing.

Each source gets a target in words. Of all rates between 0 and ``cap`` whose words sum up to the target of their source,
those nearest in relative entropy to rate 1 are ``min(cap, exp(lambda * size))``: one exponential tilt per source. The
lambdas solve the convex dual, one constraint per source, by Newton steps kept inside a bracket. A step is one
aggregation over the histogram (source, size), which is counted once; no text and no document takes part in it.

Rates become whole copies on the histogram: the copies of all sizes up to a size follow the running sum of the rates, so
the words of a source miss their target by less than the largest document. Of several starting points of that running
sum, and of several other orders of the sizes, the one that comes nearest is taken. Within a size, documents get their copies in the order of a hash of the doc_id;
ranks are counted in parts (:func:`velum.llm.common.rank_within`), so one source or size may hold any share of the rows.

Only tables with a row per source or per (source, size) are ordered as a whole; sizes are bounded by the longest text.

Defined cases: a null text has size 0; a null source is the last source; documents of size 0 are copied once and count
nothing; rows that repeat a doc_id are documents of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from velum.llm.common import match, rank_within, words_of
from velum.sources.sinks import written

WEIGHTS, SHARE, CAP = (3, 1, 2), 1.5, 2
#: Orders of the sizes and starting points of the running sum that are tried.
ORDERS, OFFSETS = 8, 32
STEPS, TOLERANCE = 40, 1e-7


def source_targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """``(source, source_size, docs, target)`` from the size of each source.

    Sharing by weight and resharing the excess ends where ``target = min(cap * size, level * weight)``: with sources in
    the order of cap * size / weight, the level is that of the first source that stays below its own cap.
    """
    number = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(number, F.lit(len(weights))))
    weighed = sources.withColumn("weight", weight).withColumn("most", (F.col("source_size") * cap).cast("double"))
    line = Window.orderBy(F.col("most") / F.col("weight"), "most", F.asc_nulls_last("source"))
    summed = weighed.select(
        "*",
        F.coalesce(F.sum("most").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("below"),
        F.sum("weight").over(line.rowsBetween(0, Window.unboundedFollowing)).alias("left"),
        (F.sum("source_size").over(Window.partitionBy()) * share).alias("total"),
        F.row_number().over(line).alias("place"),
    ).withColumn("own_level", (F.col("total") - F.col("below")) / F.col("left"))
    stays = F.col("own_level") <= F.col("most") / F.col("weight")
    first = F.min(F.when(stays, F.struct("place", "own_level"))).over(Window.partitionBy())
    # Where every source is at its cap there is no level; ``least`` passes over the null.
    return summed.withColumn("level", first["own_level"]).select(
        "source", "source_size", "docs", F.least(F.col("most"), F.col("level") * F.col("weight")).alias("target")
    )


def _rate(cap: float):
    """The tilted rate of a document; 1 in a source without words, which has no tilt."""
    rate = F.least(F.lit(float(cap)), F.exp(F.least(F.col("tilt") * F.col("size") / F.col("mean"), F.lit(50.0))))
    return F.when(F.col("tilt").isNull(), F.lit(1.0)).otherwise(rate)


def solve_tilts(histogram: DataFrame, targets: DataFrame, cap: int = CAP) -> DataFrame:
    """``targets`` with ``mean`` and ``tilt``, the dual variable in units of 1 / mean size."""
    log_cap = math.log(cap)
    ratio = F.col("target") / F.col("source_size")
    # At tilt log(cap) * mean every document is at the cap; at -log(1 / ratio) * mean even one-word documents suffice.
    state = written(
        targets.filter("source_size > 0")
        .withColumn("mean", F.col("source_size") / F.col("docs"))
        .withColumn("hi", F.lit(log_cap) * F.col("mean"))
        .withColumn("lo", -F.greatest(F.log(1 / ratio), F.lit(0.0)) * F.col("mean"))
        .withColumn("tilt", F.when(ratio >= cap, F.col("hi")).otherwise(F.lit(0.0)))
        .withColumn("error", F.lit(1.0)),
        "mixing-state",
    )
    for _ in range(STEPS):
        rate = _rate(cap)
        tilted = match(histogram, state.select("source", "mean", "tilt"), ["source"], "inner")
        sums = tilted.groupBy("source").agg(
            F.sum(F.col("n") * F.col("size") * rate).alias("f"),
            F.sum(
                F.when(rate < cap, F.col("n") * F.col("size") * rate * F.col("size") / F.col("mean")).otherwise(0.0)
            ).alias("slope"),
        )
        over = F.col("f") > F.col("target")
        step = F.col("tilt") + (F.col("target") - F.col("f")) / F.col("slope")
        bracket = (
            match(state.drop("error"), sums, ["source"], "inner")
            .withColumn("hi", F.when(over, F.col("tilt")).otherwise(F.col("hi")))
            .withColumn("lo", F.when(over, F.col("lo")).otherwise(F.col("tilt")))
            .withColumn("error", F.abs(F.col("f") / F.col("target") - 1))
        )
        moved = F.when(F.col("slope").isNotNull() & (F.col("slope") > 0) & (step > F.col("lo")) & (step < F.col("hi")), step)
        state = written(
            bracket.withColumn(
                "tilt",
                F.when(F.col("error") < TOLERANCE, F.col("tilt")).otherwise(
                    F.coalesce(moved, (F.col("lo") + F.col("hi")) / 2)
                ),
            ).drop("f", "slope"),
            "mixing-state",
        )
        worst = state.agg(F.max("error")).first()[0]
        if worst is None or worst < TOLERANCE:
            break
    return state.select("source", "mean", F.round("tilt", 9).alias("tilt"))


def size_copies(histogram: DataFrame, targets: DataFrame, tilts: DataFrame, cap: int = CAP) -> DataFrame:
    """``(source, size, n, rate, copies)``: all copies of the documents of one source and size."""
    tilted = match(histogram, tilts, ["source"]).withColumn("rate", _rate(cap))
    seeds = F.explode(F.sequence(F.lit(0), F.lit(ORDERS - 1)))
    place = F.when(F.col("seed") == 0, F.col("size")).otherwise(F.xxhash64("seed", "size"))
    upto = Window.partitionBy("source", "seed").orderBy("place", "size")
    running = F.sum(F.col("n") * F.col("rate")).over(upto.rowsBetween(Window.unboundedPreceding, 0))
    summed = written(
        tilted.withColumn("seed", seeds)
        .withColumn("place", place)
        .withColumn("upto", running)
        .withColumn("before", F.coalesce(F.lag("upto").over(upto), F.lit(0.0))),
        "mixing-running",
    )

    def whole(offset):
        k = F.floor(F.col("upto") + offset) - F.floor(F.col("before") + offset)
        return F.greatest(F.lit(0), F.least(k, cap * F.col("n")))

    offsets = F.explode(F.transform(F.sequence(F.lit(0), F.lit(OFFSETS - 1)), lambda j: (j + 0.5) / OFFSETS))
    words = (
        summed.withColumn("offset", offsets)
        .groupBy("source", "seed", "offset")
        .agg(F.sum(whole(F.col("offset")) * F.col("size")).alias("words"))
    )
    miss = F.abs(F.col("words") - F.col("target"))
    best = match(words, targets.filter("source_size > 0").select("source", "target"), ["source"], "inner").groupBy("source").agg(
        F.min(F.struct(miss.alias("miss"), "seed", "offset")).alias("best")
    )
    # A source without words has no target and no best: its documents are copied once whatever the order.
    nothing = targets.filter("source_size = 0").select("source", F.lit(0).alias("seed"), F.lit(0.5).alias("offset"))
    taken = best.select("source", "best.seed", "best.offset").union(nothing)
    chosen = match(summed, taken, ["source", "seed"], "inner")
    return chosen.select("source", "size", "n", "rate", whole(F.col("offset")).alias("size_copies"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """Per document ``(doc_id, text_key, size, source_size, target, rate, copies)``."""
    sizes = written(
        docs.select(
            "doc_id", "source", F.xxhash64("text").alias("text_key"), F.size(words_of(F.col("text"))).cast("long").alias("size")
        ),
        "mixing-sizes",
    )
    histogram = written(sizes.groupBy("source", "size").agg(F.count("*").alias("n")), "mixing-histogram")
    sources = histogram.groupBy("source").agg(
        F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("docs")
    )
    targets = written(source_targets(sources, weights, share, cap), "mixing-targets")
    copies = written(size_copies(histogram, targets, solve_tilts(histogram, targets, cap), cap), "mixing-copies")
    ranked = rank_within(
        sizes.withColumn("_order", F.xxhash64("doc_id", "text_key")), ["source", "size"], ["_order", "doc_id", "text_key"]
    )
    all_of_size = match(match(ranked, copies, ["source", "size"]), targets.drop("docs"), ["source"])
    each = F.expr("size_copies div n") + F.when(F.col("rank0") < F.expr("size_copies % n"), 1).otherwise(0)
    return all_of_size.select(
        "doc_id", "text_key", "size", "source_size", "target", "rate", each.cast("long").alias("copies")
    )


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix(docs).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "rate"
    )


def mixed(docs: DataFrame) -> DataFrame:
    """The documents as often as the mix takes them, with all their columns.

    Rows that repeat a doc_id and its text meet the sum of their copies in the first of them.
    """
    taken = (
        mix(docs.select("doc_id", "source", "text"))
        .groupBy(F.col("doc_id").alias("_velum_doc"), F.col("text_key").alias("_velum_key"))
        .agg(F.sum("copies").cast("int").alias("_velum_copies"), F.count("*").alias("_velum_rows"))
        .filter("_velum_copies > 0")
    )
    on = F.col("doc_id").eqNullSafe(F.col("_velum_doc")) & (F.xxhash64("text") == F.col("_velum_key"))
    joined = docs.join(taken, on)
    repeated = Window.partitionBy("_velum_doc", "_velum_key").orderBy("_velum_doc")
    numbered = joined.filter("_velum_rows > 1").withColumn("_velum_row", F.row_number().over(repeated))
    first = numbered.filter("_velum_row = 1").drop("_velum_row")
    return (
        joined.filter("_velum_rows = 1")
        .union(first)
        .withColumn("_velum_copy", F.explode(F.sequence(F.lit(1), F.col("_velum_copies"))))
        .select(*docs.columns)
    )
