"""Connected components of a graph of long ids, by alternating large-star and small-star steps.

The tables stay distributed. A step takes the least neighbour of each node, pre-aggregated before its shuffle and written,
so that the join with a node of very many edges can be split; edges are written after each round, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velum.sources.sinks import written


def _least(edges: DataFrame, name: str) -> DataFrame:
    return written(edges.groupBy("u").agg(F.min("v").alias("m")), name)


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of an edge ``(u, v)`` that is not the least of its component."""
    edges = written(
        edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"
    )
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least(both, "star-large").withColumn("m", F.least("u", "m")), "u").filter("v > u")
        large = written(large.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "edges-large")
        small = large.join(_least(large, "star-small"), "u")
        linked = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        tops = small.select("u", F.col("m").alias("v"))
        edges = written(linked.union(tops).distinct(), "edges")
        seen = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = seen
