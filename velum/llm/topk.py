"""Exact top-k search by inner product over an impact-ordered index.

The rows are dealt out to blocks by a hash. The index of a block holds, for each level of quantised impact (the size of a
component), one posting segment: the places, dimensions and values of all components of that level. A segment also says
how long the rest of each vector is once it and all segments above it are processed.

A block and a group of queries meet in one task. It processes segments from the highest impact down, adding to the
scores of all queries at once. After each segment, the score of a vector is known to within rest * length of the query
(Cauchy-Schwarz); a vector stays possible while its upper bound reaches the k-th highest lower bound of the query. The
task stops early only on that proof, when few vectors are possible for each query, and scores those exactly in whole
numbers. Each block gives k rows for each query at most; the best k of all blocks are the result.

Each query must meet each block, so work is queries x vectors; blocks and groups of queries bound what one task holds.

Defined cases: vectors that are null, or hold null or non-finite components, take no part, nor do rows without an id;
shorter vectors count as filled up with zeros; ties go to the smaller id; a candidate never has the id of its query; of
rows that repeat a query's id the least vector is the query, and all are candidates; with fewer than k candidates all are
returned; an empty table gives an empty result; further columns are ignored. Components times ``scale`` must be below
2 ** 25 in size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from velum.sources.sinks import written

K, SCALE, EVERY = 5, 256, 50
#: Vectors of a block, queries of a group.
BLOCK, GROUP = 4096, 1024
#: Levels below the highest: each ends at a quarter less than the one above it.
STEP = 0.75
#: Candidates per query, as a share of the block, at which scoring them exactly costs less than the next segment.
FEW = 1 / 64

RESULT = "query_id long, vec_id long, score long"


def whole_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """``(vec_id, v)``: usable vectors with components ``floor(scale * x)``."""
    x = F.col("embedding")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vectors.filter(x.isNotNull() & F.col("vec_id").isNotNull() & ~bad).select(
        F.col("vec_id").cast("long"), F.transform(x, lambda c: F.floor(c.cast("double") * scale)).alias("v")
    )


def index_block(rows: pd.DataFrame) -> pd.DataFrame:
    """Posting segments of one block, from the highest impact down."""
    rows = rows.sort_values("vec_id", kind="stable")
    n = [len(v) for v in rows["v"]]
    place = np.repeat(np.arange(len(n)), n)
    dim = np.concatenate([np.arange(m) for m in n]) if n else np.empty(0, "i8")
    value = np.concatenate(rows["v"].to_list()).astype("i8") if n else np.empty(0, "i8")
    size = np.abs(value)
    top = max(int(size.max()), 1) if len(size) else 1
    level = np.floor(np.log(np.maximum(size, 1e-300) / top) / np.log(STEP)).clip(0, 24).astype("i4")
    rest = np.bincount(place, value.astype("f8") ** 2, len(n))
    out = []
    for at in np.unique(np.r_[level, 0]):
        own = np.flatnonzero(level == at)
        rest = np.maximum(rest - np.bincount(place[own], value[own].astype("f8") ** 2, len(n)), 0)
        out.append(
            {
                "block": int(rows["block"].iloc[0]),
                "level": int(at),
                "ids": rows["vec_id"].to_numpy() if at == 0 else np.empty(0, "i8"),
                "place": place[own].astype("i4"),
                "dim": dim[own].astype("i4"),
                "value": value[own],
                "rest": np.sqrt(rest),
            }
        )
    return pd.DataFrame(out)


INDEX = T.StructType(
    [
        T.StructField("block", T.IntegerType()),
        T.StructField("level", T.IntegerType()),
        T.StructField("ids", T.ArrayType(T.LongType())),
        T.StructField("place", T.ArrayType(T.IntegerType())),
        T.StructField("dim", T.ArrayType(T.IntegerType())),
        T.StructField("value", T.ArrayType(T.LongType())),
        T.StructField("rest", T.ArrayType(T.DoubleType())),
    ]
)


def build_index(whole: DataFrame, blocks: int) -> DataFrame:
    """Posting segments of all rows. A block is a slice of the rows by a hash of their id, of about ``BLOCK`` rows."""
    dealt = whole.withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int"))
    return dealt.groupBy("block").applyInPandas(index_block, INDEX)


def search_block(k: int):
    """The best ``k`` of one block for each query of one group."""

    def run(key: tuple, segments: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        if not len(segments) or not len(queries):
            return empty
        segments = segments.sort_values("level")
        ids = np.asarray(segments["ids"].iloc[0])
        own = queries["vec_id"].to_numpy()
        dims = max(max(map(len, queries["v"])), max((d.max() + 1 for d in segments["dim"] if len(d)), default=1))
        q = np.zeros((len(queries), dims))
        for i, v in enumerate(queries["v"]):
            q[i, : len(v)] = v
        length = np.sqrt((q * q).sum(axis=1))
        score = np.zeros((len(ids), len(own)))
        score[ids[:, None] == own[None, :]] = -np.inf  # a query is no candidate of its own
        k_here = min(k, len(ids))
        for _, s in segments.iterrows():
            part = np.zeros((len(ids), dims))
            part[s["place"], s["dim"]] = s["value"]
            score += part @ q.T
            slack = np.outer(s["rest"], length) * (1 + 1e-9) + 1e-6
            bar = np.partition(score - slack, len(ids) - k_here, axis=0)[len(ids) - k_here]
            possible = (score + slack >= bar) & (score > -np.inf)
            if possible.sum() <= max(k_here, FEW * len(ids)) * len(own):
                break
        place, query = np.nonzero(possible)
        whole_v, whole_q = vectors_of(segments, len(ids), dims), q.astype("i8")
        exact = np.concatenate(
            [(whole_v[place[a : a + 65536]] * whole_q[query[a : a + 65536]]).sum(axis=1) for a in range(0, len(place), 65536)]
            or [np.empty(0, "i8")]
        )
        order = np.lexsort((ids[place], -exact, query))
        query, place, exact = query[order], place[order], exact[order]
        starts = np.flatnonzero(np.r_[True, query[1:] != query[:-1]]) if len(query) else np.empty(0, "i8")
        rank = np.arange(len(query)) - np.repeat(starts, np.diff(np.r_[starts, len(query)]))
        best = rank < k
        return pd.DataFrame({"query_id": own[query[best]], "vec_id": ids[place[best]], "score": exact[best]})

    return run


def vectors_of(segments: pd.DataFrame, n: int, dims: int) -> np.ndarray:
    """All vectors of a block in whole numbers, put together from its segments."""
    out = np.zeros((n, dims), "i8")
    for place, dim, value in zip(segments["place"], segments["dim"], segments["value"]):
        out[place, dim] = value
    return out


def top_k(vectors: DataFrame, every: int = EVERY, k: int = K, scale: int = SCALE) -> DataFrame:
    """``(query_id, rank, vec_id, score)`` for the queries: rows whose id is divisible by ``every``."""
    whole = written(whole_vectors(vectors, scale), "vectors")
    n, n_queries = whole.agg(F.count("*"), F.count_if(F.pmod("vec_id", F.lit(every)) == 0)).first()
    blocks, groups = -(-n // BLOCK) or 1, -(-n_queries // GROUP) or 1
    index = written(build_index(whole, blocks), "impact-index")
    queries = whole.filter(F.pmod("vec_id", F.lit(every)) == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    # Block-nested: each block goes to every group of queries, each query to every block.
    sides = (
        index.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))),
        queries.withColumn("group", F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int")).withColumn(
            "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
        ),
    )
    found = sides[0].groupBy("block", "group").cogroup(sides[1].groupBy("block", "group")).applyInPandas(
        search_block(k), RESULT
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int"), "vec_id", "score")
    )


def op6_topk_search(spark, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


ORACLE_SQL = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    list_sum(list_transform(list_zip(q.v, c.v), lambda p: coalesce(p[1], 0) * coalesce(p[2], 0)))::BIGINT AS score
  FROM (SELECT vec_id, min(v) AS v FROM v WHERE vec_id % {EVERY} = 0 GROUP BY vec_id) AS q
  JOIN v AS c ON c.vec_id <> q.vec_id
),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}
"""
