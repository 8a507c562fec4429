"""What several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Characters between words: space and \\t \\n \\v \\f \\r. ``bytes.split()`` and ``bytes.strip()`` use the same six.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """The words of a text, an empty array for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_RUN, -1), lambda w: w != "")


def split_bytes(data: bytes, piece: int) -> Iterator[list[bytes]]:
    """The words between spaces, those of about ``piece`` bytes at a time; no word is cut, however long."""
    start = 0
    while start < len(data):
        end = data.rfind(b" ", start, start + piece) if start + piece < len(data) else len(data)
        if end < start:
            end = data.find(b" ", start)
            end = len(data) if end < 0 else end
        yield data[start:end].split()
        start = end + 1


def text_key(text: Column) -> Column:
    """Tells apart rows that repeat a doc_id with another text."""
    return F.xxhash64(text)


def match(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Equi-join in which nulls equal each other; the keys of ``left`` stay."""
    renamed = right.withColumnsRenamed({k: f"_{k}_right" for k in keys})
    on = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"_{k}_right"]) for k in keys])
    return left.join(renamed, on, how).drop(*[f"_{k}_right" for k in keys])


def rank_within(rows: DataFrame, keys: list[str], order: list[str], salts: int = 256) -> DataFrame:
    """Rows numbered from 0 within their keys, as ``rank0``; the same rows get the same numbers in every run.

    A key may hold any share of the rows: it is dealt to ``salts`` parts by a hash of ``order``, each part is numbered
    by itself and starts where the counts of the parts before it end. ``rows`` is read twice.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    before = Window.partitionBy(*keys).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        salted.groupBy(*keys, "_salt")
        .agg(F.count("*").alias("_n"))
        .select(*keys, "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    part = Window.partitionBy(*keys, "_salt").orderBy(*order)
    numbered = salted.withColumn("_rank", F.row_number().over(part) - 1)
    return (
        match(numbered, starts, [*keys, "_salt"])
        .withColumn("rank0", F.col("_start") + F.col("_rank"))
        .drop("_salt", "_start", "_rank")
    )
