"""Writing reports and mappings."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_report_csv(report: DataFrame, path: str) -> None:
    """Report rows as ``;``-separated text with a header."""
    report.write.mode("overwrite").option("sep", ";").option("header", True).option("escape", '"').csv(path)


def write_report_json(report: DataFrame, path: str) -> None:
    """Report rows as JSON Lines; empty fields are kept."""
    report.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def mapping_rows(items: DataFrame, *more: str) -> DataFrame:
    """Items with a new value as mapping entries; columns in ``more`` come first."""
    return items.filter("new_value <> ''").select(
        *more,
        F.col("type").alias("typ"),
        F.col("label").alias("opis"),
        F.col("value").alias("stara"),
        F.col("new_value").alias("nowa"),
    )


def write_mapping(items: DataFrame, path: str) -> None:
    """A mapping of every item with a new value, as JSON Lines, in reading order.

    ``ord`` tells that order: items are dealt out by ranges and numbered inside each, so no task sees them all.
    """
    place = ["doc_id", "page", "line_no", "part_idx", "start"]
    changed = written(items.filter("new_value <> ''"), "mapping-items")  # read twice: to find the ranges and to deal
    ordered = changed.repartitionByRange(*place).sortWithinPartitions(*place)
    numbered = ordered.withColumn("ord", F.monotonically_increasing_id())
    mapping_rows(numbered, "ord").write.mode("overwrite").json(path)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder for intermediate tables, in the shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a local master may leave that setting out, as in tests: then a temporary folder of this machine is taken.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The table written to the shared folder and read back: computed once, whatever is built on it."""
    path = shared_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
