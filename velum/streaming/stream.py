"""The detector on documents that keep arriving."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from velum.operators.lines import analyze


def stream_documents(
    spark: SparkSession, path: str, schema, doc_id: str = "doc_id", text: str = "text", page: str | None = None, arrival: bool = False
) -> DataFrame:
    """Arriving parquet files as a stream of pages; with ``arrival`` the time of the file is the column ``arrived``."""
    number = F.col(page).cast("int") if page else F.lit(0)
    when = [F.col("_metadata.file_modification_time").alias("arrived")] if arrival else []
    return (
        spark.readStream.schema(schema)
        .parquet(path)
        .select(F.col(doc_id).cast("bigint").alias("doc_id"), number.alias("page"), F.col(text).alias("text"), *when)
    )


def delivered_once(pages: DataFrame, within: str) -> DataFrame:
    """Pages without those that arrive again with the same text, up to ``within`` (such as ``7 days``) later.

    The state holds a page's key and the hash of its text, not the text, and forgets both when the watermark has passed.
    The same page with another text is a new page.
    """
    keyed = pages.withColumn("_version", F.xxhash64("text")).withWatermark("arrived", within)
    return keyed.dropDuplicatesWithinWatermark(["doc_id", "page", "_version"]).drop("_version", "arrived")


def stream_analyze(pages: DataFrame, out: str, checkpoint: str, redelivery: str | None = None) -> StreamingQuery:
    """Findings of arriving pages, appended to a parquet table; everything available is processed, then it ends.

    A page arrives as one row and the detector looks at nothing outside it, so the batch plan runs unchanged as
    a stateless stream. The file sink writes each batch once even when a batch is run again after a failure, and
    ``item_id`` is a function of the finding, so a rerun gives the same rows as a batch job. Where documents may be
    delivered more than once, ``redelivery`` is the time in which that is noticed (see :func:`delivered_once`; the
    pages need ``arrived``); it costs a shuffle of the pages.
    """
    return (
        analyze(delivered_once(pages, redelivery) if redelivery else pages)
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
