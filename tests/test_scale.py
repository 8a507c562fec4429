"""What lets the work of a query grow with the cores: input dealt out, steps of a line compiled."""

from pyspark.sql import functions as F

from velum.plans import fixtures as fx

SF = "/root/testdata/sf0.001"


def test_pages_from_one_file_are_made_by_several_tasks(spark):
    """The orders are one file of one row group; the forms derived from them are not made by one task."""
    for make in (fx.forms, fx.bare):
        pages = make(spark, SF)
        tasks = pages.groupBy(F.spark_partition_id()).count().collect()
        assert len(tasks) >= spark.sparkContext.defaultParallelism // 2
        assert sum(r["count"] for r in tasks) == fx.table(spark, SF, "orders").count()
