"""Places and running sums over a whole table, without a task that sees all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.session import scratch


def running(df: DataFrame, order: list[Column], value: Column, name: str) -> DataFrame:
    """df with the sum of value over all rows that stand before, in the order of some columns; nulls count nothing.

    Rows are dealt by ranges of the order, written once (so that ranges stay as
    they are), summed within each range, and moved by the sums of the ranges before: as many
    rows as there are partitions.  Of rows alike in order any may stand first, so
    the order should name them all; rows alike in it share a task.
    """
    spark = df.sparkSession
    path = scratch(spark, "ranges")
    dealt = df.withColumn("_value", value).repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order)
    dealt.withColumn("_range", F.spark_partition_id()).write.parquet(path)
    rows = spark.read.parquet(path)
    sums = rows.groupBy("_range").agg(F.sum("_value").alias("_sum"))
    earlier = F.coalesce(F.sum("_sum").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    moved = F.broadcast(sums.select("_range", earlier.alias("_earlier")))
    within = F.coalesce(F.sum("_value").over(Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("_within", within).join(moved, "_range").withColumn(name, F.col("_within") + F.col("_earlier")).drop("_range", "_value", "_within", "_earlier")


def numbered(df: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """df with the place (from 1) of each row in the order of some columns."""
    return running(df, order, F.lit(1).cast("long"), name).withColumn(name, (F.col(name) + 1).cast("long"))
