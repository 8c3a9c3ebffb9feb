"""Positions within groups of any size, without a task that holds a group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.session import scratch_path


def distributed_rank(rows: DataFrame, groups: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """`rows` with their `rank` (from 1) within each group under `order`, which must be total.

    Rows are dealt out by ranges of group and order, so that a large group falls in many
    tasks, and written aside. A row's rank is its place in its own range plus the rows of
    its group in the ranges before; the counts have a row per range and group.
    """
    spark = rows.sparkSession
    path = scratch_path(spark, "ranges")
    dealt = rows.repartitionByRange(*groups, *order).withColumn("_range", F.spark_partition_id())
    dealt.write.parquet(path)
    dealt = spark.read.schema(dealt.schema).parquet(path)
    before = Window.partitionBy(*groups).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = (
        dealt.groupBy("_range", *groups).agg(F.count("*").alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    # The join has shuffled by the window's own keys, so the window needs no shuffle.
    place = F.row_number().over(Window.partitionBy("_range", *groups).orderBy(*order))
    return (
        dealt.join(counts, ["_range", *groups])
        .withColumn("rank", place + F.col("_before"))
        .select(*rows.columns, "rank")
    )
