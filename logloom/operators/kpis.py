"""Scalar figures per day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.functions.numbers import ratio_or_null
from logloom.schema import ERROR_CODE, SUCCESS_CODE


def daily_kpis(logs: DataFrame, *, exact_hosts: bool = True) -> DataFrame:
    """All scalar figures of all days in one aggregation.

    The exact host count is spread by (date, host) before it is counted by date,
    so neither a busy host nor a busy day lands in one task.
    """
    ok = F.col("response_code") == SUCCESS_CODE
    hosts = F.count_distinct("host") if exact_hosts else F.approx_count_distinct("host")
    return (
        logs.groupBy("date")
        .agg(
            F.count("*").alias("total_log_count"),
            F.count_if(ok).alias("total_number_of_successful"),
            F.avg(F.when(ok, F.col("content_size"))).alias("average_content_size"),
            F.coalesce(F.sum(F.when(ok, F.col("content_size"))), F.lit(0)).alias(
                "total_content_size"
            ),
            hosts.alias("unique_host_count"),
            F.count_if(F.col("response_code") >= ERROR_CODE).alias("bad_records_count"),
        )
        .withColumn(
            "total_failed_access", F.col("total_log_count") - F.col("total_number_of_successful")
        )
    )


def kpis_of_rollup(hours: DataFrame, hosts: DataFrame) -> DataFrame:
    """The same figures from the `hour` and `host` rollup grains."""
    ok = F.col("response_code") == SUCCESS_CODE
    counts = hours.groupBy("date").agg(
        F.sum("hits").alias("total_log_count"),
        F.coalesce(F.sum(F.when(ok, F.col("hits"))), F.lit(0)).alias("total_number_of_successful"),
        F.coalesce(F.sum(F.when(ok, F.col("bytes"))), F.lit(0)).alias("total_content_size"),
        F.coalesce(
            F.sum(F.when(F.col("response_code") >= ERROR_CODE, F.col("hits"))), F.lit(0)
        ).alias("bad_records_count"),
    )
    # Both sides have one row per day.
    return (
        counts.join(unique_hosts(hosts), "date")
        .withColumn(
            "average_content_size",
            ratio_or_null(F.col("total_content_size"), F.col("total_number_of_successful")),
        )
        .withColumn(
            "total_failed_access", F.col("total_log_count") - F.col("total_number_of_successful")
        )
    )


def unique_hosts(rows: DataFrame) -> DataFrame:
    """Distinct hosts per day, from logs or from the `host` grain."""
    return rows.groupBy("date").agg(F.count_distinct("host").alias("unique_host_count"))
