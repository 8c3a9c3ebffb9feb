"""Daily figures as native event-time windows, and with late lines told apart."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from logloom.functions.clf import parse_logs
from logloom.schema import ERROR_CODE, LOG_SCHEMA, SUCCESS_CODE
from logloom.sources.files import exists, list_partitions


def daily_windows(logs: DataFrame, keys: Sequence[str] = (), *, delay: str | None = None) -> DataFrame:
    """Counts per day (and key) over a stream of parsed logs.

    Without `delay`, lines count however late they come; the state is a row per day
    and key, which stays small for response codes. With it, rows more than `delay`
    behind the latest event are dropped once their day is closed, and Spark forgets old
    days (needed for append mode); Spark's progress reports tell how many
    (numRowsDroppedByWatermark). Hosts are estimated, as the state for exact ones would
    grow with the traffic; the deltas have exact ones.
    """
    # The wall clock read as UTC, so that windows are the logged days whatever the
    # session time zone; `date` is one value per window.
    clock = F.concat(F.col("date_time"), F.lit("Z")).cast("timestamp")
    timed = logs.withColumn("clock", clock)
    if delay is not None:
        timed = timed.withWatermark("clock", delay)
    return timed.groupBy(F.window("clock", "1 day").alias("day"), "date", *keys).agg(
        *_figures(),
        F.approx_count_distinct("host").alias("unique_host_estimate"),
        F.max("event_time").cast("string").alias("last_time"),
    ).drop("day")


def _figures():
    return [
        F.count("*").alias("total_log_count"),
        F.count_if(F.col("response_code") == SUCCESS_CODE).alias("total_number_of_successful"),
        F.count_if(F.col("response_code") >= ERROR_CODE).alias("bad_records_count"),
    ]


_SUMS = ["total_log_count", "total_number_of_successful", "bad_records_count"]
_CLOCK = "max_time timestamp_ntz, batch_id bigint"


def windows_with_late_lines(
    lines: DataFrame, root: str, checkpoint: str, delay: str, keys: Sequence[str] = (), *, trigger: dict | None = None
) -> DataStreamWriter:
    """A writer that counts lines by day (and key) until the day is closed, and keeps later ones.

    A native window drops rows behind its watermark. Here each micro-batch is split by a
    watermark of its own, the latest event time of all batches before it less `delay`: lines
    of days that ended by then go whole to a side table (see read_late()), the others
    into the counts (see read_windows()). So what is counted and what is late add up to the
    input. The split is stateless: all that it needs of earlier batches is one time each, which
    is written with their results. A batch that is delivered again is split as before.
    """
    spark = lines.sparkSession

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        logs = parse_logs(batch)
        closed = _closed_until(spark, root, batch_id, delay)
        is_late = F.lit(False) if closed is None else F.date_add(F.to_date("date"), 1) <= F.lit(closed).cast("timestamp_ntz")
        marked = logs.withColumn("_late", is_late).persist()
        on_time = marked.where("NOT _late").groupBy("date", *keys).agg(*_figures(), F.max("event_time").alias("last_time"))
        on_time.write.mode("overwrite").parquet(f"{root}/windows/batch_id={batch_id}")
        marked.where("_late").drop("_late").write.mode("overwrite").parquet(f"{root}/late/batch_id={batch_id}")
        latest = marked.agg(F.max("event_time").alias("max_time"))
        latest.write.mode("overwrite").parquet(f"{root}/clock/batch_id={batch_id}")
        marked.unpersist()

    return (
        lines.writeStream.foreachBatch(on_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "5 seconds"}))
    )


def _closed_until(spark: SparkSession, root: str, batch_id: int, delay: str) -> str | None:
    """The watermark of a batch as text: days that end by it are closed."""
    if not exists(spark, f"{root}/clock"):
        return None
    clock = spark.read.schema(_CLOCK).parquet(f"{root}/clock").where(F.col("batch_id") < batch_id)
    latest = clock.agg((F.max("max_time") - F.expr(f"INTERVAL {delay}")).cast("string").alias("until"))
    return latest.first()["until"]


def read_windows(spark: SparkSession, root: str, keys: Sequence[str] = ()) -> DataFrame:
    """The counts per day (and key) over all batches."""
    batches = spark.read.option("basePath", f"{root}/windows").parquet(*_done(spark, f"{root}/windows"))
    sums = [F.sum(c).alias(c) for c in _SUMS]
    return batches.groupBy("date", *keys).agg(*sums, F.max("last_time").cast("string").alias("last_time"))


def read_late(spark: SparkSession, root: str) -> DataFrame:
    """The parsed lines that came after their day was closed, with the batch they came in."""
    schema = T.StructType([*LOG_SCHEMA, T.StructField("batch_id", T.LongType())])
    return spark.read.schema(schema).option("basePath", f"{root}/late").parquet(*_done(spark, f"{root}/late"))


def _done(spark: SparkSession, root: str) -> list[str]:
    return [f"{root}/batch_id={n}" for n in list_partitions(spark, root, r"batch_id=(\d+)", finished=True)]
