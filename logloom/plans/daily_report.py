"""From parsed logs to stored daily reports: all days at once, only the new ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from logloom.operators.breakdown import key_entries, with_share
from logloom.operators.kpis import kpis_of_rollup
from logloom.operators.rollup import GRAINS, SKETCH, host_sketches, merge_rollups, rollup, with_hour
from logloom.operators.store import (
    drop_rows,
    empty_tables,
    marker_cells,
    scalar_cells,
    table_cells,
    write_cells,
)
from logloom.operators.topk import top_k
from logloom.schema import (
    BATCH_SCALARS,
    BATCH_TABLE,
    BATCH_TABLES,
    ERROR_CODE,
    ERROR_URL_CODE,
    FREQUENT_HITS,
    MARKER,
    TOP_ROWS,
)
from logloom.sources.files import delete, exists, loads_by_day, read_logs

# Folder, in the store, that tells the loads each report was made of.
LEDGER = "_ledger"
_LEDGER_SCHEMA = "date string, loads array<string>"


def write_rollup(logs: DataFrame, root: str) -> None:
    """Store the rollup of some days, replacing those days.

    This is the only step that reads the logs; every report is cut from its
    output, which is as small as the distinct (host, code) and (endpoint, code)
    pairs of a day. Each day's hosts are sketched from the rows just stored.
    """

    def store(rows: DataFrame) -> None:
        (
            rows.write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("grain", "date")
            .parquet(root)
        )

    rows = rollup(with_hour(logs), GRAINS).hint("rebalance", F.col("grain"), F.col("date"))
    seen = Observation()
    store(rows.observe(seen, F.collect_set("date").alias("days")))
    if not (days := seen.get["days"]):
        return
    stored = read_rollup(logs.sparkSession, root).where(F.col("date").isin(days))
    store(host_sketches(grain(stored, "host")).coalesce(1))


def read_rollup(spark: SparkSession, root: str) -> DataFrame:
    schema = (
        "hour int, response_code int, host string, endpoint string, hits bigint, bytes bigint, "
        "last_time timestamp_ntz, sketch binary, grain string, date string"
    )
    return spark.read.schema(schema).parquet(root)


def grain(rows: DataFrame, name: str) -> DataFrame:
    return rows.where(F.col("grain") == name)


def report_rows(
    rows: DataFrame, *, min_url_code: int = ERROR_URL_CODE, k: int = TOP_ROWS
) -> DataFrame:
    """The rows of all six tables of all days, told apart by `qualifier` (the cell name).

    Each grain is read and shuffled once; one ranking then serves every table.
    """
    hours = grain(rows, "hour")
    codes = merge_rollups(hours, ["date", "response_code"]).select(
        "date",
        F.lit("process_response_code").alias("qualifier"),
        "response_code",
        F.col("hits").alias("count"),
        "last_time",
    )
    hosts = key_entries(
        grain(rows, "host"), "host", "process_hosts_more_than_10", FREQUENT_HITS, "error_hosts_top", ERROR_CODE
    )
    endpoints = key_entries(
        grain(rows, "endpoint"), "endpoint", "process_top_endpoints", 0, "process_top_errors", min_url_code
    )
    candidates = codes.unionByName(hosts, allowMissingColumns=True).unionByName(
        endpoints, allowMissingColumns=True
    )
    keys = ["host", "endpoint", "response_code"]
    order = [F.col("count").desc(), *[F.col(c).asc() for c in keys]]
    ranked = top_k(candidates, k, order, ["qualifier", "date"]).drop("rank")
    by_hour = hours.where(F.col("response_code") >= ERROR_CODE).select(
        "date",
        F.lit("error_hour").alias("qualifier"),
        "hour",
        "response_code",
        F.col("hits").alias("count"),
    )
    everything = ranked.unionByName(by_hour, allowMissingColumns=True)
    totals = hours.groupBy("date").agg(F.sum("hits").alias("total"))
    return with_share(everything, totals).withColumn(
        "last_time", F.col("last_time").cast("string")
    )


def report_table(report: DataFrame, name: str) -> DataFrame:
    """One table of `report_rows`."""
    return report.where(F.col("qualifier") == name).select("date", *BATCH_TABLES[name])


def report_cells(rows: DataFrame) -> DataFrame:
    """Every cell of every day's report, but for the marker."""
    kpis = kpis_of_rollup(grain(rows, "hour"), grain(rows, "host"))
    keys = ["hour", "host", "endpoint", "response_code"]
    # Fields a table does not have are null in its rows and so absent from its JSON.
    fields = [*keys, "count", "last_time", "percentage"]
    days = grain(rows, "hour").select("date").distinct()
    tables = report_rows(rows).unionByName(
        empty_tables(days, list(BATCH_TABLES)), allowMissingColumns=True
    )
    return scalar_cells(kpis, BATCH_TABLE, BATCH_SCALARS).unionByName(
        table_cells(tables, BATCH_TABLE, fields, keys)
    )


def done_days(cells: DataFrame) -> DataFrame:
    """(date): days whose marker cell was written, i.e. whose report is complete."""
    return cells.where(
        (F.col("table") == BATCH_TABLE) & (F.col("qualifier") == MARKER) & (F.col("value") == "1")
    ).select(F.substring("row_key", 6, 10).alias("date"))


def read_ledger(spark: SparkSession, store_root: str) -> DataFrame:
    """(date, loads): what each reported day was made of when its report was written."""
    if not exists(spark, f"{store_root}/{LEDGER}"):
        return spark.createDataFrame([], _LEDGER_SCHEMA)
    rows = spark.read.schema(_LEDGER_SCHEMA).parquet(f"{store_root}/{LEDGER}")
    return rows.select("date", "loads")


def pending_days(present: DataFrame, ledger: DataFrame, mode: str = "incremental") -> DataFrame:
    """(date, loads) of the days to analyze: those whose loads are not what the ledger says.

    A day is new, has got another load, or had one replaced; with `mode="refresh"`, all days
    are taken. Both tables have a row per day; no cell and no line is read.
    """
    if mode == "refresh":
        return present
    if mode != "incremental":
        raise ValueError(f"unknown mode {mode!r}")
    told = ledger.select("date", F.col("loads").alias("told"))
    changed = ~F.col("loads").eqNullSafe(F.col("told"))
    return present.join(told, "date", "left").where(changed).select("date", "loads")


def run_daily_report(
    spark: SparkSession,
    logs_root: str,
    rollup_root: str,
    store_root: str,
    mode: str = "incremental",
    days: Sequence[str] | None = None,
) -> list[str]:
    """Bring the report store up to date with the log table; returns the days done.

    Done are the days whose loads have changed since their report (see pending_days()), or
    just the chosen `days`, changed or not. A day's old row is replaced as a whole, its
    marker goes in after it and its line of the ledger last: a run that dies in between
    leaves the day pending. Days that no load holds any more lose their report. The lists of
    days on the driver come from the manifests of the loads, one short row per day.
    """
    present = loads_by_day(spark, logs_root)
    ledger = read_ledger(spark, store_root)
    if days is not None:
        chosen = present.where(F.col("date").isin(list(days)))
    else:
        chosen = pending_days(present, ledger, mode)
    rows_of_days = chosen.collect()
    if days is None:
        gone = [r.date for r in ledger.join(present, "date", "left_anti").collect()]
        _drop_days(spark, rollup_root, store_root, gone)
    todo = sorted(r.date for r in rows_of_days)
    if not todo:
        return []
    write_rollup(read_logs(spark, logs_root, todo), rollup_root)
    rows = read_rollup(spark, rollup_root).where(F.col("date").isin(todo))
    write_cells(report_cells(rows), store_root)
    done = spark.createDataFrame(rows_of_days, _LEDGER_SCHEMA)
    write_cells(marker_cells(done, BATCH_TABLE, MARKER), store_root, mode="append")
    (
        done.coalesce(1).write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("date")
        .parquet(f"{store_root}/{LEDGER}")
    )
    return todo


def _drop_days(spark: SparkSession, rollup_root: str, store_root: str, days: Sequence[str]) -> None:
    drop_rows(spark, store_root, BATCH_TABLE, [f"date={day}" for day in days])
    for day in days:
        for name in [*GRAINS, SKETCH]:
            delete(spark, f"{rollup_root}/grain={name}/date={day}")
        delete(spark, f"{store_root}/{LEDGER}/date={day}")
