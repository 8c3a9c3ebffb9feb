"""Running reports from micro-batches: one small rollup per batch, added up on read.

Each batch overwrites its own directory `deltas/batch_id=N/date=D`, so a batch delivered
twice counts once. A report is an aggregation over the deltas of its days, and of the state
that compact() folds old deltas into: `state/gen=V/date=D/grain=G`, where only the days that
the folded batches touched get a new generation. `manifests/version=V` tells which generation
of each day counts and up to which batch; it is written last, and what it replaces stays
until the next run, so neither a killed run nor a reader that is under way sees a gap.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from logloom.functions.clf import parse_lines
from logloom.operators.breakdown import key_entries, with_share
from logloom.operators.kpis import kpis_of_rollup
from logloom.operators.rollup import GRAINS, merge_rollups, rollup, with_hour
from logloom.operators.store import empty_tables, scalar_cells, table_cells, write_cells
from logloom.schema import (
    ERROR_CODE,
    REALTIME_SCALARS,
    REALTIME_TABLE,
    REALTIME_TABLES,
    SUCCESS_CODE,
)
from logloom.sources.files import DAY_DIRECTORY, delete, exists, list_partitions

# Lines that did not parse ride along in the `hour` grouping under their reason
# (all other keys null) and are stored as grain `reject`.
DELTA_GRAINS = {**GRAINS, "hour": [*GRAINS["hour"], "reject_reason"]}
_KEYS = ["date", "hour", "response_code", "host", "endpoint", "reject_reason"]
_COLUMNS = [*_KEYS, "hits", "bytes", "last_time", "batch", "batch_time", "grain"]
_SCHEMA = (
    "date string, hour int, response_code int, host string, endpoint string, "
    "reject_reason string, hits bigint, bytes bigint, last_time timestamp_ntz, "
    "batch bigint, batch_time timestamp, grain string"
)
_MANIFEST = "date string, gen int, upto bigint"


def batch_delta(
    lines: DataFrame, batch_id: int, *, day_from: str = "event", clock: Column | None = None
) -> DataFrame:
    """All grains of one micro-batch of lines, in one pass.

    `day_from="processing"` files the batch under the date it is processed on and
    not under the dates in its lines. `clock` is the time of processing, now by default.
    """
    clock = F.current_timestamp() if clock is None else clock
    parsed = with_hour(parse_lines(lines))
    if day_from == "processing":
        parsed = parsed.withColumn("date", F.date_format(clock, "yyyy-MM-dd"))
    elif day_from != "event":
        raise ValueError(f"unknown day_from {day_from!r}")
    is_log = F.col("reject_reason").isNull()
    # Rejects keep only their reason: few values, gone into few groups.
    for key in _KEYS[:-1]:
        parsed = parsed.withColumn(key, F.when(is_log, F.col(key)))
    rows = rollup(parsed, DELTA_GRAINS)
    is_reject = F.col("reject_reason").isNotNull()
    return rows.where(F.col("date").isNotNull() | is_reject).select(
        *_KEYS,
        "hits",
        "bytes",
        "last_time",
        F.lit(batch_id).cast("bigint").alias("batch"),
        clock.alias("batch_time"),
        F.when(is_reject, "reject").otherwise(F.col("grain")).alias("grain"),
    )


def write_delta(
    lines: DataFrame, batch_id: int, root: str, *, day_from: str = "event", clock: Column | None = None
) -> None:
    """The body of foreachBatch: one job per micro-batch, safe to repeat.

    The rebalance hint gives each day files of even size, however large the batch; the
    aggregation before it runs in as many tasks as Spark finds fit.
    """
    delta = batch_delta(lines, batch_id, day_from=day_from, clock=clock)
    (
        delta.hint("rebalance", F.col("date")).sortWithinPartitions("date", "grain").write.mode("overwrite")
        .option("partitionOverwriteMode", "static")
        .partitionBy("date")
        .parquet(f"{root}/deltas/batch_id={batch_id}")
    )


def report_stream(
    lines: DataFrame,
    root: str,
    checkpoint: str,
    *,
    trigger: dict | None = None,
    day_from: str = "event",
    also: Callable[[DataFrame, int], None] | None = None,
    store_root: str | None = None,
    clock: Column | None = None,
) -> DataStreamWriter:
    """A writer that keeps the deltas below `root` up to date; call start() on it.

    With `store_root`, the realtime rows of the days that a batch touches are renewed in that
    report store after its delta (see refresh_store()). `also(batch, batch_id)` runs custom
    code on each batch after that; the batch is kept for it, so its lines are read once.
    """

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        if also is not None:
            batch.persist()
        write_delta(batch, batch_id, root, day_from=day_from, clock=clock)
        if store_root is not None:
            refresh_store(batch.sparkSession, root, store_root, touched_days(batch.sparkSession, root, batch_id))
        if also is not None:
            also(batch, batch_id)
            batch.unpersist()

    return (
        lines.writeStream.foreachBatch(on_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "5 seconds"}))
    )


def touched_days(spark: SparkSession, root: str, batch_id: int) -> list[str]:
    """The days that a batch has lines of, by the names of its directories."""
    return list_partitions(spark, f"{root}/deltas/batch_id={batch_id}", DAY_DIRECTORY)


def refresh_store(spark: SparkSession, root: str, store_root: str, days: Sequence[str]) -> None:
    """Write the realtime rows of some days anew, from these days' deltas and state alone."""
    if days:
        write_cells(realtime_cells(read_deltas(spark, root, days)), store_root)


def _manifest(spark: SparkSession, root: str) -> tuple[int, int, dict[str | None, int]]:
    """(version, last batch folded, generation of each day) of the newest finished manifest."""
    versions = [int(v) for v in list_partitions(spark, f"{root}/manifests", r"version=(\d+)", finished=True)]
    if not versions:
        return 0, -1, {}
    # A short row per calendar day, and one for the batch.
    rows = spark.read.schema(_MANIFEST).parquet(f"{root}/manifests/version={max(versions)}").collect()
    return max(versions), max(r.upto for r in rows), {r.date: r.gen for r in rows if r.gen is not None}


def _batches(spark: SparkSession, root: str, after: int) -> list[int]:
    """Finished batches that are not folded into the state yet."""
    numbers = [int(n) for n in list_partitions(spark, f"{root}/deltas", r"batch_id=(\d+)")]
    return sorted(n for n in numbers if n > after and exists(spark, f"{root}/deltas/batch_id={n}/_SUCCESS"))


def _day_directory(day: str | None) -> str:
    """Lines that did not parse have no day; Spark's name for that."""
    return "date=__HIVE_DEFAULT_PARTITION__" if day is None else f"date={day}"


def _read(spark: SparkSession, root: str, generations: dict[str | None, int], batches: list[int]) -> DataFrame:
    found = []
    for base, paths in [
        (f"{root}/state", [f"{root}/state/gen={g}/{_day_directory(d)}" for d, g in sorted(generations.items(), key=repr)]),
        (f"{root}/deltas", [f"{root}/deltas/batch_id={n}" for n in batches]),
    ]:
        if paths:
            rows = spark.read.schema(_SCHEMA).option("basePath", base).parquet(*paths)
            found.append(rows.select(*_COLUMNS))
    if not found:
        return spark.createDataFrame([], _SCHEMA).select(*_COLUMNS)
    return reduce(DataFrame.unionByName, found)


def read_deltas(spark: SparkSession, root: str, days: Iterable[str] | None = None) -> DataFrame:
    """All batches so far, folded or not, or those rows of some days.

    With `days`, only these days' files are opened; lines that did not parse have no day.
    """
    _, upto, generations = _manifest(spark, root)
    batches = _batches(spark, root, upto)
    if days is None:
        return _read(spark, root, generations, batches)
    days = list(days)
    own = {d: generations[d] for d in days if d in generations}
    return _read(spark, root, own, batches).where(F.col("date").isin(days))


def compact(spark: SparkSession, root: str, upto: int | None = None) -> list[str | None]:
    """Fold the finished batches (up to number `upto`) into the state; returns the days rewritten.

    A job to run from time to time beside the stream, one at a time. Days that the batches
    don't touch keep their files. Folded rows belong to no batch any more; each day's newest
    batch is kept beside them as grain `online`. What the previous run replaced, and what a
    killed run left, is deleted first.
    """
    version, folded, generations = _manifest(spark, root)
    _forget_replaced(spark, root, version, folded, generations)
    batches = [n for n in _batches(spark, root, folded) if upto is None or n <= upto]
    if not batches:
        return []
    days = [r.date for r in _read(spark, root, {}, batches).select("date").distinct().collect()]
    rows = _read(spark, root, {d: generations[d] for d in days if d in generations}, batches)
    added = (
        merge_rollups(rows.where(F.col("grain") != "online"), [*_KEYS, "grain"])
        .withColumn("batch", F.lit(None).cast("bigint"))
        .withColumn("batch_time", F.lit(None).cast("timestamp"))
    )
    latest = _newest_batch(rows).withColumn("grain", F.lit("online"))
    (
        added.unionByName(latest)
        .hint("rebalance", F.col("date"), F.col("grain"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "static")
        .partitionBy("date", "grain")
        .parquet(f"{root}/state/gen={version + 1}")
    )
    told = [(d, g) for d, g in (generations | {d: version + 1 for d in days}).items()]
    _switch(spark, root, version + 1, batches[-1], told)
    return sorted(days, key=repr)


def _switch(spark: SparkSession, root: str, version: int, upto: int, told: list[tuple[str | None, int]]) -> None:
    """From here on readers use the new state."""
    rows = [(d, g, upto) for d, g in told] + [(None, None, upto)]
    spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{root}/manifests/version={version}")


def _forget_replaced(spark: SparkSession, root: str, version: int, folded: int, generations: dict[str | None, int]) -> None:
    for n in list_partitions(spark, f"{root}/deltas", r"batch_id=(\d+)"):
        if int(n) <= folded:
            delete(spark, f"{root}/deltas/batch_id={n}")
    kept = {(g, _day_directory(d)) for d, g in generations.items()}
    for gen in list_partitions(spark, f"{root}/state", r"gen=(\d+)"):
        folders = list_partitions(spark, f"{root}/state/gen={gen}", r"(date=.*)")
        stale = [f for f in folders if (int(gen), f) not in kept]
        if len(stale) == len(folders):
            delete(spark, f"{root}/state/gen={gen}")
        for folder in stale:
            delete(spark, f"{root}/state/gen={gen}/{folder}")
    for v in list_partitions(spark, f"{root}/manifests", r"version=(\d+)"):
        if int(v) != version:
            delete(spark, f"{root}/manifests/version={v}")


def _newest_batch(deltas: DataFrame) -> DataFrame:
    """The hourly rows of each day's newest batch."""
    rows = deltas.where(F.col("grain").isin("hour", "online") & F.col("batch").isNotNull())
    newest = rows.groupBy("date").agg(F.max("batch").alias("batch"))
    # One row per calendar day: bounded, see with_share().
    return rows.join(F.broadcast(newest), ["date", "batch"], "left_semi").select(*deltas.columns)


def grain(deltas: DataFrame, name: str) -> DataFrame:
    return deltas.where(F.col("grain") == name)


def kpis(deltas: DataFrame) -> DataFrame:
    """The running counters per day; unique hosts are exact across batches."""
    return kpis_of_rollup(grain(deltas, "hour"), grain(deltas, "host"))


def _counts(deltas: DataFrame, name: str, keys: list[str]) -> DataFrame:
    merged = merge_rollups(grain(deltas, name), ["date", *keys])
    return merged.select("date", *keys, F.col("hits").alias("count"), "last_time")


def _text_time(rows: DataFrame) -> DataFrame:
    return rows.withColumn("last_time", F.col("last_time").cast("string"))


def day_totals(deltas: DataFrame) -> DataFrame:
    return grain(deltas, "hour").groupBy("date").agg(F.sum("hits").alias("total"))


def response_codes(deltas: DataFrame) -> DataFrame:
    """Running count, last time and share per response code."""
    rows = _counts(deltas, "hour", ["response_code"])
    return with_share(_text_time(rows), day_totals(deltas))


def endpoints(deltas: DataFrame) -> DataFrame:
    """The same per endpoint, all of them."""
    rows = _counts(deltas, "endpoint", ["endpoint"])
    return with_share(_text_time(rows), day_totals(deltas))


def bad_endpoints(deltas: DataFrame) -> DataFrame:
    """Errors per endpoint and code; last time is that of any request to the endpoint."""
    rows = _counts(deltas, "endpoint", ["endpoint", "response_code"])
    last = _last_per(rows, "endpoint")
    bad = rows.withColumn("last_time", last).where(F.col("response_code") >= ERROR_CODE)
    return with_share(_text_time(bad), day_totals(deltas))


def _last_per(rows: DataFrame, key: str) -> Column:
    # At most one row per response code in each window.
    return F.max("last_time").over(Window.partitionBy("date", key))


def online(deltas: DataFrame) -> DataFrame:
    """Successful requests in each day's newest batch, with the time it was taken."""
    ok = F.when(F.col("response_code") == SUCCESS_CODE, F.col("hits"))
    return (
        _newest_batch(deltas)
        .groupBy("date")
        .agg(
            F.coalesce(F.sum(ok), F.lit(0)).alias("count"),
            F.date_format(F.max("batch_time"), "yyyy-MM-dd HH:mm:ss").alias("time"),
        )
    )


def rejects(deltas: DataFrame) -> DataFrame:
    """Lines that did not parse, per reason, over the whole stream."""
    return grain(deltas, "reject").groupBy("reject_reason").agg(F.sum("hits").alias("lines"))


def realtime_cells(deltas: DataFrame) -> DataFrame:
    """The running report as store cells; tables come in parts of bounded length, in order.

    Each grain is added up once, and one ranking serves the three tables.
    """
    hours = merge_rollups(grain(deltas, "hour"), ["date", "hour", "response_code"])
    days = hours.select("date").distinct()
    codes = merge_rollups(hours, ["date", "response_code"]).select(
        "date", F.lit("response_code").alias("qualifier"), "response_code", F.col("hits").alias("count"), "last_time"
    )
    paths = merge_rollups(grain(deltas, "endpoint"), ["date", "endpoint", "response_code"])
    entries = key_entries(paths, "endpoint", "top_endpoints", 0, "bad_unique_endpoints", ERROR_CODE)
    rows = codes.unionByName(entries, allowMissingColumns=True).withColumn("last_time", F.col("last_time").cast("string"))
    rows = rows.unionByName(empty_tables(days, list(REALTIME_TABLES)), allowMissingColumns=True)
    keys = ["endpoint", "response_code"]
    tables = table_cells(
        rows, REALTIME_TABLE, [*keys, "count", "last_time"], keys, count_as_text=False, unlimited=True
    )
    snapshot = online(deltas).withColumn("qualifier", F.lit("online_users_count"))
    snapshot = snapshot.unionByName(empty_tables(days, ["online_users_count"]), allowMissingColumns=True)
    return (
        scalar_cells(kpis_of_rollup(hours, grain(deltas, "host")), REALTIME_TABLE, REALTIME_SCALARS)
        .unionByName(tables)
        .unionByName(table_cells(snapshot, REALTIME_TABLE, ["time", "count"], ["time"], count_as_text=False))
    )
