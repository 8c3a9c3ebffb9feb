
from __future__ import annotations

import importlib
import importlib.util
from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import oracle_queries
from logloom.functions.clf import parse_lines, parse_logs, reject_counts
from logloom.operators import rollup, store
from logloom.operators.breakdown import breakdown, last_seen_join
from logloom.operators.kpis import daily_kpis
from logloom.operators.merge import carry_over, merge_reports
from logloom.operators.rollup import with_hour
from logloom.plans import daily_report, views
from logloom.schema import (
    BATCH_TABLE,
    BATCH_TABLES,
    ERROR_CODE,
    ERROR_URL_CODE,
    FAMILY,
    FREQUENT_HITS,
    REALTIME_TABLE,
    REALTIME_TABLES,
)
from logloom.session import scratch_path
from logloom.sources import files, kafka
from logloom.sources.event_lines import event_lines
from logloom.streaming import deltas
from logloom.streaming.ingest import land_lines, log_stream, watch_directories
from logloom.streaming.windows import daily_windows, read_late, read_windows, windows_with_late_lines

DAY = oracle_queries.DAY
PAGE = oracle_queries.PAGE
LOG_FIELDS = [c.strip() for c in oracle_queries.LOG_FIELDS.split(",")]
NOW = {"availableNow": True}
# Relative standard deviation that Spark's estimate of distinct values keeps to by default.
HOST_ERROR = 0.05

Query = Callable[[SparkSession, str], DataFrame]

# Tables written once per session and input, and read by several queries.
_written: dict[tuple[str, str, str], str] = {}


def forget_written() -> None:
    _written.clear()


def _once(name: str, build: Callable[[SparkSession, str, str], None]) -> Callable[..., str]:
    def path(spark: SparkSession, sf_dir: str) -> str:
        key = (spark.sparkContext.applicationId, sf_dir, name)
        if key not in _written:
            root = scratch_path(spark, name)
            build(spark, sf_dir, root)
            _written[key] = root
        return _written[key]

    return path


def _clock() -> Column:
    """When the micro-batches of the queries are processed."""
    return F.lit(oracle_queries.CLOCK).cast("timestamp")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_lines(spark, sf_dir).select("value")


def _logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_logs(_lines(spark, sf_dir))


def _halves(spark: SparkSession, sf_dir: str, root: str) -> tuple[DataFrame, DataFrame]:
    """Lines from before noon (and those without a time), lines from noon on.

    Told apart in one pass over the lines, which writes them below `root`.
    """
    parsed = with_hour(parse_lines(_lines(spark, sf_dir)))
    late = F.coalesce(F.col("hour") >= 12, F.lit(False)).cast("int").alias("late")
    parsed.select(F.col("line").alias("value"), late).write.partitionBy("late").text(root)
    both = spark.read.schema("value string, late int").text(root)
    return both.where("late = 0").select("value"), both.where("late = 1").select("value")


def _write_text(spark: SparkSession, sf_dir: str, root: str) -> None:
    _lines(spark, sf_dir).write.text(root)


def _write_logs(spark: SparkSession, sf_dir: str, root: str) -> None:
    files.write_logs(parse_lines(_lines(spark, sf_dir)), root, "all")


def _write_rollup(spark: SparkSession, sf_dir: str, root: str) -> None:
    daily_report.write_rollup(_logs(spark, sf_dir), root)


def _write_store(spark: SparkSession, sf_dir: str, root: str) -> None:
    rows = daily_report.read_rollup(spark, _rollup_root(spark, sf_dir))
    store.write_cells(daily_report.report_cells(rows), root)


def _write_deltas(spark: SparkSession, sf_dir: str, root: str) -> None:
    """The lines as a stream: half a day's worth lands, is folded, then the other half."""
    for half in _halves(spark, sf_dir, f"{root}/halves"):
        half.write.mode("append").text(f"{root}/drop")
        lines = watch_directories(spark, [f"{root}/drop"])
        deltas.report_stream(
            lines, root, f"{root}/checkpoint", trigger=NOW, store_root=f"{root}/store", clock=_clock()
        ).start().awaitTermination()


_text_root = _once("lines", _write_text)
_logs_root = _once("logs", _write_logs)
_rollup_root = _once("rollup", _write_rollup)
_store_root = _once("store", _write_store)
_deltas_root = _once("deltas", _write_deltas)

# In the order they build on each other.
STORED = {
    "lines": _text_root,
    "logs": _logs_root,
    "rollup": _rollup_root,
    "store": _store_root,
    "deltas": _deltas_root,
}


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.read_cells(spark, _store_root(spark, sf_dir))


def _deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deltas.read_deltas(spark, _deltas_root(spark, sf_dir))


# --- sources and sinks -------------------------------------------------------


def raw_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.read_lines(spark, _text_root(spark, sf_dir))


def parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _logs(spark, sf_dir).select(*LOG_FIELDS)


def bad_line_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reject_counts(parse_lines(_lines(spark, sf_dir)))


def partitioned_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.read_logs(spark, _logs_root(spark, sf_dir)).select(*LOG_FIELDS)


def partition_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = files.read_logs(spark, _logs_root(spark, sf_dir))
    return logs.where(F.col("date") == DAY).select(*LOG_FIELDS)


def partition_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.list_days(spark, _logs_root(spark, sf_dir))


def load_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines in two loads by the parity of the event: rejects as counted and as kept, by load."""
    root = scratch_path(spark, "load-rejects")
    lines = event_lines(spark, sf_dir)
    for load, rest in (("even", 0), ("odd", 1)):
        files.write_logs(parse_lines(lines.where(F.col("event_id") % 2 == rest)), root, load)
    kept = files.read_rejects(spark, root).groupBy("load", "reject_reason").agg(
        F.count("*").alias("kept"), F.min("line").alias("first_line"), F.max("line").alias("last_line")
    )
    return files.reject_totals(spark, root).join(kept, ["load", "reject_reason"])


def ingest_fan_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch_path(spark, "ingest")
    early, late = _halves(spark, sf_dir, f"{root}/halves")
    early.write.text(f"{root}/a")
    late.write.text(f"{root}/b")
    both = watch_directories(spark, [f"{root}/a", f"{root}/b"])
    land_lines(both, f"{root}/landed", f"{root}/checkpoint", trigger=NOW).start().awaitTermination()
    return files.read_lines(spark, f"{root}/landed")


# --- reports straight from the logs -----------------------------------------


def kpi_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily_kpis(_logs(spark, sf_dir))


def unique_hosts_approx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact number of hosts, and whether the estimate is within 4 standard errors of it."""
    count = F.col("unique_host_count")
    exact = daily_kpis(_logs(spark, sf_dir)).select("date", count)
    kpis = daily_kpis(_logs(spark, sf_dir), exact_hosts=False)
    near = F.abs(F.col("_estimate") - count) <= 4 * HOST_ERROR * count
    return kpis.select("date", count.alias("_estimate")).join(exact, "date").select(
        "date", count, near.alias("estimate_is_near")
    )


def response_code_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return breakdown(_logs(spark, sf_dir), ["response_code"])


def frequent_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return breakdown(_logs(spark, sf_dir), ["host"], min_count=FREQUENT_HITS, period=())


def frequent_hosts_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return breakdown(_logs(spark, sf_dir), ["host"], min_count=3)


def top_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return breakdown(_logs(spark, sf_dir), ["endpoint"])


def top_error_urls(spark: SparkSession, sf_dir: str, min_code: int = ERROR_CODE) -> DataFrame:
    return breakdown(
        _logs(spark, sf_dir),
        ["endpoint", "response_code"],
        last_seen_by=["endpoint"],
        min_code=min_code,
    )


def top_error_urls_any_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_error_urls(spark, sf_dir, ERROR_URL_CODE)


def error_hosts_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return breakdown(
        _logs(spark, sf_dir), ["host", "response_code"], last_seen_by=["host"], min_code=ERROR_CODE
    )


def error_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = with_hour(_logs(spark, sf_dir))
    return breakdown(logs, ["hour", "response_code"], min_code=ERROR_CODE, k=None).drop("last_time")


def last_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = _logs(spark, sf_dir)
    return last_seen_join(logs, ["endpoint", "response_code"], "endpoint", ERROR_CODE)


# --- merging and incremental runs --------------------------------------------


def _host_counts(logs: DataFrame) -> DataFrame:
    return logs.groupBy("date", "host").agg(
        F.count("*").alias("count"), F.max("event_time").alias("last_time")
    )


def _stored_and_new(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    logs = with_hour(_logs(spark, sf_dir))
    return (
        _host_counts(logs.where(F.col("hour") < 12)),
        _host_counts(logs.where(F.col("hour") >= 12)),
    )


def _text_time(rows: DataFrame) -> DataFrame:
    return rows.withColumn("last_time", F.col("last_time").cast("string"))


def report_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, new = _stored_and_new(spark, sf_dir)
    return _text_time(merge_reports(stored, new, ["date", "host"]))


def report_carry_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, new = _stored_and_new(spark, sf_dir)
    return _text_time(carry_over(stored, new, ["date", "host"]))


def incremental_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs: the first half of the month lands, then the rest; who did which day."""
    root = scratch_path(spark, "incremental")
    parsed = parse_lines(_lines(spark, sf_dir))
    runs = []
    for run, landed in enumerate([F.col("date") <= DAY, F.col("date") > DAY], 1):
        files.write_logs(parsed.where(landed), f"{root}/logs", f"run-{run}")
        days = daily_report.run_daily_report(
            spark, f"{root}/logs", f"{root}/rollup", f"{root}/store"
        )
        runs += [(day, run) for day in days]
    totals = store.read_cells(spark, f"{root}/store").where("qualifier = 'total_log_count'")
    return (
        spark.createDataFrame(runs, "date string, run int")
        .join(totals, F.col("row_key") == store.row_key(F.col("date")))
        .select("date", "run", F.col("value").cast("bigint").alias("total_log_count"))
    )


def late_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All cells after two loads into the same days, the second of them loaded twice."""
    root = scratch_path(spark, "late-load")
    lines = event_lines(spark, sf_dir)
    for load, rest in (("early", 0), ("late", 1), ("late", 1)):
        files.write_logs(parse_lines(lines.where(F.col("event_id") % 2 == rest)), f"{root}/logs", load)
        daily_report.run_daily_report(spark, f"{root}/logs", f"{root}/rollup", f"{root}/store")
    return store.read_cells(spark, f"{root}/store")


def changed_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each run reports: all days, then just those that a second load has lines of, then none."""
    root = scratch_path(spark, "changed-days")
    lines = event_lines(spark, sf_dir)
    runs = []
    for run, (load, rest) in enumerate([("most", F.col("event_id") % 100 > 0), ("few", F.col("event_id") % 500 == 0)], 1):
        files.write_logs(parse_lines(lines.where(rest)), f"{root}/logs", load)
        for again in range(2):
            days = daily_report.run_daily_report(spark, f"{root}/logs", f"{root}/rollup", f"{root}/store")
            runs += [(day, run, again) for day in days]
    return spark.createDataFrame(runs, "date string, run int, again int")


def unique_hosts_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weeks and months: the exact number of hosts, and whether the days' sketches come near it."""
    rows = daily_report.read_rollup(spark, _rollup_root(spark, sf_dir))
    hosts = daily_report.grain(rows, "host")
    out = None
    for span in ("week", "month"):
        start = F.date_format(F.date_trunc(span, F.to_timestamp("date")), "yyyy-MM-dd").alias("start")
        exact = hosts.groupBy(start).agg(F.count_distinct("host").alias("unique_host_count"))
        count, near = F.col("unique_host_count"), 4 * rollup.SKETCH_ERROR * F.col("unique_host_count")
        one = rollup.unique_hosts_span(rows, span).join(exact, "start").select(
            F.lit(span).alias("span"), "start", "days", count,
            (F.abs(F.col("unique_host_estimate") - count) <= F.greatest(F.lit(1.0), near)).alias("estimate_is_near"),
        )
        out = one if out is None else out.unionByName(one)
    return out


# --- the report store and its views -------------------------------------------


def report_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily_report.report_cells(daily_report.read_rollup(spark, _rollup_root(spark, sf_dir)))


def report_for_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.report_for_day(_cells(spark, sf_dir), DAY)


def report_table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = "process_top_endpoints"
    return views.table_rows(_cells(spark, sf_dir), name, BATCH_TABLES[name])


def report_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.first_page(report_table_rows(spark, sf_dir), "last_time", ["endpoint"])


def store_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.head(_cells(spark, sf_dir), BATCH_TABLE, PAGE)


def store_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.head(_cells(spark, sf_dir), BATCH_TABLE, PAGE, reverse=True)


def store_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.get_rows(_cells(spark, sf_dir), BATCH_TABLE, f"date={DAY}", "date=1999-12-31")


def store_put(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In a store of its own: revise one column of every row, add one, try an undeclared family."""
    root = scratch_path(spark, "store-put")
    stored = _cells(spark, sf_dir)
    other = stored.where("qualifier = 'total_log_count'").withColumn("table", F.lit("other"))
    store.write_cells(stored.unionByName(other), root)
    revised = stored.where("qualifier = 'unique_host_count'").withColumn("value", F.lit("revised"))
    added = (
        stored.where("qualifier = 'total_log_count'")
        .withColumn("qualifier", F.lit("note"))
        .withColumn("value", F.lit("seen"))
    )
    stray = added.withColumn("family", F.lit("undeclared"))
    puts = revised.unionByName(added).unionByName(stray)
    valid, _ = store.split_conflicts(puts, {BATCH_TABLE: [FAMILY]})
    store.put_cells(valid, root)
    return store.read_cells(spark, root)


def store_nested_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested rows, opened again with each column's position in its family."""
    nested = store.nested_rows(_cells(spark, sf_dir))
    families = nested.select("table", "rowKey", F.inline("columnFamilies"))
    return families.select(
        "table", "rowKey", F.lit(0).alias("part"), "familyName",
        F.posexplode("columnValues").alias("position", "cell"),
    ).select("table", "rowKey", "part", "familyName", "position", "cell.column", "cell.value")


def response_code_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.response_code_share(_logs(spark, sf_dir))


def daily_unique_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.daily_unique_hosts(_logs(spark, sf_dir))


def traffic_by_weekday(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.traffic_by_weekday(_logs(spark, sf_dir))


def daily_hosts_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.day_over_day(views.daily_unique_hosts(_logs(spark, sf_dir)), "unique_host_count")


def endpoint_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors per endpoint on every day, none included, with the change from the day before."""
    logs = _logs(spark, sf_dir).where(F.col("response_code") >= ERROR_CODE)
    per_day = logs.groupBy("date", "endpoint").agg(F.count("*").alias("errors"))
    return views.day_over_day(per_day, "errors", ["endpoint"])


def report_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of all six tables, read back from their cells."""
    fields = ["hour", "host", "endpoint", "response_code", "count", "last_time", "percentage"]
    cells = _cells(spark, sf_dir)
    tables = [
        views.table_rows(cells, name, columns).withColumn("qualifier", F.lit(name)) for name, columns in BATCH_TABLES.items()
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables).select("date", "qualifier", *fields)


# --- streaming ------------------------------------------------------------------


def stream_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as binary messages, decoded and parsed on the way into the log table."""
    root = scratch_path(spark, "stream-parse")
    messages = watch_directories(spark, [_text_root(spark, sf_dir)]).select(
        F.col("value").cast("binary").alias("value")
    )
    log_stream(kafka.decode(messages), f"{root}/logs", f"{root}/checkpoint", trigger=NOW).start().awaitTermination()
    return files.read_logs(spark, f"{root}/logs").select(*LOG_FIELDS)


def _window_report(logs: DataFrame, root: str) -> DataFrame:
    """Event-time day windows per code in update mode; the newest update of a key stands."""

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/updates/batch_id={batch_id}")

    (
        daily_windows(logs, ["response_code"])
        .writeStream.outputMode("update")
        .foreachBatch(keep)
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(**NOW)
        .start()
        .awaitTermination()
    )
    figures = [
        "total_log_count", "total_number_of_successful", "bad_records_count", "last_time",
    ]
    return (
        logs.sparkSession.read.option("basePath", f"{root}/updates")
        .parquet(f"{root}/updates")
        .groupBy("date", "response_code")
        .agg(*[F.max_by(c, "batch_id").alias(c) for c in figures])
    )


def stream_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = parse_logs(watch_directories(spark, [_text_root(spark, sf_dir)]))
    return _window_report(logs, scratch_path(spark, "stream-report"))


def _thirds(spark: SparkSession, sf_dir: str) -> Iterator[DataFrame]:
    """The lines of each third of the month, the newest first."""
    parsed = parse_lines(_lines(spark, sf_dir))
    day = F.dayofmonth(F.try_to_timestamp("date"))
    for low, high in [(21, 31), (11, 20), (1, 10)]:
        yield parsed.where(day.between(low, high)).select(F.col("line").alias("value"))


def late_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in a micro-batch per third of the month, the newest landing first."""
    root = scratch_path(spark, "late-report")
    for third in _thirds(spark, sf_dir):
        third.write.mode("append").text(f"{root}/drop")
        report = _window_report(parse_logs(watch_directories(spark, [f"{root}/drop"])), root)
    return report


def late_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three days of delay: per day and code the lines counted in time and those told apart as late."""
    root = scratch_path(spark, "late-lines")
    for third in _thirds(spark, sf_dir):
        third.write.mode("append").text(f"{root}/drop")
        lines = watch_directories(spark, [f"{root}/drop"])
        windows_with_late_lines(
            lines, root, f"{root}/checkpoint", "3 days", ["response_code"], trigger=NOW
        ).start().awaitTermination()
    keys = ["date", "response_code"]
    on_time = read_windows(spark, root, ["response_code"]).select(*keys, F.col("total_log_count").alias("on_time"))
    late = read_late(spark, root).groupBy(*keys).agg(F.count("*").alias("late"))
    both = on_time.join(late, keys, "full_outer")
    return both.select(*keys, *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("on_time", "late")])


def rt_kpi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deltas.kpis(_deltas(spark, sf_dir)).drop("average_content_size")


def rt_avg_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.average_size(deltas.kpis(_deltas(spark, sf_dir)))


def rt_response_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deltas.response_codes(_deltas(spark, sf_dir))


def rt_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deltas.endpoints(_deltas(spark, sf_dir))


def rt_bad_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deltas.bad_endpoints(_deltas(spark, sf_dir))


def rt_online(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deltas.online(_deltas(spark, sf_dir))


def rt_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deltas.rejects(_deltas(spark, sf_dir))


def rt_report_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deltas.realtime_cells(_deltas(spark, sf_dir))


def _rt_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store that the stream keeps current, batch by batch."""
    return store.read_cells(spark, f"{_deltas_root(spark, sf_dir)}/store")


def rt_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rt_cells(spark, sf_dir)


def rt_store_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.get_rows(_rt_cells(spark, sf_dir), REALTIME_TABLE, f"date={DAY}")


def rt_table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the three realtime tables, read back from the store with their shares."""
    fields = ["endpoint", "response_code", "count", "last_time", "percentage"]
    cells = _rt_cells(spark, sf_dir)
    tables = [
        views.realtime_rows(cells, name, columns).withColumn("qualifier", F.lit(name)) for name, columns in REALTIME_TABLES.items()
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables).select("date", "qualifier", *fields)


def rt_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures and tables of a stream in four batches, folded after the second and the fourth."""
    root = scratch_path(spark, "compacted")
    lines = event_lines(spark, sf_dir)
    for batch in range(4):
        deltas.write_delta(lines.where(F.col("event_id") % 4 == batch), batch, root, clock=_clock())
        if batch % 2:
            deltas.compact(spark, root)
    return deltas.realtime_cells(deltas.read_deltas(spark, root)).where(F.col("qualifier") != "online_users_count")


# --- contract ---------------------------------------------------------------------


def entry(spark: SparkSession) -> DataFrame:
    """The response-code report of every day."""
    return response_code_breakdown(spark, "/root/testdata/sf0.001")


def _training_data() -> tuple[dict[str, Query], dict[str, str]]:
    """Queries and SQL of the training-data operators, nothing where they are not installed."""
    if importlib.util.find_spec("logloom.llm") is None:
        return {}, {}
    if importlib.util.find_spec("logloom.llm.queries") is None:
        return {}, {}
    llm = importlib.import_module("logloom.llm.queries")
    runs, sqls = llm.queries(), llm.oracle_sql()
    if importlib.util.find_spec("corpus_pipeline") is not None:
        pipeline = importlib.import_module("corpus_pipeline")
        runs["pipeline"] = pipeline.run
        if pipeline.ORACLE_SQL:
            sqls["pipeline"] = pipeline.ORACLE_SQL
    return runs, sqls


def queries() -> dict[str, Query]:
    return _training_data()[0] | {
        "raw_scan": raw_scan,
        "load_rejects": load_rejects,
        "late_load": late_load,
        "changed_days": changed_days,
        "unique_hosts_span": unique_hosts_span,
        "endpoint_calendar": endpoint_calendar,
        "report_tables": report_tables,
        "late_lines": late_lines,
        "rt_store": rt_store,
        "rt_store_day": rt_store_day,
        "rt_table_rows": rt_table_rows,
        "rt_compacted": rt_compacted,
        "parse_logs": parse,
        "bad_line_count": bad_line_count,
        "partitioned_write": partitioned_write,
        "partition_scan": partition_scan,
        "partition_list": partition_list,
        "ingest_fan_in": ingest_fan_in,
        "kpi_daily": kpi_daily,
        "unique_hosts_approx": unique_hosts_approx,
        "response_code_breakdown": response_code_breakdown,
        "frequent_hosts": frequent_hosts,
        "frequent_hosts_daily": frequent_hosts_daily,
        "top_endpoints": top_endpoints,
        "top_error_urls": top_error_urls,
        "top_error_urls_any_code": top_error_urls_any_code,
        "error_hosts_top": error_hosts_top,
        "error_by_hour": error_by_hour,
        "last_seen_join": last_seen,
        "report_merge": report_merge,
        "report_carry_over": report_carry_over,
        "incremental_days": incremental_days,
        "report_cells": report_cells,
        "report_for_day": report_for_day,
        "report_table_rows": report_table_rows,
        "report_page": report_page,
        "store_head": store_head,
        "store_tail": store_tail,
        "store_get": store_get,
        "store_put": store_put,
        "store_nested_rows": store_nested_rows,
        "response_code_share": response_code_share,
        "daily_unique_hosts": daily_unique_hosts,
        "traffic_by_weekday": traffic_by_weekday,
        "daily_hosts_change": daily_hosts_change,
        "stream_parse": stream_parse,
        "stream_report": stream_report,
        "late_report": late_report,
        "rt_kpi": rt_kpi,
        "rt_avg_size": rt_avg_size,
        "rt_response_code": rt_response_code,
        "rt_endpoints": rt_endpoints,
        "rt_bad_endpoints": rt_bad_endpoints,
        "rt_online": rt_online,
        "rt_rejects": rt_rejects,
        "rt_report_cells": rt_report_cells,
    }


def oracle_sql() -> dict[str, str]:
    return oracle_queries.build() | _training_data()[1]
