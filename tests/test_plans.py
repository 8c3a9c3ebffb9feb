"""What Spark makes of the queries: pruning, scans, aggregation, skew."""

import contextlib
import io

import pytest
from helpers import line, mixed_lines, text

from logloom.functions.clf import parse_lines, parse_logs
from logloom.operators.breakdown import breakdown
from logloom.operators.kpis import daily_kpis
from logloom.operators.rollup import GRAINS, rollup, with_hour
from logloom.plans import daily_report
from logloom.sources import files
from logloom.streaming import deltas


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("simple")
    return out.getvalue()


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("logs"))
    files.write_logs(parse_lines(text(spark, mixed_lines(800))), path, "all")
    return path


@pytest.fixture(scope="module")
def logs(spark, root):
    return files.read_logs(spark, root)


def test_day_filter_prunes_partitions(logs):
    p = plan(logs.where("date = '1995-07-02'"))
    assert "PartitionFilters: [isnotnull(date" in p
    assert "PushedFilters: []" in p


def test_code_filter_and_columns_reach_the_scan(logs):
    p = plan(logs.where("response_code >= 400").select("host"))
    assert "GreaterThanOrEqual(response_code,400)" in p
    assert "ReadSchema: struct<host:string,response_code:int>" in p


@pytest.mark.parametrize(
    "make",
    [
        lambda logs: daily_kpis(logs),
        lambda logs: breakdown(logs, ["endpoint"]),
        lambda logs: breakdown(
            logs, ["host", "response_code"], last_seen_by=["host"], min_code=400
        ),
        lambda logs: rollup(with_hour(logs), GRAINS),
    ],
)
def test_one_scan_and_hash_aggregation(logs, make):
    p = plan(make(logs))
    assert p.count("FileScan") == 1
    assert "HashAggregate" in p
    assert "SortAggregate" not in p and "ObjectHashAggregate" not in p
    assert "Python" not in p and "CartesianProduct" not in p


@pytest.mark.parametrize("period", [("date",), ()])
def test_top_rows_are_trimmed_before_the_shuffle(logs, period):
    p = plan(breakdown(logs, ["host"], period=period))
    trimmed = "WindowGroupLimit" in p and "Partial" in p
    assert trimmed or "TakeOrderedAndProject" in p


def test_parse_matches_each_line_once(spark):
    p = plan(parse_logs(text(spark, ["x"])))
    assert p.count("regexp_replace") == 1 and "regexp_extract" not in p


def test_running_tables_do_not_shuffle_for_the_share(spark, tmp_path):
    deltas.write_delta(text(spark, mixed_lines(100)), 0, str(tmp_path))
    p = plan(deltas.endpoints(deltas.read_deltas(spark, str(tmp_path))))
    assert "BroadcastHashJoin" in p and "SortMergeJoin" not in p


def test_one_day_of_the_running_report_opens_that_day_only(spark, tmp_path):
    root = str(tmp_path)
    for i in range(4):
        deltas.write_delta(text(spark, mixed_lines(200)), i, root)
        if i == 1:
            deltas.compact(spark, root)
    whole = {(r.grain, r.hits) for r in deltas.read_deltas(spark, root).where("date = '1995-07-02'").collect()}
    # The files of all other days may be gone.
    for folder in [*tmp_path.glob("state/gen=*/date=*"), *tmp_path.glob("deltas/batch_id=*/date=*")]:
        if folder.name != "date=1995-07-02":
            files.delete(spark, str(folder))
    day = deltas.read_deltas(spark, root, ["1995-07-02"])
    assert {(r.grain, r.hits) for r in day.collect()} == whole


def test_rollup_reads_only_the_grain_asked_for(spark, root, tmp_path):
    path = str(tmp_path / "rollup")
    daily_report.write_rollup(files.read_logs(spark, root), path)
    hours = daily_report.grain(daily_report.read_rollup(spark, path), "hour")
    assert all("grain=hour" in f for f in hours.inputFiles()) or "PartitionFilters: [isnotnull(grain" in plan(hours)


def test_a_large_day_is_written_by_many_tasks(spark, tmp_path):
    """One day holds nearly all rows; it must not end up in one task."""
    many = spark.range(60000).selectExpr(
        "concat('h', id % 9973, ' - - [01/Jul/1995:00:00:01 -0400] \"GET /', uuid(), "
        "' HTTP/1.0\" 200 ', id) AS value"
    ).unionByName(text(spark, [line(2, "00:00:00", "h", "/", 200)]))
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "256k")
    try:
        files.write_logs(parse_lines(many), str(tmp_path / "logs"), "all")
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
    big = list((tmp_path / "logs").glob("load=*/date=1995-07-01/*.parquet"))
    assert len(big) > 3
    assert files.read_logs(spark, str(tmp_path / "logs")).count() == 60001


def test_a_hot_host_leaves_each_task_as_one_row(spark, logs):
    """Two aggregation steps around the shuffle: a partial one, then the final one."""
    p = plan(breakdown(logs, ["host"]))
    assert "partial_count(1)" in p


def test_share_scans_the_logs_once(logs):
    from logloom.plans.views import response_code_share

    assert plan(response_code_share(logs)).count("FileScan") == 1
