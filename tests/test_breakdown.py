import pytest
from helpers import brute_breakdown, mixed_lines, text
from pyspark.sql import functions as F

from logloom.functions.clf import parse_logs
from logloom.operators.breakdown import breakdown, last_seen_join
from logloom.operators.kpis import daily_kpis, kpis_of_rollup
from logloom.operators.rollup import GRAINS, measures, merge_rollups, rollup, with_hour
from logloom.operators.topk import top_k


@pytest.fixture(scope="module")
def logs(spark):
    return with_hour(parse_logs(text(spark, mixed_lines())))


@pytest.fixture(scope="module")
def rows(logs):
    return [r.asDict() for r in logs.collect()]


@pytest.mark.parametrize(
    "keys, last_by, options",
    [
        (["response_code"], ["response_code"], {}),
        (["host"], ["host"], {"min_count": 10}),
        (["endpoint"], ["endpoint"], {}),
        (["endpoint", "response_code"], ["endpoint"], {"min_code": 200}),
        (["endpoint", "response_code"], ["endpoint"], {"min_code": 400}),
        (["host", "response_code"], ["host"], {"min_code": 400}),
        (["host", "response_code"], ["host"], {"min_code": 400, "k": 3}),
    ],
)
def test_breakdown_equals_brute_force(logs, rows, keys, last_by, options):
    got = {
        (r["date"], *[r[c] for c in keys]): (r["count"], r["last_time"], r["percentage"])
        for r in breakdown(logs, keys, last_seen_by=last_by, **options).collect()
    }
    assert got == brute_breakdown(rows, keys, last_by, **options)


def test_whole_range_breakdown(logs, rows):
    got = breakdown(logs, ["host"], period=(), k=5).collect()
    everything = [dict(r, date="all") for r in rows]
    want = brute_breakdown(everything, ["host"], ["host"], k=5)
    assert {("all", r["host"]): (r["count"], r["last_time"], r["percentage"]) for r in got} == want


def test_windowed_form_equals_join_form(logs):
    keys = ["endpoint", "response_code"]
    windowed = breakdown(logs, keys, last_seen_by=["endpoint"], min_code=400, k=None)
    joined = last_seen_join(logs, keys, "endpoint", 400)
    columns = joined.columns
    assert sorted(map(tuple, windowed.select(*columns).collect())) == sorted(
        map(tuple, joined.collect())
    )


def test_rollup_in_one_pass_equals_separate_aggregations(logs):
    one = rollup(logs, GRAINS)
    for name, keys in GRAINS.items():
        columns = ["date", *keys, "hits", "bytes", "last_time"]
        separate = logs.groupBy("date", *keys).agg(*measures()).select(*columns)
        mine = one.where(F.col("grain") == name).select(*columns)
        assert sorted(map(tuple, mine.collect())) == sorted(map(tuple, separate.collect()))


def test_rollup_keeps_absent_keys_apart_from_null_keys(spark):
    logs = spark.createDataFrame(
        [("d", None, 200), ("d", "h", 200)], "date string, host string, response_code int"
    ).selectExpr("*", "1L AS content_size", "timestamp_ntz'2000-01-01 00:00:00' AS event_time")
    got = rollup(logs, {"host": ["host"], "day": []}).select("grain", "host", "hits").collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(
        map(str, [("host", None, 1), ("host", "h", 1), ("day", None, 2)])
    )


def test_rollup_rejects_equal_grains(logs):
    with pytest.raises(ValueError):
        rollup(logs, {"a": ["host"], "b": ["host"]})


def test_rollup_is_mergeable(logs):
    halves = [rollup(logs.where(c), GRAINS) for c in ("hour < 9", "hour >= 9")]
    keys = ["grain", "date", "hour", "response_code", "host", "endpoint"]
    merged = merge_rollups(halves[0].unionByName(halves[1]), keys)
    whole = rollup(logs, GRAINS).select(*merged.columns)
    assert sorted(map(str, merged.collect())) == sorted(map(str, whole.collect()))


def test_kpis_of_rollup_equal_direct_kpis(logs):
    both = rollup(logs, GRAINS)
    rolled = kpis_of_rollup(
        both.where("grain = 'hour'"), both.where("grain = 'host'")
    )
    direct = daily_kpis(logs)
    assert sorted(map(tuple, rolled.select(*direct.columns).collect())) == sorted(
        map(tuple, direct.collect())
    )


def test_kpis_against_brute_force(logs, rows):
    for r in daily_kpis(logs).collect():
        day = [x for x in rows if x["date"] == r["date"]]
        ok = [x["content_size"] for x in day if x["response_code"] == 200]
        assert r["total_log_count"] == len(day)
        assert r["total_number_of_successful"] == len(ok)
        assert r["total_failed_access"] == len(day) - len(ok)
        assert r["total_content_size"] == sum(ok)
        assert r["average_content_size"] == pytest.approx(sum(ok) / len(ok))
        assert r["unique_host_count"] == len({x["host"] for x in day})
        assert r["bad_records_count"] == sum(x["response_code"] >= 400 for x in day)


def test_day_without_success_has_no_average(spark):
    from helpers import line

    logs = parse_logs(text(spark, [line(1, "00:00:00", "h", "/", 404)]))
    row = daily_kpis(logs).collect()[0]
    assert row["average_content_size"] is None and row["total_content_size"] == 0


def test_estimated_hosts_are_close(spark):
    lines = [f'h{i} - - [01/Jul/1995:00:00:00 -0400] "GET / HTTP/1.0" 200 1' for i in range(5000)]
    logs = parse_logs(text(spark, lines))
    estimate = daily_kpis(logs, exact_hosts=False).collect()[0]["unique_host_count"]
    assert abs(estimate - 5000) < 5000 * 0.15


@pytest.mark.parametrize("k", [1, 20, 1000, 1500])
def test_top_k_whatever_k(spark, k):
    df = spark.range(4000).selectExpr("'d' AS date", "id", "(id * 37) % 101 AS n")
    got = top_k(df, k, [F.col("n").desc(), F.col("id").asc()], ["date"]).collect()
    want = sorted(((-((i * 37) % 101), i) for i in range(4000)))[:k]
    assert [(r["rank"], r["id"]) for r in sorted(got, key=lambda r: r["rank"])] == [
        (n, i) for n, (_, i) in enumerate(want, 1)
    ]
