import pytest
from helpers import line, mixed_lines, text
from pyspark.sql import functions as F

from logloom.functions.clf import parse_lines
from logloom.operators import store
from logloom.plans import daily_report, views
from logloom.schema import MARKER
from logloom.sources import files


@pytest.fixture
def roots(tmp_path):
    return {k: str(tmp_path / k) for k in ("logs", "rollup", "store")}


def _run(spark, roots, **options):
    return daily_report.run_daily_report(
        spark, roots["logs"], roots["rollup"], roots["store"], **options
    )


def _land(spark, roots, lines, load="all", **options):
    return files.write_logs(parse_lines(text(spark, lines)), roots["logs"], load, **options)


def test_rerun_of_the_parse_job_changes_nothing(spark, roots):
    for rebalance in (True, False):
        _land(spark, roots, mixed_lines(400), rebalance=rebalance)
        assert files.read_logs(spark, roots["logs"]).count() == 400


def test_loads_add_up_and_replace_only_themselves(spark, roots, tmp_path):
    many = [line(1, f"{h:02d}:00:00", "h", "/", 200) for h in range(5)]
    _land(spark, roots, many, "a")
    _land(spark, roots, [line(1, "09:00:00", "h", "/late", 200), line(2, "09:00:00", "h", "/", 200)], "b")
    assert files.read_logs(spark, roots["logs"]).count() == 7
    # The second load again, without its line of the first day.
    _land(spark, roots, [line(2, "10:00:00", "h", "/", 404)], "b")
    got = sorted((r.date, r.response_code) for r in files.read_logs(spark, roots["logs"]).collect())
    assert got == [("1995-07-01", 200)] * 5 + [("1995-07-02", 404)]
    assert {r.date: len(r.loads) for r in files.loads_by_day(spark, roots["logs"]).collect()} == {
        "1995-07-01": 1, "1995-07-02": 1
    }
    assert len([d for d in (tmp_path / "logs").iterdir() if d.name.startswith("load=b")]) == 1
    with pytest.raises(ValueError):
        _land(spark, roots, many, "no/slash")


def test_a_load_that_was_cut_short_is_not_read(spark, roots, tmp_path, monkeypatch):
    _land(spark, roots, [line(1, "01:00:00", "h", "/", 200)], "a")
    with monkeypatch.context() as m:
        m.setattr(files, "_manifests", lambda *_: 1 / 0)  # the job dies before its manifest
        with pytest.raises(ZeroDivisionError):
            _land(spark, roots, [line(1, "01:00:00", "h", "/", 404)] * 9, "a")
    assert [r.response_code for r in files.read_logs(spark, roots["logs"]).collect()] == [200]
    assert files.forget_leftovers(spark, roots["logs"]) == 1
    assert files.forget_leftovers(spark, roots["logs"]) == 0
    assert files.read_logs(spark, roots["logs"]).count() == 1


def test_rejects_are_counted_and_kept_by_load_in_one_pass(spark, roots):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    wrong = ["bad", line(1, "25:99:00", "h", "/", 200), line(1, "01:00:00", "h", "/", 200, "12abc"), None]
    lines = text(spark, [*mixed_lines(96), *wrong]).mapInArrow(counted, "value string")
    counts = files.write_logs(parse_lines(lines), roots["logs"], "a")
    assert counts == {"lines": 100, "null": 1, "pattern": 1, "size": 1, "time": 1}
    assert seen.value == 100
    _land(spark, roots, ["worse"], "only-rejects")
    _land(spark, roots, mixed_lines(10), "clean")
    kept = {(r.load, r.line, r.reject_reason) for r in files.read_rejects(spark, roots["logs"]).collect()}
    assert kept == {("a", wrong[0], "pattern"), ("a", wrong[1], "time"), ("a", wrong[2], "size"), ("a", None, "null"),
                    ("only-rejects", "worse", "pattern")}
    told = {(r.load, r.reject_reason): r.lines for r in files.reject_totals(spark, roots["logs"]).collect()}
    assert told == {(load, reason): 1 for load, _, reason in kept}
    assert files.read_logs(spark, roots["logs"]).count() == 106


def test_an_empty_load(spark, roots):
    assert _land(spark, roots, [], "none") == {"lines": 0}
    assert files.read_logs(spark, roots["logs"]).count() == 0 and _run(spark, roots) == []
    assert files.read_rejects(spark, roots["logs"]).count() == 0


def test_days_are_those_of_finished_loads(spark, roots, tmp_path):
    _land(spark, roots, mixed_lines(400))
    (tmp_path / "logs" / "load=cut.1" / "date=1995-08-01").mkdir(parents=True)
    (tmp_path / "logs" / "date=junk").mkdir()
    (tmp_path / "logs" / "_tmp").mkdir()
    days = sorted(r.date for r in files.list_days(spark, roots["logs"]).collect())
    assert days == [f"1995-07-0{d}" for d in (1, 2, 3, 4)]
    assert files.list_days(spark, str(tmp_path / "absent")).count() == 0


def test_read_some_days(spark, roots):
    _land(spark, roots, mixed_lines(400))
    some = files.read_logs(spark, roots["logs"], ["1995-07-02", "1995-07-03"])
    everything = files.read_logs(spark, roots["logs"])
    assert some.columns == everything.columns
    assert dict(some.dtypes)["date"] == "string"
    assert some.count() == everything.where("date IN ('1995-07-02', '1995-07-03')").count()
    assert files.read_logs(spark, roots["logs"], []).count() == 0


def test_second_run_takes_only_new_days(spark, roots):
    _land(spark, roots, [line(1, "01:00:00", "h", "/", 200), line(2, "01:00:00", "h", "/", 404)])
    assert _run(spark, roots) == ["1995-07-01", "1995-07-02"]
    assert _run(spark, roots) == []
    _land(spark, roots, [line(3, "01:00:00", "h", "/", 200)], "next")
    assert _run(spark, roots) == ["1995-07-03"]
    totals = store.read_cells(spark, roots["store"]).where("qualifier = 'total_log_count'")
    assert totals.count() == 3
    markers = store.read_cells(spark, roots["store"]).where(F.col("qualifier") == MARKER)
    assert {r["value"] for r in markers.collect()} == {"1"} and markers.count() == 3


def test_a_changed_day_is_pending_again_and_only_it(spark, roots):
    _land(spark, roots, [line(1, "01:00:00", "h", "/", 200), line(2, "01:00:00", "h", "/", 200)], "a")
    assert _run(spark, roots) == ["1995-07-01", "1995-07-02"]
    _land(spark, roots, [line(1, "02:00:00", "g", "/", 404)], "b")
    assert _run(spark, roots) == ["1995-07-01"]
    _land(spark, roots, [line(2, "02:00:00", "g", "/", 404)], "b")  # moves from one day to the other
    assert _run(spark, roots) == ["1995-07-01", "1995-07-02"]
    assert _run(spark, roots) == []
    assert _totals(spark, roots) == {"date=1995-07-01": "1", "date=1995-07-02": "2"}


def _totals(spark, roots):
    cells = store.read_cells(spark, roots["store"]).where("qualifier = 'total_log_count'")
    return {r["row_key"]: r["value"] for r in cells.collect()}


def test_a_day_without_any_load_loses_its_report(spark, roots):
    _land(spark, roots, [line(1, "01:00:00", "h", "/", 200)], "a")
    _land(spark, roots, [line(2, "01:00:00", "h", "/", 200)], "b")
    _run(spark, roots)
    _land(spark, roots, [line(3, "01:00:00", "h", "/", 200)], "b")
    assert _run(spark, roots) == ["1995-07-03"]
    assert _totals(spark, roots) == {"date=1995-07-01": "1", "date=1995-07-03": "1"}
    rows = daily_report.read_rollup(spark, roots["rollup"])
    assert {r.date for r in rows.select("date").distinct().collect()} == {"1995-07-01", "1995-07-03"}


def test_chosen_days_are_redone(spark, roots):
    _land(spark, roots, [line(d, "01:00:00", "h", "/", 200) for d in (1, 2, 3)])
    assert _run(spark, roots, days=["1995-07-02", "2001-01-01"]) == ["1995-07-02"]
    assert _run(spark, roots) == ["1995-07-01", "1995-07-03"]
    assert _run(spark, roots, days=["1995-07-02"]) == ["1995-07-02"]
    assert _run(spark, roots, days=[]) == []


def test_a_run_that_died_is_redone_whole(spark, roots, monkeypatch):
    """It died after the cells and before the marker and the ledger."""
    _land(spark, roots, [line(1, "01:00:00", "h", "/", 200)])
    with monkeypatch.context() as m:
        m.setattr(daily_report, "marker_cells", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            _run(spark, roots)
    cells = store.read_cells(spark, roots["store"])
    stale = cells.withColumn("value", F.lit("stale")).collect()
    store.write_cells(spark.createDataFrame(stale, cells.schema), roots["store"])
    assert _run(spark, roots) == ["1995-07-01"]
    after = store.read_cells(spark, roots["store"])
    assert after.where("value = 'stale'").count() == 0
    assert after.groupBy("row_key", "qualifier").count().where("count > 1").count() == 0


def test_pending_days_are_found_without_cells_and_logs(spark, roots):
    import contextlib
    import io

    _land(spark, roots, mixed_lines(40))
    _run(spark, roots)
    pending = daily_report.pending_days(
        files.loads_by_day(spark, roots["logs"]), daily_report.read_ledger(spark, roots["store"])
    )
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        pending.explain("formatted")
    read = {x for x in out.getvalue().splitlines() if "Location" in x}
    assert read and all("/_loads" in x or "/_ledger" in x for x in read)


def test_refresh_recomputes_and_drops_stale_cells(spark, roots):
    _land(spark, roots, [line(1, "01:00:00", "h", "/", 200, 50)])
    _run(spark, roots)
    _land(spark, roots, [line(1, "01:00:00", "h", "/", 404)])
    assert _run(spark, roots) == ["1995-07-01"]
    assert _run(spark, roots) == []
    assert _run(spark, roots, mode="refresh") == ["1995-07-01"]
    values = {r["qualifier"]: r["value"] for r in store.read_cells(spark, roots["store"]).collect()}
    assert values["bad_records_count"] == "1"
    assert "average_content_size" not in values  # no success that day, so no cell
    with pytest.raises(ValueError):
        _run(spark, roots, mode="sometimes")


def test_hosts_of_a_span_from_the_sketches_of_its_days(spark, roots):
    from logloom.operators import rollup

    days = [(d, f"h{i}") for d in range(1, 15) for i in range(d * 100, d * 100 + 400)]
    _land(spark, roots, [line(d, "01:00:00", h, "/", 200) for d, h in days])
    _run(spark, roots)
    rows = daily_report.read_rollup(spark, roots["rollup"])
    exact = {}
    for d, h in days:  # weeks begin on the third and the tenth; the first two are a Saturday and a Sunday
        exact.setdefault("1995-06-26" if d < 3 else "1995-07-03" if d < 10 else "1995-07-10", set()).add(h)
    got = {r.start: r for r in rollup.unique_hosts_span(rows, "week").collect()}
    assert set(got) == set(exact) and sum(r.days for r in got.values()) == 14
    for start, hosts in exact.items():
        assert abs(got[start].unique_host_estimate - len(hosts)) <= 4 * rollup.SKETCH_ERROR * len(hosts)
    # Neither the hosts nor the logs are needed for it.
    files.delete(spark, f"{roots['rollup']}/grain=host")
    files.delete(spark, roots["logs"])
    month = rollup.unique_hosts_span(daily_report.read_rollup(spark, roots["rollup"]), "month").collect()
    assert len(month) == 1 and month[0].days == 14


def test_page_sorts_numbers_as_numbers(spark):
    rows = spark.createDataFrame(
        [("d", f"/{i}", i) for i in range(1, 30)], "date string, endpoint string, count bigint"
    )
    page = views.first_page(rows, "count", ["endpoint"]).orderBy("rank").collect()
    assert [r["count"] for r in page] == list(range(29, 19, -1))
    page = views.first_page(rows, "count", ["endpoint"], descending=False, page_rows=3)
    assert [r["count"] for r in page.orderBy("rank").collect()] == [1, 2, 3]


def test_share_shows_codes_without_hits(spark):
    from logloom.functions.clf import parse_logs

    lines = [line(1, "01:00:00", "h", "/", c) for c in (200, 200, 200, 418)]
    rows = views.response_code_share(parse_logs(text(spark, lines))).collect()
    shares = {r["response_code"]: (r["count"], r["percentage"]) for r in rows}
    assert shares[200] == (3, 75.0) and shares[418] == (1, 25.0) and shares[500] == (0, 0.0)
    assert len(shares) == 8
    assert {(r["biggest"], r["smallest"]) for r in rows} == {(75.0, 0.0)}


def test_day_over_day_shows_every_calendar_day(spark):
    df = spark.createDataFrame([("1995-07-01", 5), ("1995-07-02", 10), ("1995-07-04", 15), ("1995-07-05", 0)], "date string, n bigint")
    rows = {r["date"][-2:]: (r["n"], r["previous"], r["change_pct"]) for r in views.day_over_day(df, "n").collect()}
    assert rows == {"01": (5, None, None), "02": (10, 5, 100.0), "03": (0, 10, -100.0), "04": (15, 0, None), "05": (0, 15, -100.0)}
    assert views.day_over_day(df.limit(0), "n").count() == 0


def test_calendar_by_key(spark):
    df = spark.createDataFrame([("1995-07-01", "a", 1), ("1995-07-03", "b", 2)], "date string, k string, n bigint")
    rows = {(r["date"][-2:], r["k"]): (r["n"], r["previous"]) for r in views.day_over_day(df, "n", ["k"]).collect()}
    assert rows == {("01", "a"): (1, None), ("02", "a"): (0, 1), ("03", "a"): (0, 0),
                    ("01", "b"): (0, None), ("02", "b"): (0, 0), ("03", "b"): (2, 0)}


def test_average_size_rounds_half_up_and_guards_zero(spark):
    df = spark.createDataFrame(
        [("a", 5, 2), ("b", 0, 0)],
        "date string, total_content_size bigint, total_number_of_successful bigint",
    )
    assert {tuple(r) for r in views.average_size(df).collect()} == {("a", 3), ("b", None)}
