import json

import pytest
from helpers import line, mixed_lines, text

from logloom.functions.clf import parse_logs
from logloom.operators.breakdown import breakdown
from logloom.operators.kpis import daily_kpis
from logloom.plans import views
from logloom.schema import REALTIME_SCALARS, REALTIME_TABLES
from logloom.sources import kafka
from logloom.streaming import deltas
from logloom.streaming.ingest import land_lines, watch_directories
from logloom.streaming.windows import daily_windows

NOW = {"availableNow": True}


def _rows(df, *columns):
    return sorted(map(str, (tuple(r) for r in (df.select(*columns) if columns else df).collect())))


def _drop(spark, lines, path):
    text(spark, lines).coalesce(1).write.mode("append").text(path)


def _stream(spark, tmp_path, **options):
    root = str(tmp_path)
    lines = watch_directories(spark, [f"{root}/drop"], files_per_batch=1)
    deltas.report_stream(
        lines, root, f"{root}/checkpoint", trigger=NOW, **options
    ).start().awaitTermination()
    return root


def _chunks(lines, n):
    return [lines[i::n] for i in range(n)]


def _same_as_batch(spark, root, lines):
    logs = parse_logs(text(spark, lines))
    d = deltas.read_deltas(spark, root)
    kpis = daily_kpis(logs)
    assert _rows(deltas.kpis(d), *kpis.columns) == _rows(kpis)
    for got, keys, options in [
        (deltas.response_codes(d), ["response_code"], {}),
        (deltas.endpoints(d), ["endpoint"], {}),
        (deltas.bad_endpoints(d), ["endpoint", "response_code"],
         {"last_seen_by": ["endpoint"], "min_code": 400}),
    ]:
        want = breakdown(logs, keys, k=None, **options)
        assert _rows(got, *want.columns) == _rows(want)


def test_folded_deltas_equal_the_batch_report(spark, tmp_path):
    lines = mixed_lines(900)
    for chunk in _chunks(lines, 3):
        _drop(spark, [*chunk, "broken line"], str(tmp_path / "drop"))
    root = _stream(spark, tmp_path)
    _same_as_batch(spark, root, lines)
    assert _rows(deltas.rejects(deltas.read_deltas(spark, root))) == ["('pattern', 3)"]


def test_restart_takes_each_file_once_and_a_late_day_counts(spark, tmp_path):
    first = [line(5, "10:00:00", "a", "/x", 200), line(5, "11:00:00", "b", "/x", 404)]
    late = [line(1, "10:00:00", "a", "/x", 500), line(5, "09:00:00", "a", "/x", 404)]
    _drop(spark, first, str(tmp_path / "drop"))
    root = _stream(spark, tmp_path)
    _stream(spark, tmp_path)  # nothing new
    _same_as_batch(spark, root, first)
    _drop(spark, late, str(tmp_path / "drop"))
    _stream(spark, tmp_path)
    _same_as_batch(spark, root, first + late)


def test_batch_delivered_twice_counts_once(spark, tmp_path):
    lines = mixed_lines(200)
    for _ in range(2):
        deltas.write_delta(text(spark, lines), 0, str(tmp_path))
    deltas.write_delta(text(spark, lines[:50]), 1, str(tmp_path))
    _same_as_batch(spark, str(tmp_path), lines + lines[:50])


def test_empty_batch(spark, tmp_path):
    deltas.write_delta(text(spark, []), 0, str(tmp_path))
    assert deltas.kpis(deltas.read_deltas(spark, str(tmp_path))).count() == 0
    deltas.write_delta(text(spark, mixed_lines(50)), 1, str(tmp_path))
    _same_as_batch(spark, str(tmp_path), mixed_lines(50))


def test_no_deltas_yet(spark, tmp_path):
    assert deltas.read_deltas(spark, str(tmp_path)).count() == 0


def _written(tmp_path):
    return {p: p.stat().st_mtime_ns for p in tmp_path.glob("state/gen=*/date=*/grain=*/*.parquet")}


def test_compaction_changes_no_figure(spark, tmp_path):
    root, lines = str(tmp_path), mixed_lines(700)
    chunks = _chunks(lines, 7)
    for i, chunk in enumerate(chunks):
        deltas.write_delta(text(spark, [*chunk, "broken"]), i, root)
    before = _rows(deltas.online(deltas.read_deltas(spark, root)))
    for upto, folded in [(1, 2), (1, 0), (3, 2), (None, 3), (None, 0)]:
        assert len(deltas.compact(spark, root, upto)) == (5 if folded else 0)
        _same_as_batch(spark, root, lines)
    d = deltas.read_deltas(spark, root)
    assert _rows(deltas.online(d)) == before
    assert _rows(deltas.rejects(d)) == ["('pattern', 7)"]
    assert all("/state/gen=3/" in f for f in d.inputFiles())
    assert not list(tmp_path.glob("deltas/batch_id=*")) and not list(tmp_path.glob("state/gen=2/*"))


def test_days_without_new_lines_are_not_rewritten(spark, tmp_path):
    root = str(tmp_path)
    lines = [line(d, "10:00:00", f"h{d}", "/", 200) for d in (1, 2, 3)]
    deltas.write_delta(text(spark, lines), 0, root)
    assert deltas.compact(spark, root) == ["1995-07-01", "1995-07-02", "1995-07-03"]
    first = _written(tmp_path)
    more = [line(2, "11:00:00", "late", "/", 404)]
    deltas.write_delta(text(spark, more), 1, root)
    assert deltas.compact(spark, root) == ["1995-07-02"]
    _same_as_batch(spark, root, lines + more)
    deltas.compact(spark, root)  # forgets what was replaced
    kept = {p: t for p, t in first.items() if "date=1995-07-02" not in str(p)}
    after = _written(tmp_path)
    assert kept and kept.items() <= after.items()
    assert {p.parent.parent.name for p in after.keys() - kept.keys()} == {"date=1995-07-02"}
    _same_as_batch(spark, root, lines + more)
    one = deltas.read_deltas(spark, root, ["1995-07-02"])
    assert {r.date for r in one.select("date").distinct().collect()} == {"1995-07-02"}


@pytest.mark.parametrize("where", ["_switch", "_forget_replaced"])
def test_a_killed_compaction_loses_and_doubles_nothing(spark, tmp_path, monkeypatch, where):
    root, lines = str(tmp_path), mixed_lines(300)
    for i, chunk in enumerate(_chunks(lines, 3)):
        deltas.write_delta(text(spark, chunk), i, root)
        if i < 2:
            deltas.compact(spark, root)
    with monkeypatch.context() as m:
        m.setattr(deltas, where, lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            deltas.compact(spark, root)
    _same_as_batch(spark, root, lines)
    for _ in range(2):
        deltas.compact(spark, root)
        _same_as_batch(spark, root, lines)


def test_a_reader_under_way_outlives_a_compaction(spark, tmp_path):
    root, lines = str(tmp_path), mixed_lines(200)
    for i, chunk in enumerate(_chunks(lines, 2)):
        deltas.write_delta(text(spark, chunk), i, root)
    d = deltas.read_deltas(spark, root)
    deltas.compact(spark, root)
    assert sum(r["total_log_count"] for r in deltas.kpis(d).collect()) == 200


def test_each_batch_renews_the_realtime_rows_of_its_days_only(spark, tmp_path):
    from logloom.operators import store

    root, rows = str(tmp_path), f"{tmp_path}/rows"
    first = [line(1, "10:00:00", "a", "/x", 200), line(2, "10:00:00", "b", "/x", 404)]
    _drop(spark, [*first, "broken"], f"{root}/drop")
    _stream(spark, tmp_path, store_root=rows)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "rows").rglob("*.parquet")}
    late = [line(2, "11:00:00", "c", "/y", 200)]
    _drop(spark, late, f"{root}/drop")
    _stream(spark, tmp_path, store_root=rows)
    cells = store.read_cells(spark, rows)
    want = deltas.realtime_cells(deltas.read_deltas(spark, root))
    assert _rows(cells) == _rows(want)
    after = {p: p.stat().st_mtime_ns for p in (tmp_path / "rows").rglob("*.parquet")}
    of_day = lambda files: {(p, t) for p, t in files.items() if "1995-07-01" in str(p)}
    assert of_day(before) and of_day(before) == of_day(after)
    day = store.get_rows(cells, "log_analysis_realtime", "date=1995-07-02").collect()
    assert {r["value"] for r in day if r["qualifier"] == "unique_host_count"} == {"2"}


def test_realtime_tables_come_back_with_their_shares(spark, tmp_path):
    lines = mixed_lines(300)
    deltas.write_delta(text(spark, lines), 0, str(tmp_path))
    d = deltas.read_deltas(spark, str(tmp_path))
    cells = deltas.realtime_cells(d)
    for name, want in [("response_code", deltas.response_codes(d)), ("top_endpoints", deltas.endpoints(d)),
                       ("bad_unique_endpoints", deltas.bad_endpoints(d))]:
        got = views.realtime_rows(cells, name, REALTIME_TABLES[name])
        assert _rows(got, *want.columns) == _rows(want)


def test_late_lines_go_aside_and_nothing_is_lost(spark, tmp_path):
    from logloom.streaming.windows import read_late, read_windows, windows_with_late_lines

    root = str(tmp_path)

    def run(lines):
        _drop(spark, lines, f"{root}/drop")
        source = watch_directories(spark, [f"{root}/drop"])
        windows_with_late_lines(source, root, f"{root}/checkpoint", "1 day", trigger=NOW).start().awaitTermination()
        days = {r["date"][-2:]: r["total_log_count"] for r in read_windows(spark, root).collect()}
        return days, sorted(r["date"][-2:] for r in read_late(spark, root).collect())

    at = lambda day, clock="12:00:00": line(day, clock, "a", "/", 200)
    assert run([at(5), at(1)]) == ({"05": 1, "01": 1}, [])  # nothing is late in the first batch
    # Until 4 July 12:00: the third is closed, the fourth is not.
    assert run([at(4), at(3), at(3, "23:59:59"), "broken"]) == ({"05": 1, "01": 1, "04": 1}, ["03", "03"])
    assert run([at(9)]) == ({"05": 1, "01": 1, "04": 1, "09": 1}, ["03", "03"])
    assert run([at(5)]) == ({"05": 1, "01": 1, "04": 1, "09": 1}, ["03", "03", "05"])


@pytest.mark.parametrize("limit", [50, 1000, 100_000])
def test_files_roll_by_bytes(spark, tmp_path, limit):
    root = str(tmp_path)
    lines = [("x" * (i * 37 % 90)) + str(i) for i in range(400)] + ["y" * 3000, "", "é" * 20]
    _drop(spark, lines, f"{root}/drop")
    source = watch_directories(spark, [f"{root}/drop"])
    land_lines(source, f"{root}/landed", f"{root}/checkpoint", roll_bytes=limit, trigger=NOW).start().awaitTermination()
    from logloom.sources import files

    assert sorted(r.value for r in files.read_lines(spark, f"{root}/landed").collect()) == sorted(lines)
    landed = {p: p.read_bytes().splitlines(True) for p in (tmp_path / "landed").glob("roll=*/*.txt")}
    by_roll = sorted((int(p.parent.name[5:]), rows) for p, rows in landed.items())
    for (_, rows), after in zip(by_roll, [*by_roll[1:], None]):
        size = sum(map(len, rows))
        assert size <= limit or len(rows) == 1
        if after:  # it was full: the next line would have taken it over
            assert size + len(after[1][0]) > limit
    assert len(by_roll) >= sum(len(x.encode()) + 1 for x in lines) // max(limit, 3001)


def test_rolls_go_on_over_the_batches_of_a_task(spark):
    from logloom.streaming.ingest import with_rolls

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = with_rolls(text(spark, ["abc"] * 100).coalesce(1), 40).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert [r["roll"] for r in rows] == [i // 10 for i in range(100)]


def test_a_stream_into_the_log_table_may_be_replayed(spark, tmp_path):
    from logloom.functions.clf import parse_lines
    from logloom.plans.daily_report import run_daily_report
    from logloom.sources import files
    from logloom.streaming.ingest import log_stream

    root = str(tmp_path)
    roots = [f"{root}/{x}" for x in ("logs", "rollup", "store")]

    def run(lines):
        _drop(spark, lines, f"{root}/drop")
        source = watch_directories(spark, [f"{root}/drop"])
        log_stream(source, roots[0], f"{root}/checkpoint", trigger=NOW).start().awaitTermination()
        return run_daily_report(spark, *roots)

    first, second = mixed_lines(100), [line(2, "10:00:00", "late", "/", 200)]
    assert len(run([*first, "broken"])) == 4
    assert run(second) == ["1995-07-02"]
    # The second batch is delivered again.
    files.write_logs(parse_lines(text(spark, second)), roots[0], "stream-1")
    assert files.read_logs(spark, roots[0]).count() == 101
    assert {(r.load, r.lines) for r in files.reject_totals(spark, roots[0]).collect()} == {("stream-0", 1)}


def test_snapshot_shows_the_newest_batch_of_each_day(spark, tmp_path):
    root = str(tmp_path)
    ok, bad = (line(d, "10:00:00", "a", "/", c) for d, c in ((1, 200), (1, 404)))
    other_day = line(2, "10:00:00", "a", "/", 200)
    for i, lines in enumerate([[ok, ok, other_day], [ok, bad], [bad]]):
        deltas.write_delta(text(spark, lines), i, root)
        online = deltas.online(deltas.read_deltas(spark, root)).collect()
        counts = {r["date"]: r["count"] for r in online}
        assert counts == {"1995-07-01": [2, 1, 0][i], "1995-07-02": 1}
        assert all(len(r["time"]) == 19 for r in online)


def test_day_from_processing_time(spark, tmp_path):
    root = str(tmp_path)
    lines = [line(1, "10:00:00", "a", "/", 200), line(2, "10:00:00", "b", "/", 200), "broken"]
    deltas.write_delta(text(spark, lines), 0, root, day_from="processing")
    today = str(spark.sql("SELECT current_date()").collect()[0][0])
    row = deltas.kpis(deltas.read_deltas(spark, root)).collect()
    assert [(r["date"], r["total_log_count"], r["unique_host_count"]) for r in row] == [
        (today, 2, 2)
    ]
    with pytest.raises(ValueError):
        deltas.batch_delta(text(spark, lines), 0, day_from="moon")


def test_realtime_cells(spark, tmp_path):
    deltas.write_delta(text(spark, mixed_lines(300)), 0, str(tmp_path))
    cells = deltas.realtime_cells(deltas.read_deltas(spark, str(tmp_path))).collect()
    by_day = {}
    for c in cells:
        by_day.setdefault(c["row_key"], {})[c["qualifier"]] = c["value"]
    for day in by_day.values():
        assert set(day) == {*REALTIME_SCALARS, *REALTIME_TABLES, "online_users_count"}
        for name, fields in REALTIME_TABLES.items():
            for item in json.loads(day[name]):
                assert list(item) == fields and isinstance(item["count"], int)
        assert isinstance(json.loads(day["online_users_count"])[0]["count"], int)


def test_also_runs_on_each_batch(spark, tmp_path):
    seen = []
    _drop(spark, mixed_lines(20), str(tmp_path / "drop"))
    _stream(spark, tmp_path, also=lambda batch, i: seen.append((i, batch.count(), batch.is_cached)))
    assert seen == [(0, 20, True)]


def test_fan_in_lands_each_file_once(spark, tmp_path):
    root = str(tmp_path)
    _drop(spark, ["a1", "a2"], f"{root}/a")
    _drop(spark, ["b1"], f"{root}/b")

    def run():
        both = watch_directories(spark, [f"{root}/a", f"{root}/b"])
        land_lines(both, f"{root}/landed", f"{root}/checkpoint", trigger=NOW).start().awaitTermination()
        return sorted(r.value for r in spark.read.text(f"{root}/landed").collect())

    assert run() == ["a1", "a2", "b1"]
    assert run() == ["a1", "a2", "b1"]
    _drop(spark, ["b2"], f"{root}/b")
    assert run() == ["a1", "a2", "b1", "b2"]
    with pytest.raises(ValueError):
        watch_directories(spark, [])


@pytest.mark.parametrize("zone", ["UTC", "Asia/Tokyo"])
def test_native_day_windows(spark, tmp_path, zone):
    lines = [
        line(1, "00:00:00", "a", "/", 200), line(1, "23:59:59", "b", "/", 404),
        line(2, "00:00:00", "a", "/", 200),
    ]
    _drop(spark, lines, str(tmp_path / "drop"))
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        logs = parse_logs(watch_directories(spark, [str(tmp_path / "drop")]))
        name = "windows_" + zone.replace("/", "_")
        daily_windows(logs).writeStream.outputMode("complete").format("memory").queryName(
            name
        ).trigger(**NOW).start().awaitTermination()
        rows = spark.table(name).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert {
        (r["date"], r["total_log_count"], r["bad_records_count"], r["unique_host_estimate"],
         r["last_time"]) for r in rows
    } == {
        ("1995-07-01", 2, 1, 2, "1995-07-01 23:59:59"),
        ("1995-07-02", 1, 0, 1, "1995-07-02 00:00:00"),
    }


def test_unfinished_compaction_and_batch_are_not_read(spark, tmp_path):
    root = str(tmp_path)
    for i in range(2):
        deltas.write_delta(text(spark, [line(1, "10:00:00", "a", "/", 200)] * (i + 1)), i, root)
    for left in ("manifests/version=1/_temporary/0", "deltas/batch_id=2/_temporary/0"):
        (tmp_path / left).mkdir(parents=True)
    total = deltas.kpis(deltas.read_deltas(spark, root)).collect()[0]["total_log_count"]
    assert total == 3
    deltas.compact(spark, root)
    assert deltas.kpis(deltas.read_deltas(spark, root)).collect()[0]["total_log_count"] == 3


def test_kafka_options_and_decoding(spark):
    source = kafka.source_options("broker:9092", "weblog")
    assert source == {
        "kafka.bootstrap.servers": "broker:9092",
        "subscribe": "weblog",
        "startingOffsets": "latest",
        "failOnDataLoss": "false",
    }
    assert kafka.sink_options("broker:9092", "weblog") == {
        "kafka.bootstrap.servers": "broker:9092", "topic": "weblog",
    }
    raw = text(spark, ["x y"]).selectExpr("CAST(value AS BINARY) AS value", "1 AS partition")
    assert [tuple(r) for r in kafka.decode(raw).collect()] == [("x y",)]


def test_running_average(spark, tmp_path):
    lines = [line(1, "10:00:00", "a", "/", 200, s) for s in (1, 2)]
    deltas.write_delta(text(spark, lines), 0, str(tmp_path))
    d = deltas.read_deltas(spark, str(tmp_path))
    assert [tuple(r) for r in views.average_size(deltas.kpis(d)).collect()] == [("1995-07-01", 2)]


def test_realtime_tables_without_rows_have_their_cells(spark, tmp_path):
    deltas.write_delta(text(spark, [line(1, "10:00:00", "a", "/", 200)]), 0, str(tmp_path))
    cells = deltas.realtime_cells(deltas.read_deltas(spark, str(tmp_path))).collect()
    values = {(c["qualifier"], c["part"]): c["value"] for c in cells}
    assert values[("bad_unique_endpoints", 0)] == "[]"
    assert len(values) == len(REALTIME_SCALARS) + len(REALTIME_TABLES) + 1


def test_lines_are_told_apart_by_half_day_in_one_pass(spark, tmp_path):
    import __spark_entry__

    rows = [f"({i}L, timestamp_ntz'1995-07-01 {i % 24:02d}:00:00', {i}L, 'click', 1.0D, '{{\"k\": {i}}}')" for i in range(200)]
    events = spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS t(event_id, ts, user_id, event_type, value, props)")
    events.write.parquet(f"{tmp_path}/events.parquet")
    halves = __spark_entry__._halves(spark, str(tmp_path), f"{tmp_path}/halves")
    lines = [sorted(r.value for r in half.collect()) for half in halves]
    # Event 97 is malformed and has no time.
    assert [len(x) for x in lines] == [sum(i % 24 < 12 or i % 97 == 0 for i in range(200)), sum(i % 24 >= 12 and i % 97 > 0 for i in range(200))]
    assert sorted(lines[0] + lines[1]) == sorted(r.value for r in __spark_entry__._lines(spark, str(tmp_path)).collect())
    for half in halves:  # neither parses all lines anew
        assert "regexp_replace" not in half._jdf.queryExecution().toString()
