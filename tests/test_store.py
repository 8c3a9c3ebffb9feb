import json

import pytest
from helpers import mixed_lines, text

from logloom.functions.clf import parse_logs
from logloom.operators import store
from logloom.operators.merge import carry_over, merge_reports
from logloom.plans import daily_report, views
from logloom.schema import BATCH_SCALARS, BATCH_TABLE, BATCH_TABLES, CELL_COLUMNS

ROWS = [
    ("t", "date=1995-07-02", "cf", "b", 0, "2"),
    ("t", "date=1995-07-02", "cf", "a", 0, "1"),
    ("t", "date=1995-07-01", "cf", "a", 0, "1"),
    ("t", "date=1995-07-03", "cf", "a", 0, "1"),
    ("t", "date=1995-07-03", "other", "z", 0, "9"),
]


@pytest.fixture
def cells(spark):
    return spark.createDataFrame(ROWS, "table string, row_key string, family string, "
                                 "qualifier string, part int, value string")


def _rows(df):
    return sorted(tuple(r) for r in df.select(*CELL_COLUMNS).collect())


def test_head_and_tail(cells):
    assert _rows(store.head(cells, "t", 2)) == sorted(r for r in ROWS if r[1] < "date=1995-07-03")
    assert _rows(store.head(cells, "t", 2, reverse=True)) == sorted(
        r for r in ROWS if r[1] > "date=1995-07-01"
    )
    assert _rows(store.head(cells, "t", 99)) == sorted(ROWS)


def test_get(spark, cells):
    assert _rows(store.get_rows(cells, "t", "date=1995-07-03")) == sorted(ROWS[3:])
    assert store.get_rows(cells, "t", "date=2000-01-01").count() == 0
    keys = spark.createDataFrame(
        [("t", "date=1995-07-01"), ("t", "date=1995-07-03"), ("u", "date=1995-07-02")],
        "table string, row_key string",
    )
    assert _rows(store.get_rows_in(cells, keys)) == sorted(ROWS[2:])


def test_rows_of_other_tables_stay_out(cells):
    from pyspark.sql import functions as F

    both = cells.unionByName(cells.withColumn("table", F.lit("u")))
    assert _rows(store.head(both, "t", 99)) == sorted(ROWS)
    assert _rows(store.get_rows(both, "t", "date=1995-07-03")) == sorted(ROWS[3:])


def test_put_swaps_only_the_rows_touched(spark, cells, tmp_path):
    root = str(tmp_path / "store")
    store.write_cells(cells, root)
    puts = [
        ("t", "date=1995-07-02", "cf", "a", 0, "new"),
        ("t", "date=1995-07-04", "cf", "a", 0, "row"),
        ("u", "date=1995-07-02", "cf", "a", 0, "else"),
    ]
    for _ in range(2):
        store.put_cells(spark.createDataFrame(puts, cells.schema), root)
        assert _rows(store.read_cells(spark, root)) == sorted([ROWS[0], *ROWS[2:], *puts])


def test_put_to_unknown_family_is_a_conflict(cells):
    valid, conflicts = store.split_conflicts(cells, {"t": ["cf"]})
    assert _rows(conflicts) == [ROWS[4]]
    assert _rows(valid) == sorted(ROWS[:4])
    none, every = store.split_conflicts(cells, {})
    assert none.count() == 0 and every.count() == len(ROWS)


def test_nested_rows_in_byte_order(cells):
    nested = {r["rowKey"]: r["columnFamilies"] for r in store.nested_rows(cells).collect()}
    assert len(nested) == 3
    two = nested["date=1995-07-02"]
    assert [f["familyName"] for f in two] == ["cf"]
    assert [(c["column"], c["value"]) for c in two[0]["columnValues"]] == [("a", "1"), ("b", "2")]
    assert [f["familyName"] for f in nested["date=1995-07-03"]] == ["cf", "other"]


def test_write_replaces_rows_and_append_adds(spark, cells, tmp_path):
    root = str(tmp_path / "store")
    store.write_cells(cells, root)
    assert _rows(store.read_cells(spark, root)) == sorted(ROWS)
    fresh = spark.createDataFrame([("t", "date=1995-07-02", "cf", "c", 0, "3")], cells.schema)
    store.write_cells(fresh, root)
    kept = sorted(r for r in ROWS if r[1] != "date=1995-07-02")
    replaced = [("t", "date=1995-07-02", "cf", "c", 0, "3")]
    assert _rows(store.read_cells(spark, root)) == sorted(kept + replaced)
    extra = spark.createDataFrame([("t", "date=1995-07-02", "cf", "d", 0, "4")], cells.schema)
    store.write_cells(extra, root, mode="append")
    assert len(_rows(store.read_cells(spark, root))) == len(kept) + 2


@pytest.fixture(scope="module")
def reports(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("rollup"))
    daily_report.write_rollup(parse_logs(text(spark, mixed_lines())), root)
    return daily_report.read_rollup(spark, root)


def test_every_day_has_every_cell(reports):
    got = {}
    for r in daily_report.report_cells(reports).collect():
        got.setdefault(r["row_key"], set()).add(r["qualifier"])
    assert len(got) == 4
    for names in got.values():
        assert names == {*BATCH_SCALARS, *BATCH_TABLES}


def test_table_cells_are_arrays_of_text_maps(reports):
    for r in daily_report.report_cells(reports).collect():
        if r["qualifier"] in BATCH_TABLES:
            items = json.loads(r["value"])
            counts = [int(x["count"]) for x in items]
            assert counts == sorted(counts, reverse=True)
            for item in items:
                assert list(item) == BATCH_TABLES[r["qualifier"]]
                assert all(isinstance(v, str) for v in item.values())


def test_cells_round_trip_to_rows(reports):
    cells = daily_report.report_cells(reports)
    report = daily_report.report_rows(reports)
    for name, fields in BATCH_TABLES.items():
        table = daily_report.report_table(report, name)
        back = views.table_rows(cells, name, fields)
        assert sorted(map(tuple, back.collect())) == sorted(
            map(tuple, table.select("date", *fields).collect())
        )


@pytest.mark.parametrize("n", [1, store.PART_ROWS, store.PART_ROWS + 500, 3 * store.PART_ROWS + 7])
def test_long_tables_are_cut_by_rank(spark, n):
    """Part 0 has the first rows of the table, part 1 the next ones; joined they are the table in order."""
    rows = spark.range(n).selectExpr(
        "'1995-07-01' AS date", "concat('/e', id) AS endpoint", "id % 9 + 1 AS count",
        "'1995-07-01 00:00:00' AS last_time",
    ).unionByName(
        spark.createDataFrame(
            [("1995-07-02", "/only", 5, "1995-07-02 00:00:00")],
            "date string, endpoint string, count bigint, last_time string",
        )
    ).selectExpr("'top_endpoints' AS qualifier", "*")
    fields = ["endpoint", "count", "last_time"]
    cells = store.table_cells(
        rows, "rt", fields, ["endpoint"], count_as_text=False, unlimited=True
    )
    parts = cells.collect()
    assert [p["part"] for p in parts if p["row_key"] == "date=1995-07-02"] == [0]
    big = sorted((p["part"], json.loads(p["value"])) for p in parts if p["row_key"] == "date=1995-07-01")
    assert [p for p, _ in big] == list(range(-(-n // store.PART_ROWS)))
    assert all(len(v) == store.PART_ROWS for _, v in big[:-1])
    joined = [(x["endpoint"], x["count"]) for _, v in big for x in v]
    assert joined == sorted(((f"/e{i}", i % 9 + 1) for i in range(n)), key=lambda x: (-x[1], x[0]))
    back = views.table_rows(cells, "top_endpoints", fields)
    assert sorted(map(tuple, back.collect())) == sorted(
        map(tuple, rows.select("date", *fields).collect())
    )
    # One record per row, with the head of each table.
    nested = {r["rowKey"]: r["columnFamilies"][0]["columnValues"] for r in store.nested_rows(cells).collect()}
    assert set(nested) == {"date=1995-07-01", "date=1995-07-02"}
    assert json.loads(nested["date=1995-07-01"][0]["value"]) == big[0][1]
    assert store.nested_rows(cells, page=1).count() == (1 if n > store.PART_ROWS else 0)


def test_ranks_over_many_ranges(spark):
    from pyspark.sql import functions as F

    from logloom.operators.ranking import distributed_rank

    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(5000).selectExpr("if(id % 10 < 9, 'hot', concat('g', id % 70)) AS g", "id % 13 AS n", "id")
        got = distributed_rank(rows, ["g"], [F.col("n").desc(), F.col("id").asc()]).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    groups = {}
    for r in got:
        groups.setdefault(r["g"], []).append((-r["n"], r["id"], r["rank"]))
    assert len(got) == 5000
    for own in groups.values():
        assert [x[2] for x in sorted(own)] == list(range(1, len(own) + 1))


def test_the_last_put_counts(spark, cells, tmp_path):
    root = str(tmp_path / "store")
    store.write_cells(cells, root)
    address = ("t", "date=1995-07-01", "cf", "a", 0)
    for values in (["9", "10"], ["10", "9"], ["3", None]):
        store.put_cells(spark.createDataFrame([(*address, v) for v in values], cells.schema).coalesce(1), root)
        got = store.get_rows(store.read_cells(spark, root), "t", "date=1995-07-01").collect()
        assert [r["value"] for r in got] == [values[-1]]
    numbered = spark.createDataFrame([(*address, "late", 2), (*address, "early", 1)], f"{cells.schema.simpleString()[7:-1].replace(':', ' ')}, seq int")
    store.put_cells(numbered, root, "seq")
    got = store.get_rows(store.read_cells(spark, root), "t", "date=1995-07-01").collect()
    assert [r["value"] for r in got] == ["late"] and got[0].asDict().keys() == set(CELL_COLUMNS)


def test_merge_and_carry_over(spark):
    layout = "date string, endpoint string, count bigint, last_time string"
    stored = spark.createDataFrame([("d", "/a", 2, "09"), ("d", "/b", 1, "08")], layout)
    new = spark.createDataFrame([("d", "/a", 3, "07"), ("d", "/c", 1, "10")], layout)
    keys = ["date", "endpoint"]
    merged = sorted(map(tuple, merge_reports(stored, new, keys).collect()))
    assert merged == [("d", "/a", 5, "09"), ("d", "/b", 1, "08"), ("d", "/c", 1, "10")]
    assert [tuple(r) for r in carry_over(stored, new, keys).collect()] == [("d", "/b", 1, "08")]
    outer = stored.alias("s").join(new.alias("n"), keys, "full_outer").selectExpr(
        "date", "endpoint", "coalesce(s.count, 0) + coalesce(n.count, 0)",
        "greatest(s.last_time, n.last_time)",
    )
    assert sorted(map(tuple, outer.collect())) == merged


def test_report_for_day_rounds_the_average(reports):
    cells = daily_report.report_cells(reports)
    day = views.report_for_day(cells, "1995-07-01")
    exact = cells.where(
        "row_key = 'date=1995-07-01' AND qualifier = 'average_content_size'"
    ).collect()[0]["value"]
    shown = day.where("qualifier = 'average_content_size'").collect()[0]["value"]
    assert shown == str(int(float(exact) + 0.5))
    assert {r["table"] for r in day.collect()} == {BATCH_TABLE}
    assert views.report_for_day(cells, "2001-01-01").count() == 0


@pytest.mark.parametrize("min_url_code", [200, 400])
def test_tables_of_the_rollup_equal_tables_of_the_logs(spark, reports, min_url_code):
    """One ranking for all tables gives what each table gives straight from the logs."""
    from logloom.operators.breakdown import breakdown
    from logloom.operators.rollup import with_hour

    logs = with_hour(parse_logs(text(spark, mixed_lines())))
    report = daily_report.report_rows(reports, min_url_code=min_url_code)
    for name, keys, options in [
        ("process_response_code", ["response_code"], {}),
        ("process_hosts_more_than_10", ["host"], {"min_count": 10}),
        ("process_top_endpoints", ["endpoint"], {}),
        ("process_top_errors", ["endpoint", "response_code"],
         {"last_seen_by": ["endpoint"], "min_code": min_url_code}),
        ("error_hosts_top", ["host", "response_code"],
         {"last_seen_by": ["host"], "min_code": 400}),
        ("error_hour", ["hour", "response_code"], {"min_code": 400, "k": None}),
    ]:
        got = daily_report.report_table(report, name)
        want = breakdown(logs, keys, **options).select(*got.columns)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_a_table_without_rows_still_has_its_cell(spark, tmp_path):
    from helpers import line

    quiet = [line(1, "01:00:00", "h", "/", 200)]
    daily_report.write_rollup(parse_logs(text(spark, quiet)), str(tmp_path))
    cells = daily_report.report_cells(daily_report.read_rollup(spark, str(tmp_path)))
    values = {r["qualifier"]: r["value"] for r in cells.collect()}
    assert set(values) == {*BATCH_SCALARS, *BATCH_TABLES}
    for name in ("process_hosts_more_than_10", "error_hosts_top", "error_hour"):
        assert values[name] == "[]"
    assert json.loads(values["process_top_errors"]) == [
        {"endpoint": "/", "response_code": "200", "count": "1",
         "last_time": "1995-07-01 01:00:00", "percentage": "100.0"}
    ]
