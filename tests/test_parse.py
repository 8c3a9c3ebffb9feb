import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logloom.functions.clf import (
    LINE_PATTERN,
    accepted,
    line_fields,
    parse_lines,
    parse_logs,
    reject_counts,
    rejected,
)
from logloom.schema import LOG_COLUMNS, LOG_SCHEMA

P = "h - - [01/Jul/1995:00:00:01 -0400] "


def _lines(spark, *lines):
    return spark.createDataFrame([(x,) for x in lines], "value string")


def _one(spark, line):
    return parse_lines(_lines(spark, line)).collect()[0]


def test_plain_line(spark):
    row = _one(spark, 'a.b.c - bob [01/Jul/1995:00:00:01 -0400] "GET /x/y.gif HTTP/1.0" 200 6245')
    assert row.reject_reason is None
    assert (row.host, row.client_identd, row.user_id) == ("a.b.c", "-", "bob")
    assert (row.date_time, row.date) == ("1995-07-01 00:00:01", "1995-07-01")
    assert row.event_time == dt.datetime(1995, 7, 1, 0, 0, 1)
    assert (row.method, row.endpoint, row.protocol) == ("GET", "/x/y.gif", "HTTP/1.0")
    assert (row.response_code, row.content_size) == (200, 6245)


@pytest.mark.parametrize(
    "line, endpoint, protocol, code, size",
    [
        (P + '"GET / HTTP/1.0" 200 6245', "/", "HTTP/1.0", 200, 6245),
        (P + '"GET /x" 200 -', "/x", "", 200, 0),
        (P + '"GET /x HTTP/1.0 " 200 5', "/x", "HTTP/1.0", 200, 5),
        (P + '"GET /q"r HTTP/1.0" 404 7 "ref" "ua"', '/q"r', "HTTP/1.0", 404, 7),
    ],
)
def test_accepted_edges(spark, line, endpoint, protocol, code, size):
    row = _one(spark, line)
    assert row.reject_reason is None
    assert (row.endpoint, row.protocol, row.response_code, row.content_size) == (
        endpoint, protocol, code, size,
    )


@pytest.mark.parametrize(
    "line, reason",
    [
        (P + '"GET /a b HTTP/1.0" 404 -', "pattern"),
        (P + '"-" 400 -', "pattern"),
        (" " + P + '"GET / HTTP/1.0" 200 1', "pattern"),
        (P.replace("h -", "h  -") + '"GET / HTTP/1.0" 200 1', "pattern"),
        ("", "pattern"),
        (P + '"GET /x  HTTP/1.0" 200 12abc', "size"),
        (P + '"GET /x  HTTP/1.0" 200 1.5', "size"),
        (P + '"GET /x  HTTP/1.0" 200 99999999999999999999', "size"),
        (P.replace("01/Jul", "31/Feb") + '"GET / HTTP/1.0" 200 1', "time"),
        (P.replace("01/Jul", "01/Foo") + '"GET / HTTP/1.0" 200 1', "time"),
        (P.replace("01/Jul", "1/Jul") + '"GET / HTTP/1.0" 200 1', "time"),
        (P.replace("00:00:01", "24:00:01") + '"GET / HTTP/1.0" 200 1', "time"),
        (P.replace("00:00:01", "00:60:01") + '"GET / HTTP/1.0" 200 1', "time"),
        (P.replace(" -0400", "\t-0400") + '"GET / HTTP/1.0" 200 1', "time"),
        (P.replace(" -0400", "\n-0400") + '"GET / HTTP/1.0" 200 1', "time"),
        (None, "null"),
    ],
)
def test_rejects(spark, line, reason):
    parsed = parse_lines(_lines(spark, line))
    assert parsed.collect()[0].reject_reason == reason
    assert accepted(parsed).count() == 0
    assert [tuple(r) for r in rejected(parsed).collect()] == [(line, reason)]


def test_leap_day(spark):
    good = _one(spark, P.replace("01/Jul/1995", "29/Feb/1996") + '"GET / HTTP/1.0" 200 1')
    bad = _one(spark, P.replace("01/Jul/1995", "29/Feb/1995") + '"GET / HTTP/1.0" 200 1')
    assert good.date == "1996-02-29" and good.reject_reason is None
    assert bad.reject_reason == "time"


def test_schema_is_fixed(spark):
    df = parse_logs(_lines(spark, P + '"GET / HTTP/1.0" 200 1'))
    assert df.columns == LOG_COLUMNS
    for field, declared in zip(df.schema, LOG_SCHEMA):
        assert field.dataType == declared.dataType
        assert field.nullable == declared.nullable


def test_reject_counts(spark):
    lines = _lines(spark, P + '"GET / HTTP/1.0" 200 1', "x", "y", P + '"GET / HTTP/1.0" 200 z')
    assert {tuple(r) for r in reject_counts(parse_lines(lines)).collect()} == {
        ("ok", 1), ("pattern", 2), ("size", 1),
    }


def test_wall_clock_survives_any_session_zone(spark):
    """02:30 on this day does not exist in New York; the logged text must not move."""
    line = 'h - - [02/Apr/1995:02:30:00 -0400] "GET / HTTP/1.0" 200 1'
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        row = _one(spark, line)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert row.date_time == "1995-04-02 02:30:00"
    assert row.event_time == dt.datetime(1995, 4, 2, 2, 30)


def test_instant_applies_the_offset(spark):
    lines = _lines(spark, P + '"GET / HTTP/1.0" 200 1')
    df = accepted(parse_lines(lines, with_instant=True))
    row = df.select("date_time", F.col("instant").cast("string").alias("instant")).collect()[0]
    assert (row.date_time, row.instant) == ("1995-07-01 00:00:01", "1995-07-01 04:00:01")


_token = st.text(alphabet='ab-"[]/\x01\t é', min_size=0, max_size=4)


@settings(
    max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
@given(st.lists(st.tuples(*[_token] * 6), min_size=20, max_size=20))
def test_single_match_equals_nine_matches(spark, tokens):
    """The one-pass rewrite gives what nine separate extractions give."""
    lines = [
        f'h{a} {b}- u{c} [01/Jul/1995:00:00:01 -0400] "G{d} /{e} HTTP/1.0" 200 {f}1'
        for a, b, c, d, e, f in tokens
    ]
    df = _lines(spark, *lines)
    order = [1, 2, 3, 5, 6, 7, 8, 9, 4]
    nine = F.array(*[F.regexp_extract("value", LINE_PATTERN, i) for i in order])
    for row in df.select(line_fields(F.col("value")).alias("one"), nine.alias("nine")).collect():
        assert row.one == row.nine
