"""Common Log Format: one line of text to one typed row, in a single regex match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.schema import LOG_COLUMNS

# Fixed value: what counts as a well-formed line.
LINE_PATTERN = (
    r'^(\S+) (\S+) (\S+) \[([\w:/]+\s[+\-]\d{4})\] "(\S+) (\S+)\s*(\S*)\s*" (\d{3}) (\S+)'
)
# Fixed value: day/month/year:hour:minute:second, then a blank.
TIME_PATTERN = r"^\d{2}/[A-Z][a-z]{2}/(?!0000)\d{4}:\d{2}:\d{2}:\d{2} "
# Fixed value: month names as logged.
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]

# Why a line is rejected.
REASONS = ["null", "pattern", "size", "time"]

# The whole line is rewritten to its nine groups, one per line of text, so that
# the pattern runs once per line and not once per field. The second branch turns
# any other line into nine empty groups. No group but the time can hold white
# space, so the time goes last and takes the rest of the split.
_REWRITE_PATTERN = rf"(?s)^(?:{LINE_PATTERN[1:]}.*|.*)$"
_REWRITE_TO = "$1\n$2\n$3\n$5\n$6\n$7\n$8\n$9\n$4"

# Expressions over `f`, the fields in the order above (0 host, 1 ident, 2 user,
# 3 method, 4 endpoint, 5 protocol, 6 code, 7 size, 8 time).
_MONTH_MAP = ", ".join(f"'{name}', '{i:02d}'" for i, name in enumerate(MONTHS, 1))
_CLOCK = (
    f"concat(substring(f[8], 8, 4), '-', try_element_at(map({_MONTH_MAP}), substring(f[8], 4, 3)),"
    " '-', substring(f[8], 1, 2), ' ', substring(f[8], 13, 8))"
)
_SIZE = "CASE WHEN f[7] = '-' THEN 0L ELSE try_cast(f[7] AS BIGINT) END"
_REASON = f"""CASE
    WHEN line IS NULL THEN 'null'
    WHEN f[0] = '' THEN 'pattern'
    WHEN size IS NULL THEN 'size'
    WHEN NOT f[8] RLIKE r'{TIME_PATTERN}' OR event_time IS NULL THEN 'time'
END"""
_OFFSET = "split(f[8], ' ')[1]"
_INSTANT = (
    f"try_cast(concat(clock, substring({_OFFSET}, 1, 3), ':', substring({_OFFSET}, 4, 2))"
    " AS TIMESTAMP) AS instant"
)


def line_fields(line: Column) -> Column:
    """The nine text fields of a line as an array; all empty when it does not match."""
    rewritten = F.regexp_replace(line, F.lit(_REWRITE_PATTERN), F.lit(_REWRITE_TO))
    return F.split(rewritten, "\n", 9)


def parse_lines(lines: DataFrame, column: str = "value", *, with_instant: bool = False) -> DataFrame:
    """Every line with its parsed fields and a `reject_reason` (null when accepted).

    Works on batch and streaming frames alike. `line` keeps the input text as
    evidence for rejects. The logged zone offset is not applied to the clock;
    `with_instant` adds the true point in time beside it.
    """
    # explode() of a one-element array keeps the optimizer from copying the
    # regex into each projected field and each filter above.
    fields = lines.select(
        F.col(column).alias("line"), F.explode(F.array(line_fields(F.col(column)))).alias("f")
    )
    return (
        fields.selectExpr("line", "f", f"{_CLOCK} AS clock", f"{_SIZE} AS size")
        .selectExpr("*", "try_cast(clock AS TIMESTAMP_NTZ) AS event_time")
        .selectExpr(
            "line",
            f"{_REASON} AS reject_reason",
            "coalesce(f[0], '') AS host",
            "coalesce(f[1], '') AS client_identd",
            "coalesce(f[2], '') AS user_id",
            "coalesce(clock, '') AS date_time",
            "coalesce(f[3], '') AS method",
            "coalesce(f[4], '') AS endpoint",
            "coalesce(f[5], '') AS protocol",
            "coalesce(try_cast(f[6] AS INT), 0) AS response_code",
            "coalesce(size, 0L) AS content_size",
            "event_time",
            "coalesce(substring(clock, 1, 10), '') AS date",
            *([_INSTANT] if with_instant else []),
        )
    )


def accepted(parsed: DataFrame) -> DataFrame:
    """The log rows: lines that parsed, in the fixed schema (plus `instant` if asked for)."""
    extra = [c for c in parsed.columns if c == "instant"]
    return parsed.where(F.col("reject_reason").isNull()).select(*LOG_COLUMNS, *extra)


def rejected(parsed: DataFrame) -> DataFrame:
    """The lines that did not parse, with the reason."""
    return parsed.where(F.col("reject_reason").isNotNull()).select("line", "reject_reason")


def parse_logs(lines: DataFrame, column: str = "value") -> DataFrame:
    return accepted(parse_lines(lines, column))


def reject_counts(parsed: DataFrame) -> DataFrame:
    """How many lines fell out, per reason; accepted lines show as `ok`."""
    reason = F.coalesce(F.col("reject_reason"), F.lit("ok")).alias("reason")
    return parsed.groupBy(reason).agg(F.count("*").alias("lines"))
