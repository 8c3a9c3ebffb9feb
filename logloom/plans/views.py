"""What a dashboard reads: a day's report, pages of a table, shares and trends."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions.numbers import ratio_or_null, round_half_up
from logloom.operators.breakdown import breakdown, with_share
from logloom.operators.kpis import unique_hosts
from logloom.operators.store import get_rows
from logloom.operators.topk import top_k
from logloom.schema import BATCH_TABLE, CHART_CODES, PAGE_ROWS

# Columns that hold numbers; in cells they are text.
NUMERIC = {"count": "bigint", "percentage": "double", "response_code": "int", "hour": "int"}


def report_for_day(cells: DataFrame, day: str, table: str = BATCH_TABLE) -> DataFrame:
    """The cells of one day's report; the average size rounded for display."""
    row = get_rows(cells, table, f"date={day}")
    rounded = round_half_up(F.col("value").try_cast("double")).cast("string")
    value = F.when(F.col("qualifier") == "average_content_size", rounded).otherwise(F.col("value"))
    return row.withColumn("value", value)


def table_rows(cells: DataFrame, qualifier: str, fields: Sequence[str]) -> DataFrame:
    """A table cell back to rows, numbers as numbers, all days and parts."""
    layout = ", ".join(f"`{f}` string" for f in fields)
    rows = cells.where(F.col("qualifier") == qualifier).select(
        F.substring("row_key", 6, 10).alias("date"),
        F.inline(F.from_json("value", f"array<struct<{layout}>>")),
    )
    return rows.select(
        "date", *[F.col(f).cast(NUMERIC[f]).alias(f) if f in NUMERIC else F.col(f) for f in fields]
    )


def first_page(
    rows: DataFrame,
    sort_by: str,
    keys: Sequence[str],
    *,
    descending: bool = True,
    page_rows: int = PAGE_ROWS,
) -> DataFrame:
    """The first page of each day's table, sorted by any column; ties go by key."""
    by = F.col(sort_by).desc() if descending else F.col(sort_by).asc()
    order = [by, *[F.col(c).asc() for c in keys if c != sort_by]]
    return top_k(rows, page_rows, order, ["date"])


def average_size(kpis: DataFrame) -> DataFrame:
    """Average size of successful responses in whole bytes, null when there are none."""
    mean = ratio_or_null(F.col("total_content_size"), F.col("total_number_of_successful"))
    return kpis.select("date", round_half_up(mean).alias("average_content_size"))


def response_code_share(logs: DataFrame, codes: Sequence[int] = CHART_CODES) -> DataFrame:
    """Each code's share of the day, charted codes without hits as 0, and the day's extremes."""
    entry = "struct<response_code: int, count: bigint, percentage: double>"
    shares = breakdown(logs, ["response_code"], k=None)
    # At most one entry per three-digit code in a day's array.
    days = shares.groupBy("date").agg(
        F.collect_list(F.struct("response_code", "count", "percentage").cast(entry)).alias("hit")
    )
    charted = F.array(*[F.struct(F.lit(c), F.lit(0), F.lit(0.0)).cast(entry) for c in codes])
    seen = F.transform("hit", lambda x: x["response_code"])
    unhit = F.filter(charted, lambda x: ~F.array_contains(seen, x["response_code"]))
    every = days.select("date", F.concat("hit", unhit).alias("codes"))
    shares_of_day = F.transform("codes", lambda x: x["percentage"])
    return every.select(
        "date",
        F.array_max(shares_of_day).alias("biggest"),
        F.array_min(shares_of_day).alias("smallest"),
        F.inline("codes"),
    )


def daily_unique_hosts(logs: DataFrame) -> DataFrame:
    return unique_hosts(logs)


def traffic_by_weekday(logs: DataFrame) -> DataFrame:
    """Requests per day of the week, over all days, with the number of days seen."""
    per_day = logs.groupBy("date").agg(F.count("*").alias("hits"))
    return per_day.groupBy(
        F.date_format(F.to_date("date"), "E").alias("weekday")
    ).agg(F.sum("hits").alias("hits"), F.count("*").alias("days"))


def on_calendar(per_day: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Every day from the first to the last of the table, for every key; days without a row show 0.

    The spine is made of the table's own ends: a row per calendar day and key.
    """
    first, last = (per_day.agg(f(F.to_date("date"))).scalar() for f in (F.min, F.max))
    owners = per_day.select(*keys).distinct() if keys else per_day.sparkSession.range(1)
    days = owners.select(*keys, F.explode(F.sequence(first, last)).alias("date"))
    days = days.withColumn("date", F.col("date").cast("string"))
    filled = days.join(per_day, ["date", *keys], "left")
    return filled.select("date", *keys, *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in columns])


def day_over_day(per_day: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    """Change of a daily figure against the calendar day before, in percent, by key if any.

    Days in between that the table lacks count as 0, so a gap never shows as the change of
    one day. The window holds the calendar (of a key): a row per day.
    """
    of_key = Window.partitionBy(*keys).orderBy("date") if keys else Window.orderBy("date")
    previous = F.lag(column).over(of_key)
    change = ratio_or_null(F.col(column) - F.col("previous"), F.col("previous")) * 100
    return on_calendar(per_day, [column], keys).withColumn("previous", previous).withColumn(
        "change_pct", F.round(change, 2)
    )


def realtime_rows(cells: DataFrame, qualifier: str, fields: Sequence[str]) -> DataFrame:
    """A realtime table back to rows, all parts, with each row's share of the day's total.

    Realtime cells hold counts only; the total is a cell of the same row. It is one number
    per day and is broadcast (see with_share()).
    """
    totals = cells.where(F.col("qualifier") == "total_log_count").select(
        F.substring("row_key", 6, 10).alias("date"), F.col("value").cast("bigint").alias("total")
    )
    return with_share(table_rows(cells, qualifier, fields), totals)
