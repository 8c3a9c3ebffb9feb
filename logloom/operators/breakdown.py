"""Grouped report tables: count, share of all traffic, last seen, top rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions.numbers import percentage
from logloom.operators.rollup import rollup
from logloom.operators.topk import top_k
from logloom.schema import TOP_ROWS

_KEY, _TOTAL = "key", "total"


def breakdown(
    logs: DataFrame,
    keys: Sequence[str],
    *,
    last_seen_by: Sequence[str] | None = None,
    min_code: int | None = None,
    min_count: int | None = None,
    k: int | None = TOP_ROWS,
    period: Sequence[str] = ("date",),
) -> DataFrame:
    """One report table straight from the logs, in one scan.

    Counts per `keys` and the total of the period come from the same grouping-set
    aggregation. `last_seen_by` names the key whose latest time is shown, over
    all its requests and not just the counted ones. `k=None` keeps all rows and
    is meant for keys with few values (codes, hours).
    """
    rows = rollup(logs, {_KEY: keys, _TOTAL: []}, period)
    is_total = F.col("grain") == _TOTAL
    if last_seen_by is not None and set(last_seen_by) != set(keys):
        # At most one row per response code in each window.
        seen = Window.partitionBy("grain", *period, *last_seen_by)
        rows = rows.withColumn("last_time", F.max("last_time").over(seen))
    wanted = F.lit(True)
    if min_code is not None:
        wanted &= F.col("response_code") >= min_code
    if min_count is not None:
        wanted &= F.col("hits") > min_count
    rows = rows.where(is_total | wanted)
    if k is not None:
        # The total ranks first, so it survives the cut and meets the k rows it
        # is needed for in the task that ranks them; nothing larger does.
        order = [is_total.desc(), F.col("hits").desc(), *[F.col(c).asc() for c in keys]]
        rows = top_k(rows, k + 1, order, period)
    whole = F.max(F.when(is_total, F.col("hits"))).over(Window.partitionBy(*period))
    return (
        rows.withColumn("_whole", whole)
        .where(~is_total)
        .select(
            *period,
            *keys,
            F.col("hits").alias("count"),
            F.col("last_time").cast("string").alias("last_time"),
            percentage(F.col("hits"), F.col("_whole")).alias("percentage"),
        )
    )


def with_share(rows: DataFrame, totals: DataFrame) -> DataFrame:
    """Share of the day's total for a table of any length (`totals`: date, total).

    `totals` has one row per calendar day of a four-digit year, at most 3.7
    million short rows, so it is broadcast and the table is not shuffled.
    """
    return (
        rows.join(F.broadcast(totals), "date")
        .withColumn("percentage", percentage(F.col("count"), F.col("total")))
        .drop("total")
    )


def key_entries(
    rows: DataFrame, key: str, top: str, min_count: int, by_code: str, min_code: int
) -> DataFrame:
    """Candidates of the two tables of a host or endpoint, from one shuffle of its rollup.

    `top` has one entry per key, `by_code` one per key and code; both show when
    the key was last seen at all. A window holds one row per response code.
    """
    of_key = Window.partitionBy("date", key)
    seen = rows.select(
        "date",
        key,
        "response_code",
        "hits",
        F.sum("hits").over(of_key).alias("key_hits"),
        F.max("last_time").over(of_key).alias("last_time"),
        (F.col("response_code") == F.min("response_code").over(of_key)).alias("once"),
    )
    entry = "struct<qualifier: string, response_code: int, count: bigint>"
    total = F.struct(F.lit(top), F.lit(None), F.col("key_hits")).cast(entry)
    single = F.struct(F.lit(by_code), F.col("response_code"), F.col("hits")).cast(entry)
    entries = F.array(
        F.when(F.col("once") & (F.col("key_hits") > min_count), total),
        F.when(F.col("response_code") >= min_code, single),
    )
    return seen.select("date", key, "last_time", F.inline(F.array_compact(entries)))


def last_seen_join(logs: DataFrame, keys: Sequence[str], last_seen_by: str, min_code: int) -> DataFrame:
    """Count per `keys` joined with the last time of `last_seen_by`: two aggregates, one join.

    Same rows as the windowed form above without the cut; kept as its counterpart.
    """
    counts = (
        logs.where(F.col("response_code") >= min_code)
        .groupBy("date", *keys)
        .agg(F.count("*").alias("count"))
    )
    last = logs.groupBy("date", last_seen_by).agg(F.max("event_time").alias("last_time"))
    return counts.join(last, ["date", last_seen_by], "inner").select(
        "date", *keys, "count", F.col("last_time").cast("string").alias("last_time")
    )
