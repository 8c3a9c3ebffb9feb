"""Mergeable daily rollups: the one heavy aggregation every report is cut from."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What each stored grain is keyed by, within a day. All keep the response code,
# so success, error and "last seen" figures follow from them without the logs.
GRAINS: dict[str, list[str]] = {
    "hour": ["hour", "response_code"],
    "host": ["host", "response_code"],
    "endpoint": ["endpoint", "response_code"],
}


def measures():
    return [
        F.count("*").alias("hits"),
        F.sum("content_size").alias("bytes"),
        F.max("event_time").alias("last_time"),
    ]


def with_hour(logs: DataFrame) -> DataFrame:
    return logs.withColumn("hour", F.hour("event_time"))


def rollup(
    logs: DataFrame,
    grains: Mapping[str, Sequence[str]] = GRAINS,
    period: Sequence[str] = ("date",),
) -> DataFrame:
    """Several grains in one pass and one shuffle, told apart by column `grain`.

    GROUPING SETS aggregates each task's rows per grain before the shuffle, so a
    host or endpoint that makes up a third of all traffic leaves a task as a
    single row per grain and code.
    """
    keys = [*period, *dict.fromkeys(k for ks in grains.values() for k in ks)]
    sets = {name: [*period, *ks] for name, ks in grains.items()}
    # grouping_id() has one bit per key, leftmost highest, set when the key is absent.
    ids = {
        name: sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in present)
        for name, present in sets.items()
    }
    if len(set(ids.values())) != len(ids):
        raise ValueError("two grains have the same keys")
    grain = F.lit(None).cast("string")
    for name, gid in ids.items():
        grain = F.when(F.col("gid") == gid, name).otherwise(grain)
    return (
        logs.groupingSets([[F.col(c) for c in s] for s in sets.values()], *keys)
        .agg(F.grouping_id().alias("gid"), *measures())
        .select(grain.alias("grain"), *keys, "hits", "bytes", "last_time")
    )


def merge_rollups(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add up rollup rows to (possibly coarser) keys: sums add, last seen takes the max."""
    return rows.groupBy(*keys).agg(
        F.sum("hits").alias("hits"),
        F.sum("bytes").alias("bytes"),
        F.max("last_time").alias("last_time"),
    )


# Grain of the stored rollup that holds each day's hosts as a sketch, and its size: 2^14
# registers estimate within 1.04 / sqrt(2^14) = 0.8 % (one standard error).
SKETCH = "host_sketch"
SKETCH_BITS = 14
SKETCH_ERROR = 0.0082


def host_sketches(hosts: DataFrame) -> DataFrame:
    """(grain, date, sketch): each day's hosts as a sketch of fixed size, from its `host` grain."""
    return hosts.groupBy("date").agg(F.hll_sketch_agg("host", F.lit(SKETCH_BITS)).alias("sketch")).select(
        F.lit(SKETCH).alias("grain"), "date", "sketch"
    )


def unique_hosts_span(sketches: DataFrame, span: str) -> DataFrame:
    """(start, days, unique_host_estimate) of each `span` ("week", "month", "year"), from the days' sketches.

    Distinct hosts do not add up over days, but sketches do: no log and no host is read.
    """
    start = F.date_format(F.date_trunc(span, F.to_timestamp("date")), "yyyy-MM-dd").alias("start")
    return sketches.where(F.col("grain") == SKETCH).groupBy(start).agg(
        F.count("*").alias("days"),
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("unique_host_estimate"),
    )
