"""Folding new report rows into stored ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge_reports(stored: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keyed merge of (keys, count, last_time): counts add, the later time wins.

    Keys on one side only are kept, as in a full outer join, but a union needs
    one shuffle of pre-aggregated rows and never pairs rows up.
    """
    return (
        stored.unionByName(new)
        .groupBy(*keys)
        .agg(F.sum("count").alias("count"), F.max("last_time").alias("last_time"))
    )


def carry_over(stored: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Stored rows whose key the new rows do not touch."""
    return stored.join(new.select(*keys), list(keys), "left_anti")
