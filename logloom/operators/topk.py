"""Top rows per period without gathering a period in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, k: int, order: Sequence[Column], period: Sequence[str]) -> DataFrame:
    """The first k rows of each period under `order`, with their `rank`.

    `order` must end in a full key so that the result is the same on every run. For
    the k of reports Spark trims each task to its own top rows before the shuffle.
    """
    ranking = Window.partitionBy(*period).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(ranking)).where(F.col("rank") <= k)
