"""Small numeric expressions shared by reports and views."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def percentage(part: Column, whole: Column) -> Column:
    """Share of `whole` in percent, two decimals."""
    return F.round((part / whole) * 100, 2)


def round_half_up(x: Column) -> Column:
    """Nearest whole number, halves up."""
    return F.floor(x + F.lit(0.5))


def ratio_or_null(a: Column, b: Column) -> Column:
    """a / b, null when b is zero."""
    return F.when(b != 0, a / b)
