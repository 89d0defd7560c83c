"""Rates and means with two decimals, rounded half up in whole numbers so that every
engine gives the same double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _half_up(scaled: Column, count: Column) -> Column:
    """scaled / count rounded half up to a whole number, over 100. The remainder is taken
    off first: a decimal quotient alone would be rounded at its sixth place."""
    over, under = 2 * scaled + count, 2 * count
    return ((over - over % under) / under).cast("double") / 100.0


def _wide(col: Column) -> Column:
    return col.cast("decimal(28,0)")


def percent(part: Column, whole: Column) -> Column:
    """Percentage of ``whole``; 0 when there is nothing to divide by."""
    scaled = _half_up(_wide(part) * 10000, _wide(F.nullif(whole, F.lit(0))))
    return F.coalesce(scaled, F.lit(0.0))


def mean(total: Column, count: Column) -> Column:
    """Mean; null over no values."""
    return _half_up(_wide(total) * 100, _wide(F.nullif(count, F.lit(0))))
