"""Ratios and rates in which null has a meaning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_ratio(numerator: Column, denominator: Column, valid: Column | bool = True) -> Column:
    """numerator / denominator; null if the layer is invalid or the denominator is 0."""
    ok = F.lit(valid) if isinstance(valid, bool) else valid
    return F.when(ok & (denominator != 0), numerator / denominator)


def clamped(handled: Column, total: Column) -> Column:
    """handled, within 0 and total."""
    return F.least(total, F.greatest(F.lit(0).cast("long"), handled))


def micro_rate(handled: Column, total: Column) -> Column:
    """An aggregate: sum of clamped handled over sum of totals; 1 where there is nothing to handle."""
    s = F.sum(total)
    return F.when(F.coalesce(s, F.lit(0)) == 0, F.lit(1.0)).otherwise(F.sum(clamped(handled, total)) / s)


def passes(rate: Column, threshold: float) -> Column:
    """rate >= threshold, with room for the last bits of a float."""
    return rate + 1e-12 >= threshold
