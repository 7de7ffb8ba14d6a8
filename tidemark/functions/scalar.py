"""Null-safe arithmetic and comparisons. Under ANSI a plain division by zero raises; these don't."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_div(n: Column, d: Column, on_zero: Column | float | None = None) -> Column:
    """n / d; ``on_zero`` where d is zero, null where either is null."""
    other = on_zero if isinstance(on_zero, Column) else F.lit(on_zero).cast("double")
    return F.when(d == 0, F.when(n.isNotNull(), other)).otherwise(F.try_divide(n, d))


def clip(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(high)), F.lit(low)))


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def or_zero(x: Column) -> Column:
    """Null and NaN as zero; infinities as the largest doubles."""
    return F.when(x.isNull() | F.isnan(x), 0.0).otherwise(clip(x, -1.7976931348623157e308, 1.7976931348623157e308))


def is_true(x: Column) -> Column:
    return F.coalesce(x, F.lit(False))


def unix_seconds(ts: Column) -> Column:
    return F.floor(F.unix_micros(ts.cast("timestamp")) / 1_000_000)


def minutes_between(a: Column, b: Column) -> Column:
    return (F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))) / 6e7
