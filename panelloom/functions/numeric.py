"""Null-safe numeric column expressions.

A missing number is NULL throughout: NaN is turned into NULL on ingest, and a ratio without a value
(division by zero, log of a non-positive ratio) is NULL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nan_to_null(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is zero (a plain ``/`` raises under ANSI mode)."""
    return F.try_divide(a, b)


def clip(x: Column, low: float | None = None, high: float | None = None) -> Column:
    """Bound x on either side; NULL stays NULL (``greatest`` and ``least`` skip NULLs)."""
    bounded = x
    if low is not None:
        bounded = F.greatest(bounded, F.lit(float(low)))
    if high is not None:
        bounded = F.least(bounded, F.lit(float(high)))
    return F.when(x.isNotNull(), bounded)


def safe_ln(x: Column) -> Column:
    return F.when(x > 0, F.ln(x))


def sample_skewness(x: Column) -> Column:
    """Bias-corrected skewness; ``F.skewness`` is the population one."""
    n = F.count(x).cast("double")
    return F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)))


def sample_excess_kurtosis(x: Column) -> Column:
    """Bias-corrected excess kurtosis; ``F.kurtosis`` is the population one."""
    n = F.count(x).cast("double")
    scale = F.try_divide(n - 1, (n - 2) * (n - 3))
    return F.when(n > 3, scale * ((n + 1) * F.kurtosis(x) + 6))
