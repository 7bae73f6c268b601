"""Drift between the last rows of a series and the rows before them.

Both windows have a fixed size, so a series becomes one row with two short arrays and every statistic is an
expression on that row.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelloom.functions.frames import SERIES, newest_first
from panelloom.functions.numeric import ratio

PSI_EPS = 1e-8
# Fixed value: the error of a series that is too short.
TOO_SHORT = "Not enough data for drift detection"


def window_table(
    df: DataFrame, reference: int = 60, current: int = 30, value: str = "value", keys: Sequence[str] = SERIES
) -> DataFrame:
    """One row per series with sorted arrays ``ref`` and ``cur``, or with ``error`` in their place.

    Rows are limited per series before the shuffle. A series with too few rows, or a missing value in its windows,
    cannot be tested.
    """
    place = F.row_number().over(newest_first(keys))
    last = df.select(*keys, "date", F.col(value).alias("_v")).withColumn("_newest", place)
    last = last.filter(F.col("_newest") <= reference + current)
    is_current = F.col("_newest") <= current
    windows = last.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.when(~is_current, F.col("_v")))).alias("ref"),
        F.array_sort(F.collect_list(F.when(is_current, F.col("_v")))).alias("cur"),
        F.count(F.lit(1)).alias("_rows"),
        F.count("_v").alias("_known"),
    )
    error = F.when(F.col("_rows") < reference + current, TOO_SHORT).when(F.col("_known") < F.col("_rows"), "missing values")
    return windows.select(*keys, *[F.when(error.isNull(), F.col(c)).alias(c) for c in ("ref", "cur")], error.alias("error"))


def drift_windows(
    df: DataFrame, reference: int = 60, current: int = 30, value: str = "value", keys: Sequence[str] = SERIES
) -> tuple[DataFrame, DataFrame]:
    """The series of ``window_table`` that can be tested, and those that cannot."""
    table = window_table(df, reference, current, value, keys)
    testable = F.col("error").isNull()
    return table.filter(testable).drop("error"), table.filter(~testable).select(*keys, "error")


def linear_quantile(sorted_values: Column, p: float) -> Column:
    x = (F.size(sorted_values) - 1) * F.lit(float(p))
    low = F.get(sorted_values, F.floor(x).cast("int"))
    high = F.get(sorted_values, F.ceil(x).cast("int"))
    return low + (high - low) * (x - F.floor(x))


def psi(ref: Column, cur: Column, bins: int = 10) -> Column:
    """Population stability index over the reference's quantile bins, the outer ones open.

    ``add_drift`` calls this on columns; both arrays are sorted.
    """
    edges = F.array(*[linear_quantile(ref, i / bins) for i in range(1, bins)])

    def shares(values: Column, inner: Column) -> Column:
        upto = F.concat(F.transform(inner, lambda e: F.size(F.filter(values, lambda v: v < e))), F.array(F.size(values)))
        counts = F.transform(upto, lambda c, i: c - F.when(i == 0, F.lit(0)).otherwise(F.get(upto, i - 1)) + F.lit(PSI_EPS))
        total = F.size(values) + F.lit(PSI_EPS * bins)
        return F.transform(counts, lambda c: c / total)

    terms = F.zip_with(shares(cur, edges), shares(ref, edges), lambda c, r: (c - r) * F.ln(c / r))
    return F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x)


def ks_gap(ref: Column, cur: Column, scale: int) -> Column:
    """Largest gap between the two distribution functions as a whole number of 1/scale steps."""

    def upto(values: Column, x: Column) -> Column:
        return F.size(F.filter(values, lambda v: v <= x)) * F.lit(scale) / F.size(values)

    gaps = F.transform(F.array_distinct(F.concat(ref, cur)), lambda x: F.abs(upto(ref, x) - upto(cur, x)))
    return F.round(F.array_max(gaps)).cast("int")


def ks_pvalues(gaps: np.ndarray, n: int, m: int) -> np.ndarray:
    """Exact two-sample p-values of gaps in steps of ``1 / lcm(n, m)``, by walking a lattice for all of them at once.

    A random order of the ``n + m`` values is a path. What has stayed closer than the gap is carried from one value to
    the next, for every gap and every count of reference values, so there are ``n + m`` steps of whole arrays; what
    reaches the gap is summed up, which keeps small p-values exact.
    """
    scale = math.lcm(n, m)
    i = np.arange(n + 1)
    inside = np.zeros((len(gaps), n + 1))
    inside[:, 0] = gaps > 0
    reached = np.where(gaps > 0, 0.0, 1.0)
    for done in range(n + m):
        # the next value is one of the reference, or one of the others
        up, along = inside * ((n - i) / (n + m - done)), inside * ((m - (done - i)) / (n + m - done))
        inside = along
        inside[:, 1:] += up[:, :-1]
        apart = np.abs(i * (scale // n) - (done + 1 - i) * (scale // m)) >= gaps[:, None]
        reached += np.where(apart, inside, 0.0).sum(axis=1)
        inside[apart] = 0.0
    return np.minimum(reached, 1.0)


def ks_exact(gap: Column, n: int, m: int) -> Column:
    """Exact p-value of a gap (a column of its own); each batch of rows walks the lattice once, for its distinct gaps."""

    @F.pandas_udf("double")
    def pvalue(gaps: pd.Series) -> pd.Series:
        known = gaps.dropna()
        found, place = np.unique(known.to_numpy(np.int64), return_inverse=True)
        return pd.Series(ks_pvalues(found, n, m)[place], known.index, dtype=float).reindex(gaps.index)

    return F.when(gap.isNotNull(), pvalue(gap))


def ks_asymptotic(gap: Column, n: int, m: int, terms: int = 100) -> Column:
    """Limiting p-value: twice the alternating sum of exp(-2 k^2 x^2)."""
    x2 = gap * gap * (n * m / (n + m))
    total = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)),
        F.lit(0.0),
        lambda acc, k: acc + F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * k * k * x2),
    )
    return F.when(gap > 0, F.least(F.greatest(2 * total, F.lit(0.0)), F.lit(1.0))).otherwise(1.0)


def add_drift(windows: DataFrame, reference: int = 60, current: int = 30, bins: int = 10, method: str = "exact") -> DataFrame:
    """Add ``psi``, ``ks_statistic`` and ``ks_pvalue`` (``exact`` or ``asymptotic``, as asked) to drift windows."""
    if method not in ("exact", "asymptotic"):
        raise ValueError(f"unknown method {method!r}")
    scale = math.lcm(reference, current)
    df = windows.withColumns({"psi": psi(F.col("ref"), F.col("cur"), bins), "_gap": ks_gap(F.col("ref"), F.col("cur"), scale)})
    df = df.withColumn("ks_statistic", F.col("_gap") / F.lit(float(scale)))
    if method == "exact":
        p = ks_exact(F.col("_gap"), reference, current)
    else:
        p = ks_asymptotic(F.col("ks_statistic"), reference, current)
    return df.withColumn("ks_pvalue", p).drop("_gap")


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x) / F.size(values)


def detect_drift(
    df: DataFrame,
    reference: int = 60,
    current: int = 30,
    psi_threshold: float = 0.2,
    p_threshold: float = 0.05,
    value: str = "value",
    keys: Sequence[str] = SERIES,
) -> DataFrame:
    """One row per series: verdict, statistics and means; a series that cannot be tested has ``error`` set."""
    tested = add_drift(window_table(df, reference, current, value, keys), reference, current).withColumns(
        {"reference_mean": _mean(F.col("ref")), "current_mean": _mean(F.col("cur"))}
    )
    change = ratio(F.col("current_mean") - F.col("reference_mean"), F.col("reference_mean")) * 100
    verdict = (F.col("psi") > psi_threshold) | (F.col("ks_pvalue") < p_threshold)
    return tested.select(
        *keys,
        verdict.alias("drift_detected"),
        "psi",
        "ks_statistic",
        "ks_pvalue",
        "reference_mean",
        "current_mean",
        change.alias("mean_change_pct"),
        "error",
    )
