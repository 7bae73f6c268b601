"""Window features of a panel: lags, rolling statistics, calendar, volatility and returns.

Everything except the calendar looks at earlier rows only. All windows share one partitioning and order, so
the whole feature set costs one shuffle by series.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelloom.functions import lookback
from panelloom.functions.calendar import calendar_columns
from panelloom.functions.frames import SERIES, by_date, last_seen
from panelloom.functions.lookback import Lookback, add_lookbacks
from panelloom.functions.numeric import ratio
from panelloom.operators.filters import complete_cases

# Default feature parameters.
LAGS = (1, 2, 3, 5, 7, 14, 21, 30)
WINDOWS = (7, 14, 30, 60)
STATS = ("mean", "std", "min", "max")
VOLATILITY_WINDOWS = (7, 14, 30)
RANGE_WINDOWS = (7, 14)
RETURN_DAYS = (1, 5, 20)
EWM_SPAN = 14
EWM_MIN_PERIODS = 7


def lag_features(w, lags: Sequence[int] = LAGS, value: str = "value") -> dict[str, Column]:
    return {f"lag_{k}": F.lag(value, k).over(w) for k in lags}


def rolling_features(
    w, windows: Sequence[int] = WINDOWS, stats: Sequence[str] = STATS, value: str = "value"
) -> dict[str, Column]:
    """Statistics of the previous rows, the row itself left out; ``median`` is available on request."""
    kinds = {
        "mean": F.avg,
        "std": F.stddev_samp,
        "min": F.min,
        "max": F.max,
        "median": lambda x: F.percentile(x, F.lit(0.5)),
    }
    return {f"rolling_{s}_{n}": kinds[s](F.col(value)).over(w.rowsBetween(-n, -1)) for n in windows for s in stats}


def range_features(w, windows: Sequence[int] = RANGE_WINDOWS, value: str = "value") -> dict[str, Column]:
    columns = {}
    for n in windows:
        frame = w.rowsBetween(-n, -1)
        low = F.min(value).over(frame)
        columns[f"range_pct_{n}"] = ratio(F.max(value).over(frame) - low, low)
    return columns


def ranges_of_levels(levels: Sequence[str], windows: Sequence[int] = RANGE_WINDOWS) -> dict[str, Column]:
    """The columns of ``range_features`` for those windows whose rolling minimum and maximum are there already."""
    columns = {}
    for n in windows:
        if {f"rolling_min_{n}", f"rolling_max_{n}"} <= set(levels):
            low = F.col(f"rolling_min_{n}")
            columns[f"range_pct_{n}"] = ratio(F.col(f"rolling_max_{n}") - low, low)
    return columns


def return_features(w, days: Sequence[int] = RETURN_DAYS, value: str = "value") -> dict[str, Column]:
    columns = {}
    for k in days:
        before = F.lag(value, k).over(w)
        columns[f"return_{k}d"] = ratio(F.col(value) - before, before)
    return columns


def volatility_features(w, windows: Sequence[int] = VOLATILITY_WINDOWS, returns: str = "return_1d") -> dict[str, Column]:
    return {f"volatility_{n}": F.stddev_samp(returns).over(w.rowsBetween(-n, -1)) for n in windows}


def lagged_return_features(w) -> dict[str, Column]:
    return {
        "return_1d_lag1": F.lag("return_1d").over(w),
        "return_5d_lag1": F.lag("return_5d").over(w),
        "momentum_5d": F.signum(F.lag("return_5d").over(w)),
        "momentum_20d": F.signum(F.lag("return_20d").over(w)),
    }


def add_direction_run(df: DataFrame, keys: Sequence[str] = SERIES, returns: str = "return_1d") -> DataFrame:
    """``consecutive_direction``: length of the run of equal return signs so far, times the sign."""
    w = by_date(keys)
    sign = F.signum(returns)
    # a missing return always starts a run of its own
    starts = ~F.coalesce(sign == F.lag(sign).over(w), F.lit(False))
    placed = df.withColumns({"_place": F.row_number().over(w), "_starts": starts})
    start = last_seen(F.when(F.col("_starts"), F.col("_place")), w)
    runs = placed.withColumn("consecutive_direction", (F.col("_place") - start + 1) * sign)
    return runs.withColumn("consecutive_direction_lag1", F.lag("consecutive_direction").over(w)).drop("_place", "_starts")


def lookback_features(
    windows: Sequence[int] = WINDOWS, stats: Sequence[str] = STATS, value: str = "value"
) -> dict[str, Lookback]:
    """``rolling_features`` for ``add_lookbacks``; no ``median``."""
    return {f"rolling_{s}_{n}": Lookback(value, s, n) for n in windows for s in stats if s in lookback.STATS}


def lookback_volatility(windows: Sequence[int] = VOLATILITY_WINDOWS, returns: str = "return_1d") -> dict[str, Lookback]:
    return {f"volatility_{n}": Lookback(returns, "std", n) for n in windows}


def lookback_ewm(span: int = EWM_SPAN, min_periods: int = EWM_MIN_PERIODS, returns: str = "return_1d") -> dict[str, Lookback]:
    return {f"volatility_ewm_{span}": Lookback(returns, "ewm", span, min_periods)}


def add_rolling(
    df: DataFrame,
    windows: Sequence[int] = WINDOWS,
    stats: Sequence[str] = STATS,
    keys: Sequence[str] = SERIES,
    value: str = "value",
    further: dict[str, Lookback] | None = None,
) -> DataFrame:
    """The columns of ``rolling_features``, worked out in one pass with ``further`` ones; medians take windows of their own."""
    quick = [s for s in stats if s in lookback.STATS] if df.schema[value].dataType == T.DoubleType() else []
    slow = rolling_features(by_date(keys), windows, [s for s in stats if s not in quick], value)
    return add_lookbacks(df.withColumns(slow), lookback_features(windows, quick, value) | (further or {}), keys)


def add_ewm_volatility(
    df: DataFrame,
    span: int = EWM_SPAN,
    min_periods: int = EWM_MIN_PERIODS,
    keys: Sequence[str] = SERIES,
    returns: str = "return_1d",
    name: str | None = None,
) -> DataFrame:
    """Bias-corrected exponentially weighted deviation of the returns before the row; gaps age the weights."""
    (made,) = lookback_ewm(span, min_periods, returns).items()
    return add_lookbacks(df, {name or made[0]: made[1]}, keys)


def generate(
    panel: DataFrame,
    lags: Sequence[int] = LAGS,
    windows: Sequence[int] = WINDOWS,
    stats: Sequence[str] = STATS,
    calendar: bool = True,
    volatility: bool = True,
    returns: bool = True,
    keys: Sequence[str] = SERIES,
) -> DataFrame:
    """Append all feature columns. Short series get the same columns, filled with NULL.

    Windows run first, on the sort they share; the pass over the rows before comes last.
    """
    w = by_date(keys)
    lagged_levels = lag_features(w, lags)
    levels = [*lagged_levels, *(f"rolling_{s}_{n}" for n in windows for s in stats)]
    known = ranges_of_levels(levels) if volatility else {}
    ranges = range_features(w, [n for n in RANGE_WINDOWS if f"range_pct_{n}" not in known]) if volatility else {}
    days = calendar_columns(F.col("date")) if calendar else {}
    spreads = lookback_volatility() if volatility else {}
    lagged = lagged_return_features(w) if returns else {}
    df = panel
    if volatility or returns:
        df = df.withColumns(return_features(w))
    if returns:
        df = add_direction_run(df, keys)
    df = df.withColumns(lagged_levels | ranges | lagged)
    df = add_rolling(df, windows, stats, keys, further=spreads | (lookback_ewm() if volatility else {}))
    df = df.withColumns(known | days)
    names = [*panel.columns, *levels, *days, *spreads]
    if volatility:
        names += [f"volatility_ewm_{EWM_SPAN}", *[f"range_pct_{n}" for n in RANGE_WINDOWS]]
    if returns:
        names += [*return_features(w), *lagged, "consecutive_direction", "consecutive_direction_lag1"]
    return df.select(*names)


def feature_matrix(features: DataFrame, columns: Sequence[str], target: str = "value", drop_missing: bool = True) -> DataFrame:
    """Features and target, by default only rows where all of them are known."""
    kept = complete_cases(features, [*columns, target]) if drop_missing else features
    return kept.select("series_id", "date", *columns, F.col(target).alias("label"))
