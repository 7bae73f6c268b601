"""Turn values into model targets and back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelloom.functions.frames import SERIES, by_date, last_seen, running
from panelloom.functions.numeric import clip, ratio, safe_ln, sample_excess_kurtosis, sample_skewness

METHODS = ("none", "log", "return", "log_return")
FLOOR = 1e-8


def _check(method: str) -> None:
    if method not in METHODS:
        raise ValueError(f"target method must be one of {METHODS}")


def add_target(
    panel: DataFrame, method: str = "none", clip_at: float | None = 0.5, pad: bool = False, keys: Sequence[str] = SERIES
) -> DataFrame:
    """Add ``target``. A falsy ``clip_at`` leaves returns unbounded; ``pad`` carries values over gaps first."""
    _check(method)
    value, w = F.col("value"), by_date(keys)
    if method == "none":
        return panel.withColumn("target", value)
    if method == "log":
        return panel.withColumn("target", F.ln(clip(value, low=FLOOR)))
    if pad and method == "return":
        panel = panel.withColumn("_base", last_seen(value, w))
        value = F.col("_base")
    before = F.lag(value).over(w)
    change = ratio(value - before, before) if method == "return" else safe_ln(ratio(value, before))
    return panel.withColumn("target", clip(change, -clip_at, clip_at) if clip_at else change).drop("_base")


def reference_prices(panel: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """The last value of each series, kept even when it is missing."""
    return panel.groupBy(*keys).agg(F.max_by("value", "date").alias("reference_price"))


def invert_path(
    df: DataFrame, method: str, prediction: str = "target", keys: Sequence[str] = SERIES, order: str = "date"
) -> DataFrame:
    """Add ``price``: predictions in order compound from the series' ``reference_price``."""
    _check(method)
    p, along = F.col(prediction), running(by_date(keys, order))
    price = {
        "none": p,
        "log": F.exp(p),
        "return": F.col("reference_price") * F.product(1 + p).over(along),
        "log_return": F.col("reference_price") * F.exp(F.sum(p).over(along)),
    }[method]
    return df.withColumn("price", price)


def invert_one(prediction: Column, reference_price: Column, method: str) -> Column:
    """The price one step after ``reference_price``."""
    _check(method)
    return {
        "none": prediction,
        "log": F.exp(prediction),
        "return": reference_price * (1 + prediction),
        "log_return": reference_price * F.exp(prediction),
    }[method]


def target_stats(df: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    t = F.col("target")
    return df.groupBy(*keys).agg(
        F.count(t).alias("n"),
        F.avg(t).alias("mean"),
        F.stddev_samp(t).alias("std"),
        F.min(t).alias("min"),
        F.max(t).alias("max"),
        F.median(t).alias("median"),
        sample_skewness(t).alias("skewness"),
        sample_excess_kurtosis(t).alias("kurtosis"),
    )
