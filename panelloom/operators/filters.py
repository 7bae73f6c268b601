"""Row and column selection."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, NumericType

from panelloom.functions.frames import SERIES, by_date, newest_first, whole

# Columns that are never features, and same-day returns, which hold the day's own value.
NOT_FEATURES = frozenset(
    ("series_id", "date", "value", "target", "ingest_seq", "is_original", "is_imputed", "missing_streak", "is_outlier", "z_score")
)
SAME_DAY = frozenset(("return_1d", "return_5d", "return_20d", "consecutive_direction"))


def date_range(df: DataFrame, start: str | None = None, end: str | None = None, date: str = "date") -> DataFrame:
    """Inclusive at both ends; rows without a date go only when a bound is given."""
    if start is not None:
        df = df.filter(F.col(date) >= F.lit(start).cast("date"))
    if end is not None:
        df = df.filter(F.col(date) <= F.lit(end).cast("date"))
    return df


def as_of(df: DataFrame, cutoff: str, require_rows: bool = False) -> DataFrame:
    """Rows up to the cutoff date; with ``require_rows`` an empty result raises (this runs a small job)."""
    kept = date_range(df, end=cutoff)
    if require_rows and kept.isEmpty():
        raise ValueError(f"no rows up to {cutoff}")
    return kept


def complete_cases(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows whose ``columns`` all hold a value; NaN is none.

    One condition a column: from a single one over all columns, as of ``dropna``, the optimizer derives a variant for every
    subset of renamed columns.
    """
    fraction = {f.name: isinstance(f.dataType, (DoubleType, FloatType)) for f in df.schema}
    known = [F.col(c).isNotNull() & ~F.isnan(c) if fraction[c] else F.col(c).isNotNull() for c in columns]
    return df.filter(reduce(and_, known)) if known else df


def feature_columns(df: DataFrame, leak_safe: bool = True, day_of_week_flags: bool = True) -> list[str]:
    """Numeric columns that may feed a model.

    Same-day returns are a function of the value to be predicted, so ``leak_safe`` leaves them out.
    """
    names = [f.name for f in df.schema if isinstance(f.dataType, NumericType) and f.name not in NOT_FEATURES]
    if leak_safe:
        names = [n for n in names if n not in SAME_DAY]
    if not day_of_week_flags:
        names = [n for n in names if not n.startswith("is_dow_")]
    return names


def lookback(df: DataFrame, as_of_date: Column, days: int = 90) -> DataFrame:
    """The ``days`` calendar days up to a date; 0 or less keeps all of the past."""
    kept = df.filter(F.col("date") <= as_of_date)
    return kept.filter(F.col("date") >= F.date_sub(as_of_date, days)) if days > 0 else kept


def tail(df: DataFrame, n: int, keys: Sequence[str] = SERIES, order: str | Sequence[str] = "date") -> DataFrame:
    """The last n rows per key. Spark limits each group before the shuffle, so a hot key sends n rows per task."""
    rank = F.row_number().over(newest_first(keys, order))
    return df.withColumn("_newest", rank).filter(F.col("_newest") <= n).drop("_newest")


def long_series(panel: DataFrame, minimum: int, keys: Sequence[str] = SERIES) -> DataFrame:
    """``min_rows`` for a daily panel: the count runs in the panel's own window, so nothing is read twice."""
    counted = panel.withColumn("_rows", F.count(F.lit(1)).over(whole(by_date(keys))))
    return counted.filter(F.col("_rows") >= minimum).drop("_rows")


def min_rows(df: DataFrame, minimum: int, keys: Sequence[str] = SERIES) -> tuple[DataFrame, DataFrame]:
    """Rows of the keys with enough rows, and a table of the keys that have too few."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
    enough = counts.filter(F.col("n_rows") >= minimum).select(*keys)
    rejected = counts.filter(F.col("n_rows") < minimum).withColumn(
        "error", F.concat(F.lit("only "), F.col("n_rows").cast("string"), F.lit(f" rows, need {minimum}"))
    )
    return df.join(enough, list(keys), "left_semi"), rejected
