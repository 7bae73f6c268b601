"""Chronological splits and backtest folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelloom.functions.frames import SERIES, by_date, whole

FOLD_METHODS = ("walk_forward", "rolling", "expanding")


def chronological_split(
    df: DataFrame, train_ratio: float = 0.8, min_test: int = 30, gap: int = 0, keys: Sequence[str] = SERIES
) -> DataFrame:
    """Add ``split`` (train, gap or test), ``train_size``, ``row_number`` and ``too_short``."""
    if not 0.1 <= train_ratio <= 0.95:
        raise ValueError("train_ratio must lie between 0.1 and 0.95")
    w = by_date(keys)
    sized = df.withColumns({"row_number": F.row_number().over(w), "_n": F.count(F.lit(1)).over(whole(w))})
    wanted = F.floor(F.col("_n") * train_ratio)
    most = F.col("_n") - min_test - gap
    cut = F.when(wanted > most, F.greatest(most, F.lit(min_test))).otherwise(wanted).cast("int")
    place = F.col("row_number")
    return (
        sized.withColumn("train_size", cut)
        .withColumn(
            "split",
            F.when(place <= F.col("train_size"), "train").when(place <= F.col("train_size") + gap, "gap").otherwise("test"),
        )
        .withColumn("too_short", F.col("train_size") + gap >= F.col("_n"))
        .drop("_n")
    )


def split_summary(split: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """Sizes and date spans of both sides, and the last train date."""
    sides = {}
    for side in ("train", "test"):
        at = F.when(F.col("split") == side, F.col("date"))
        sides |= {f"{side}_rows": F.count(at), f"{side}_start": F.min(at), f"{side}_end": F.max(at)}
    sides |= {"gap_rows": F.count_if(F.col("split") == "gap"), "too_short": F.bool_or("too_short")}
    return split.groupBy(*keys).agg(*[c.alias(n) for n, c in sides.items()]).withColumn("split_date", F.col("train_end"))


def features_and_target(split: DataFrame, columns: Sequence[str], target: str = "value") -> dict[str, DataFrame]:
    """Train and test tables with the features and the target as ``label``."""
    chosen = split.select("series_id", "date", "split", *columns, F.col(target).alias("label"))
    return {side: chosen.filter(F.col("split") == side).drop("split") for side in ("train", "test")}


def validation_tail(split: DataFrame, share: float = 0.1) -> DataFrame:
    """Add ``is_validation``: the last ``share`` of the train rows, held out for early stopping."""
    size = F.floor(F.col("train_size") * share)
    held = (F.col("split") == "train") & (F.col("row_number") > F.col("train_size") - size)
    return split.withColumn("is_validation", held)


def _check(method: str) -> None:
    if method not in FOLD_METHODS:
        raise ValueError(f"fold method must be one of {FOLD_METHODS}")


def last_fold(n: Column, initial: int, test: int, step: int, n_folds: int | None) -> Column:
    """Highest fold number for a series of n rows; NULL when it is too short for one fold."""
    highest = F.floor((n - initial - test) / step).cast("int")
    capped = F.least(highest, F.lit(n_folds - 1)) if n_folds else highest
    return F.when(n >= initial + test, capped)


def folds(
    df: DataFrame,
    initial: int = 504,
    test: int = 30,
    step: int = 30,
    method: str = "walk_forward",
    n_folds: int | None = None,
    keys: Sequence[str] = SERIES,
) -> DataFrame:
    """One row per fold with its dates and sizes. ``expanding`` is the same as ``walk_forward``."""
    _check(method)
    # one date per day, so the array is bounded by the calendar
    spans = df.groupBy(*keys).agg(F.array_sort(F.collect_list("date")).alias("_dates"))
    spans = spans.withColumn("_last", last_fold(F.size("_dates"), initial, test, step, n_folds)).filter(F.col("_last").isNotNull())
    end = initial - 1 + F.col("fold_id") * step
    start = F.greatest(end - initial + 1, F.lit(0)) if method == "rolling" else F.lit(0)
    return (
        spans.select(*keys, "_dates", F.explode(F.sequence(F.lit(0), F.col("_last"))).alias("fold_id"))
        .select(
            *keys,
            "fold_id",
            F.get("_dates", start).alias("train_start"),
            F.get("_dates", end).alias("train_end"),
            F.get("_dates", end + 1).alias("test_start"),
            F.get("_dates", end + test).alias("test_end"),
            (end - start + 1).alias("train_size"),
            F.lit(test).alias("test_size"),
        )
    )


def too_short_for_folds(df: DataFrame, initial: int = 504, test: int = 30, keys: Sequence[str] = SERIES) -> DataFrame:
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).filter(F.col("n_rows") < initial + test)
    return counts.withColumn("error", F.lit(f"needs {initial + test} rows for one fold"))


def assign_folds(
    df: DataFrame,
    initial: int = 504,
    test: int = 30,
    step: int = 30,
    method: str = "walk_forward",
    n_folds: int | None = None,
    keys: Sequence[str] = SERIES,
) -> DataFrame:
    """Rows of every fold with ``fold_id`` and ``role``. Each row works out its folds from its own position."""
    _check(method)
    w = by_date(keys)
    at = F.col("_at")
    placed = df.withColumns({"_at": F.row_number().over(w) - 1, "_n": F.count(F.lit(1)).over(whole(w))})
    placed = placed.withColumn("_last", last_fold(F.col("_n"), initial, test, step, n_folds)).filter(F.col("_last").isNotNull())
    # fold f trains up to row initial-1+f*step and tests the `test` rows after it
    first = F.greatest(F.ceil((at - initial - test + 1) / step), F.lit(0)).cast("int")
    last = F.least(F.floor(at / step).cast("int"), F.col("_last")) if method == "rolling" else F.col("_last")
    exploded = placed.filter(first <= last).withColumn("fold_id", F.explode(F.sequence(first, last)))
    end = initial - 1 + F.col("fold_id") * step
    role = F.when(at <= end, "train").when(at <= end + test, "test")
    return exploded.withColumn("role", role).filter(F.col("role").isNotNull()).drop("_at", "_n", "_last")


def with_positions(
    df: DataFrame, initial: int = 504, test: int = 30, step: int = 30, n_folds: int | None = None, keys: Sequence[str] = SERIES
) -> DataFrame:
    """Each row once, with ``position`` (from 0), ``last_fold`` of its series and the ``fold_block`` it lies in.

    Block 0 holds the first ``initial`` rows and every further block ``step`` rows, so fold ``f`` trains on blocks up
    to ``f`` and tests on those after it. Stored by block, a fold reads only its blocks, and no row is copied.
    """
    w = by_date(keys)
    placed = df.withColumns({"position": F.row_number().over(w) - 1, "_n": F.count(F.lit(1)).over(whole(w))})
    block = F.greatest(F.floor((F.col("position") - initial) / step) + 1, F.lit(0)).cast("int")
    return placed.withColumns({"last_fold": last_fold(F.col("_n"), initial, test, step, n_folds), "fold_block": block}).drop("_n")


def in_fold(fold_id: int, role: str, initial: int = 504, test: int = 30, step: int = 30, method: str = "walk_forward") -> Column:
    """Whether a row of ``with_positions`` belongs to the train or test side of a fold: ranges of blocks and positions."""
    _check(method)
    end = initial + fold_id * step
    first, last = (fold_id * step if method == "rolling" else 0, end - 1) if role == "train" else (end, end + test - 1)

    def block(position: int) -> int:
        return max((position - initial) // step + 1, 0)

    ranges = F.col("fold_block").between(block(first), block(last)) & F.col("position").between(first, last)
    return ranges & (F.col("last_fold") >= fold_id)
