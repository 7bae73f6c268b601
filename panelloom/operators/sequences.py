"""Sliding-window samples cut from a feature panel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelloom.functions.frames import SERIES, by_date, whole
from panelloom.operators.filters import complete_cases, tail


def _vector(columns: Sequence[str]):
    return F.array(*[F.col(c).cast("float") for c in columns])


def _stretches(df: DataFrame, rows: Column, count: int, stride: int, keys: Sequence[str]) -> DataFrame:
    """``count`` neighbouring rows as an array, one stretch every ``stride`` rows, from row 0 on.

    Rows are first packed into blocks of one stride, so a frame is gathered per stretch and not per row.
    """
    w = by_date(keys)
    place = F.row_number().over(w) - 1
    if stride == 1:
        gathered = F.collect_list(rows).over(w.rowsBetween(0, count - 1))
        stretches = df.select(*keys, place.alias("start_index"), gathered.alias("_rows"))
        return stretches.filter(F.size("_rows") == count)
    placed = df.select(*keys, place.alias("_place"), rows.alias("_row"))
    packed = F.array_sort(F.collect_list(F.struct("_place", "_row")))
    blocks = placed.groupBy(*keys, F.floor(F.col("_place") / stride).cast("int").alias("_block")).agg(
        F.transform(packed, lambda r: r["_row"]).alias("_rows")
    )
    ahead = by_date(keys, "_block").rowsBetween(0, -(-count // stride) - 1)
    gathered = F.slice(F.flatten(F.collect_list("_rows").over(ahead)), 1, count)
    stretches = blocks.select(*keys, (F.col("_block") * stride).alias("start_index"), gathered.alias("_rows"))
    return stretches.filter(F.size("_rows") == count)


def sliding_windows(
    df: DataFrame,
    columns: Sequence[str],
    target: str = "value",
    length: int = 60,
    horizon: int = 1,
    stride: int = 1,
    keys: Sequence[str] = SERIES,
) -> DataFrame:
    """Samples ``x`` (``length`` rows of features) and ``y`` (the next ``horizon`` targets), from row 0 on."""
    row = F.struct(F.col("date"), _vector(columns).alias("x"), F.col(target).cast("float").alias("y"))
    return _stretches(df, row, length + horizon, stride, keys).select(
        *keys,
        "start_index",
        F.get("_rows", F.lit(length - 1))["date"].alias("end_date"),
        F.transform(F.slice("_rows", 1, length), lambda r: r["x"]).alias("x"),
        F.transform(F.slice("_rows", length + 1, horizon), lambda r: r["y"]).alias("y"),
    )


def split_windows(
    df: DataFrame,
    columns: Sequence[str],
    target: str = "value",
    length: int = 60,
    horizon: int = 1,
    stride: int = 1,
    train_ratio: float = 0.8,
    keys: Sequence[str] = SERIES,
) -> DataFrame:
    """Complete rows, cut in time at ``train_ratio``, then samples that never cross the cut."""
    w = by_date(keys)
    known = complete_cases(df, [*columns, target])
    cut = F.floor(F.count(F.lit(1)).over(whole(w)) * train_ratio)
    labelled = known.withColumn("split", F.when(F.row_number().over(w) <= cut, "train").otherwise("validation"))
    return sliding_windows(labelled, columns, target, length, horizon, stride, (*keys, "split"))


def latest_window(df: DataFrame, columns: Sequence[str], length: int = 60, keys: Sequence[str] = SERIES) -> tuple[DataFrame, DataFrame]:
    """The last ``length`` complete rows of each series as one sample, and the series that have too few."""
    last = tail(complete_cases(df, columns), length, keys)
    row = F.struct(F.col("date"), _vector(columns).alias("v"))
    grouped = last.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(row)), lambda s: s["v"]).alias("x"), F.max("date").alias("end_date")
    )
    short = df.select(*keys).distinct().join(grouped.filter(F.size("x") == length).select(*keys), list(keys), "left_anti")
    return grouped.filter(F.size("x") == length), short.withColumn("error", F.lit(f"fewer than {length} complete rows"))


def context_target_samples(
    df: DataFrame, context: int = 512, target_length: int = 30, column: str = "value", keys: Sequence[str] = SERIES
) -> DataFrame:
    """Consecutive context and target cuts, a target length apart; a cut that ends on the last row is not taken."""
    known = df.filter(F.col(column).isNotNull())
    # one row more than the cut needs, which leaves out the exact fit
    stretches = _stretches(known, F.col(column).cast("float"), context + target_length + 1, target_length, keys)
    return stretches.select(
        *keys,
        "start_index",
        F.slice("_rows", 1, context).alias("context"),
        F.slice("_rows", context + 1, target_length).alias("target"),
    )


def aligned_truth(df: DataFrame, length: int, keys: Sequence[str] = SERIES) -> DataFrame:
    """Rows that pair with window predictions: the first window ends on row ``length``."""
    ranked = df.withColumn("_place", F.row_number().over(by_date(keys)))
    return ranked.filter(F.col("_place") >= length).withColumn("step", F.col("_place") - length + 1).drop("_place")
