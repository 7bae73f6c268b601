"""Save panels, predictions and forecasts."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.sources.errors import SourceError

FORMATS = ("parquet", "csv")


def save(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = (), mode: str = "overwrite") -> str:
    """Write as Parquet or CSV, by default replacing what is there; returns the path."""
    if fmt not in FORMATS:
        raise SourceError(f"cannot write format {fmt!r}; choose one of {FORMATS}")
    if partition_by:
        # one writer per folder would make a hot series a single task, so spread rows and let AQE size them
        df = df.hint("rebalance", *partition_by)
    writer = df.write.mode(mode).option("header", True) if fmt == "csv" else df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.format(fmt).save(path)
    return path


def save_processed(df: DataFrame, path: str, fmt: str = "parquet") -> str:
    return save(df, path, fmt, partition_by=("series_id",))


def save_predictions(df: DataFrame, root: str, fmt: str = "parquet", run_ts: str | None = None) -> str:
    """Write one run's predictions under ``root/run_ts=<stamp>``."""
    stamp = run_ts or datetime.now(timezone.utc).strftime("%Y%m%d_%H%M%S")
    return save(df, f"{root.rstrip('/')}/run_ts={stamp}", fmt)


def save_forecasts(df: DataFrame, path: str, fmt: str = "csv") -> str:
    """One folder per (series, model)."""
    return save(df, path, fmt, partition_by=("series_id", "model"))


def wide_predictions(scored: DataFrame, models: Sequence[str]) -> DataFrame:
    """``series_id, date, actual`` and one prediction column per model, which are named up front."""
    return (
        scored.groupBy("series_id", "date")
        .agg(
            F.max("actual").alias("actual"),
            *[F.max(F.when(F.col("model") == m, F.col("prediction"))).alias(m) for m in models],
        )
    )
