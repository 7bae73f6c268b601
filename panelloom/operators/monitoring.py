"""Prediction, metric and training logs: append-only tables and the checks on them.

Log rows per series have no bound. Checks on recent rows limit each series before the shuffle; the rolling
mean over a whole log runs in chunks with a halo (``plans.hot_series``).
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from panelloom.functions.frames import SERIES, by_date
from panelloom.functions.numeric import ratio
from panelloom.operators.filters import tail
from panelloom.plans.hot_series import BLOCK_ROWS, CHUNK_ROWS, with_halo, with_row_index

PREDICTION_LOG = "series_id string, timestamp string, horizon int, prediction double, actual double, error double, record_seq bigint"
TRAINING_LOG = "series_id string, trained_at timestamp"
#: The log is stored by the month of its timestamp, so that a write-back replaces the months it changes.
LOG_MONTH = "log_month"
_INTENTS = "write_id string, state string"

# The reasons a retrain decision reports, joined by SEPARATOR.
NO_RECORD = "No training record found"
SCHEDULED = "Scheduled retrain (%d days since last)"
BELOW_THRESHOLD = "Performance below threshold (MASE=%.3f)"
DRIFTED = "Data drift detected"
NOT_NEEDED = "No retrain needed"
SEPARATOR = "; "


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def read_log(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A log table; one that was never written is empty when its schema is given."""
    try:
        return (spark.read.schema(schema) if schema else spark.read).parquet(path).drop(LOG_MONTH)
    except AnalysisException as error:
        if schema is None or error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def record_predictions(predictions: DataFrame, path: str) -> None:
    """Append predictions, stored by month; the error is known once the actual is."""
    rows = with_error(predictions).withColumn(LOG_MONTH, F.substring("timestamp", 1, 7))
    rows.hint("rebalance", LOG_MONTH).write.mode("append").partitionBy(LOG_MONTH).parquet(path)


def with_error(log: DataFrame) -> DataFrame:
    return log.withColumn("error", F.abs(F.col("prediction") - F.col("actual")))


def record_metrics(metrics: DataFrame, path: str) -> None:
    append(metrics, path)


def record_training(trained: DataFrame, path: str) -> None:
    append(trained.select("series_id", F.coalesce("trained_at", F.current_timestamp()).alias("trained_at")), path)


def update_actuals(log: DataFrame, actuals: DataFrame) -> DataFrame:
    """Fill open actuals by series and timestamp, on all horizons; ``updated`` marks the rows that changed.

    ``actuals`` is ``series_id, timestamp, actual, arrival``; of several for one timestamp the last arrived counts.
    """
    latest = actuals.groupBy("series_id", "timestamp").agg(F.max_by("actual", "arrival").alias("_actual"))
    joined = log.join(latest, ["series_id", "timestamp"], "left")
    updated = F.col("actual").isNull() & F.col("_actual").isNotNull()
    filled = joined.withColumn("updated", updated).withColumn("actual", F.coalesce("actual", "_actual")).drop("_actual")
    return filled.withColumn("error", F.when(F.col("updated"), F.abs(F.col("prediction") - F.col("actual"))).otherwise(F.col("error")))


def write_back(spark: SparkSession, path: str, actuals: DataFrame) -> int:
    """Fill open actuals in the stored log with ``update_actuals``; returns the number of rows filled.

    Only the months that hold an open row and an actual are read and replaced. Their new rows are stored beside the log
    and noted as ready first, then put in place, then noted as done; so a run that dies is finished by the next one, and
    running twice fills nothing twice. One write-back at a time.
    """
    finish_write_backs(spark, path)
    log = spark.read.schema(f"{PREDICTION_LOG}, {LOG_MONTH} string").parquet(path)
    arrived = actuals.select(F.substring("timestamp", 1, 7).alias(LOG_MONTH)).distinct()
    months = [r[0] for r in log.filter(F.col("actual").isNull()).select(LOG_MONTH).distinct().join(arrived, LOG_MONTH, "left_semi").collect()]
    if not months:
        return 0
    write_id = uuid.uuid4().hex
    update_actuals(log.filter(F.col(LOG_MONTH).isin(months)), actuals).write.parquet(f"{path}.pending/{write_id}")
    filled = spark.read.parquet(f"{path}.pending/{write_id}").filter("updated").count()
    if filled:
        _note(spark, path, write_id, "ready")
        _put_in_place(spark, path, write_id)
    return filled


def finish_write_backs(spark: SparkSession, path: str) -> None:
    """Put in place what earlier write-backs stored and did not finish."""
    noted = read_log(spark, f"{path}.intents", _INTENTS).groupBy("write_id").agg(F.collect_set("state").alias("states"))
    for row in noted.filter(~F.array_contains("states", "done")).collect():
        _put_in_place(spark, path, row["write_id"])


def _put_in_place(spark: SparkSession, path: str, write_id: str) -> None:
    rows = spark.read.parquet(f"{path}.pending/{write_id}").drop("updated")
    columns = [c.split(" ")[0] for c in PREDICTION_LOG.split(", ")]
    stored = rows.select(*columns, F.substring("timestamp", 1, 7).alias(LOG_MONTH))
    stored.hint("rebalance", LOG_MONTH).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(LOG_MONTH).parquet(path)
    _note(spark, path, write_id, "done")


def _note(spark: SparkSession, path: str, write_id: str, state: str) -> None:
    append(spark.createDataFrame([(write_id, state)], _INTENTS).coalesce(1), f"{path}.intents")


def performance_summary(log: DataFrame) -> DataFrame:
    """Errors and means per series over the scored rows, four decimals, halves to even."""
    known = log.filter(F.col("actual").isNotNull())
    return known.groupBy("series_id").agg(
        F.bround(F.avg("error"), 4).alias("error_mean"),
        F.bround(F.stddev_samp("error"), 4).alias("error_std"),
        F.count("error").alias("error_count"),
        F.bround(F.avg("prediction"), 4).alias("prediction_mean"),
        F.bround(F.avg("actual"), 4).alias("actual_mean"),
    )


def _recent_and_earlier(rows: DataFrame, x: str, size: int, keys: Sequence[str], order: str) -> DataFrame:
    """Means of the last ``size`` rows and of the ``size`` rows before them."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).desc()))
    last = rows.withColumn("_newest", place).filter(F.col("_newest") <= 2 * size)
    recent = F.col("_newest") <= size
    return last.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.when(recent, F.col(x))).alias("recent"),
        F.avg(F.when(~recent, F.col(x))).alias("earlier"),
    )


def check_alerts(log: DataFrame, size: int = 30, threshold: float = 0.2, order: str = "record_seq") -> DataFrame:
    """Series whose recent error is worse than the error before by more than the threshold."""
    known = log.filter(F.col("actual").isNotNull()).select("series_id", "error", order)
    means = _recent_and_earlier(known, "error", size, SERIES, order)
    worse = ratio(F.col("recent") - F.col("earlier"), F.col("earlier"))
    return (
        means.filter((F.col("n") >= 2 * size) & (F.col("earlier") > 0))
        .withColumn("degradation", worse)
        .filter(F.col("degradation") > threshold)
        .select(
            "series_id",
            F.lit("performance_degradation").alias("type"),
            F.lit("warning").alias("severity"),
            F.col("recent").alias("recent_mae"),
            F.col("earlier").alias("historical_mae"),
            "degradation",
        )
    )


def rolling_metric(
    log: DataFrame,
    metric: str = "mae",
    window: int = 30,
    order: Sequence[str] = ("timestamp", "record_seq"),
    chunk_rows: int = CHUNK_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Mean of a metric over the last ``window`` records of a series, horizons mixed.

    A log of any length per series runs in chunks that start with the ``window - 1`` records before them.
    """
    rows = log.select("series_id", *order, F.col(metric))
    numbered = with_row_index(rows, SERIES, list(order), block_rows=block_rows)
    frame = Window.partitionBy("series_id", "chunk").orderBy("row_index").rowsBetween(-(window - 1), 0)
    rolled = with_halo(numbered, window - 1, chunk_rows=chunk_rows).withColumn(f"rolling_{metric}", F.avg(metric).over(frame))
    return rolled.filter("is_own").drop("chunk", "is_own")


def degradation(
    log: DataFrame,
    metric: str = "mae",
    window: int = 30,
    threshold: float = 0.2,
    order: Sequence[str] = ("timestamp", "record_seq"),
) -> DataFrame:
    """Whether the mean of the last ``window`` rolling values exceeds that of the ``window`` before.

    Rolling values of the last 2 * window records need 3 * window - 1 records, whatever the log's length.
    """
    last = tail(log.select("series_id", *order, F.col(metric)), 3 * window - 1, SERIES, list(order))
    w = by_date(SERIES, list(order))
    rolled = last.withColumns(
        {"_rolling": F.avg(metric).over(w.rowsBetween(-(window - 1), 0)), "_place": F.row_number().over(w)}
    )
    means = _recent_and_earlier(rolled, "_rolling", window, SERIES, "_place")
    worse = ratio(F.col("recent") - F.col("earlier"), F.col("earlier"))
    testable = (F.col("n") >= 2 * window) & (F.col("earlier") >= 1e-10)
    return means.select(
        "series_id", "recent", "earlier", F.coalesce(testable & (worse > threshold), F.lit(False)).alias("degraded")
    )


def last_training(log: DataFrame) -> DataFrame:
    return log.groupBy("series_id").agg(F.max("trained_at").alias("trained_at"))


def should_retrain(
    series: DataFrame,
    trained: DataFrame,
    as_of: Column,
    performance: DataFrame | None = None,
    drift: DataFrame | None = None,
    schedule_days: int = 30,
    mase_limit: float = 0.25,
) -> DataFrame:
    """Decision and reasons per series from the training log, a table with ``mase`` and a drift table.

    ``series`` may be the drift table itself, which names every series; then its verdicts need no join.
    """
    own = drift is None and "drift_detected" in series.columns
    df = series.select("series_id", *(["drift_detected"] if own else [])).join(last_training(trained), "series_id", "left")
    df = df.join(performance.select("series_id", "mase"), "series_id", "left") if performance is not None else df.withColumn("mase", F.lit(None).cast("double"))
    if not own:
        df = df.join(drift.select("series_id", "drift_detected"), "series_id", "left") if drift is not None else df.withColumn("drift_detected", F.lit(False))
    seconds = F.unix_timestamp(as_of) - F.unix_timestamp("trained_at")
    days = F.floor(seconds / 86400)
    reasons = F.concat_ws(
        SEPARATOR,
        F.when(F.col("trained_at").isNull(), NO_RECORD).when(days >= schedule_days, F.format_string(SCHEDULED, days)),
        F.when(F.col("mase") > mase_limit, F.format_string(BELOW_THRESHOLD, "mase")),
        F.when(F.col("drift_detected"), DRIFTED),
    )
    return df.select(
        "series_id",
        (reasons != "").alias("should_retrain"),
        F.when(reasons != "", reasons).otherwise(NOT_NEEDED).alias("reason"),
    )
