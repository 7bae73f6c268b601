"""Forecast errors as grouped aggregates.

Scored tables have ``actual`` and ``prediction`` columns, one row per key and step, and where the scaled
metrics are wanted ``scale_abs`` and ``scale_sq``: mean absolute and squared train differences.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelloom.functions.frames import SERIES, by_date
from panelloom.functions.numeric import ratio

TINY = 1e-8
ZERO_SCALE = 1e-10
METRICS = ("mae", "rmse", "mape", "smape", "mase", "msse", "direction_accuracy")


def _error(actual: str, prediction: str) -> Column:
    return F.col(actual) - F.col(prediction)


def mae(actual: str = "actual", prediction: str = "prediction") -> Column:
    return F.avg(F.abs(_error(actual, prediction)))


def mse(actual: str = "actual", prediction: str = "prediction") -> Column:
    e = _error(actual, prediction)
    return F.avg(e * e)


def rmse(actual: str = "actual", prediction: str = "prediction") -> Column:
    return F.sqrt(mse(actual, prediction))


def mape(actual: str = "actual", prediction: str = "prediction") -> Column:
    return F.avg(F.abs(_error(actual, prediction)) / (F.abs(F.col(actual)) + TINY)) * 100


def smape(actual: str = "actual", prediction: str = "prediction") -> Column:
    size = F.abs(F.col(actual)) + F.abs(F.col(prediction)) + TINY
    return F.avg(2 * F.abs(_error(actual, prediction)) / size) * 100


def scaled(error: Column, scale: Column) -> Column:
    """Error in units of the naive train error; NULL when that is missing or all but zero."""
    return F.when(scale >= ZERO_SCALE, error / F.nullif(scale, F.lit(0.0)))


def naive_scale(train: DataFrame, seasonality: int = 1, keys: Sequence[str] = SERIES, value: str = "value") -> DataFrame:
    """Per key the mean absolute and squared change over ``seasonality`` rows."""
    step = F.col(value) - F.lag(value, seasonality).over(by_date(keys))
    return (
        train.withColumn("_step", step)
        .groupBy(*keys)
        .agg(F.avg(F.abs("_step")).alias("scale_abs"), F.avg(F.col("_step") * F.col("_step")).alias("scale_sq"))
    )


def add_direction_hit(scored: DataFrame, keys: Sequence[str], order: str = "date") -> DataFrame:
    """``direction_hit``: 1 when actual and prediction moved the same way since the row before, NULL on the first."""
    w = by_date(keys, order)
    moved = F.signum(F.col("actual") - F.lag("actual").over(w))
    foreseen = F.signum(F.col("prediction") - F.lag("prediction").over(w))
    return scored.withColumn("direction_hit", (moved == foreseen).cast("double"))


def direction_accuracy() -> Column:
    return F.avg("direction_hit") * 100


def score(scored: DataFrame, keys: Sequence[str], order: str = "date", scale: bool = True) -> DataFrame:
    """All metrics per key. Rows without an actual or a prediction are left out and counted in ``n_dropped``."""
    known = F.col("actual").isNotNull() & F.col("prediction").isNotNull()
    counted = scored.withColumn("_known", known)
    dropped = F.count_if(~F.col("_known")).alias("n_dropped")
    base = add_direction_hit(counted, (*keys, "_known"), order)
    rows = base.withColumns({c: F.when(F.col("_known"), F.col(c)) for c in ("actual", "prediction", "direction_hit")})
    columns = [
        F.count_if("_known").alias("n"),
        dropped,
        mae().alias("mae"),
        rmse().alias("rmse"),
        mape().alias("mape"),
        smape().alias("smape"),
    ]
    if scale:
        columns += [
            scaled(mae(), F.max("scale_abs")).alias("mase"),
            scaled(mse(), F.max("scale_sq")).alias("msse"),
        ]
    return rows.groupBy(*keys).agg(*columns, direction_accuracy().alias("direction_accuracy"))


def score_by_horizon(scored: DataFrame, horizons: Sequence[int] | None = None, keys: Sequence[str] = SERIES) -> DataFrame:
    """Metrics per key and ``horizon``; horizons nobody predicted are simply not there."""
    if horizons is not None:
        scored = scored.filter(F.col("horizon").isin(list(horizons)))
    return score(scored, (*keys, "horizon"), scale=False)


def match_actuals(predictions: DataFrame, actuals: DataFrame) -> DataFrame:
    """Each prediction with the value on its target date, its error and percentage errors; the unmatched go."""
    truth = actuals.select("series_id", F.col("date").alias("target_date"), F.col("value").alias("actual"))
    error = F.col("prediction") - F.col("actual")
    percent = ratio(error, F.col("actual")) * 100
    return predictions.join(truth, ["series_id", "target_date"]).withColumns(
        {"error": error, "abs_error": F.abs(error), "pct_error": percent, "abs_pct_error": F.abs(percent)}
    )


def horizon_accuracy(matched: DataFrame) -> DataFrame:
    return matched.groupBy("horizon").agg(
        F.avg("abs_pct_error").alias("mape"), F.stddev_samp("abs_pct_error").alias("std"), F.count(F.lit(1)).alias("n")
    )


def residual_stats(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean and population deviation of actual minus prediction."""
    e = _error("actual", "prediction")
    return scored.groupBy(*keys).agg(F.count(e).alias("n"), F.avg(e).alias("mean_error"), F.stddev_pop(e).alias("std_error"))


def error_histogram(scored: DataFrame, bins: int = 20, keys: Sequence[str] = SERIES) -> DataFrame:
    """Counts in ``bins`` equal-width bins from the smallest to the largest error of each key, empty bins included.

    Two aggregates that combine on the map side; the edges table has one row per key.
    """
    errors = scored.select(*keys, _error("actual", "prediction").alias("error")).filter(F.col("error").isNotNull())
    spans = errors.groupBy(*keys).agg(F.min("error").alias("_low"), F.max("error").alias("_high"))
    # like numpy, a key with one single value gets a unit-wide range around it
    single = F.col("_low") == F.col("_high")
    low = F.when(single, F.col("_low") - 0.5).otherwise(F.col("_low"))
    high = F.when(single, F.col("_high") + 0.5).otherwise(F.col("_high"))
    spans = spans.select(*keys, low.alias("_low"), high.alias("_high"))
    spread = F.col("_high") - F.col("_low")
    bin_of = F.least(F.floor((F.col("error") - F.col("_low")) / spread * bins), F.lit(bins - 1)).cast("int")
    counts = errors.join(spans, list(keys)).groupBy(*keys, bin_of.alias("bin")).agg(F.count(F.lit(1)).alias("_found"))
    grid = spans.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return grid.join(counts, [*keys, "bin"], "left").select(
        *keys,
        "bin",
        (F.col("_low") + spread * F.col("bin") / bins).alias("bin_start"),
        (F.col("_low") + spread * (F.col("bin") + 1) / bins).alias("bin_end"),
        F.coalesce("_found", F.lit(0)).alias("n"),
    )


def improvement(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """By how many percent the mae fell from one metric table to another; 0 where it was 0."""
    joined = before.select(*keys, F.col("mae").alias("mae_before")).join(
        after.select(*keys, F.col("mae").alias("mae_after")), list(keys)
    )
    gain = ratio(F.col("mae_before") - F.col("mae_after"), F.col("mae_before")) * 100
    return joined.withColumn("improvement_pct", F.when(F.col("mae_before") > 0, gain).otherwise(0.0))


def mape_band(mape_column: Column) -> Column:
    return F.when(mape_column < 5, "good").when(mape_column < 10, "fair").when(mape_column.isNotNull(), "poor")


def evaluate_sequences(samples: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """mse, rmse and mae over all steps of sequence predictions (array columns ``y`` and ``y_hat``)."""
    steps = samples.select(*keys, F.inline(F.arrays_zip(F.col("y").alias("actual"), F.col("y_hat").alias("prediction"))))
    steps = steps.withColumns({c: F.col(c).cast("double") for c in ("actual", "prediction")})
    return steps.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_steps"), mse().alias("mse"), rmse().alias("rmse"), mae().alias("mae")
    )
