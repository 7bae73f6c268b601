"""Baseline forecasts, and backtests of them, as window plans.

What a baseline needs from its train rows (last value, first value, mean of the last rows, last season,
naive scale) is a running aggregate at the last train row. So no fold copies its train rows: the plan reads
the running columns at each fold end, and the test rows come along as an array of bounded length.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException, ArithmeticException, IllegalArgumentException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelloom.functions.frames import SERIES, by_date, running, whole
from panelloom.operators.metrics import METRICS, score
from panelloom.operators.splits import FOLD_METHODS, in_fold, last_fold, with_positions
from panelloom.session import shared_path

BASELINES = ("naive", "seasonal_naive", "drift", "mean")
SEASON = 7
MEAN_WINDOW = 30
#: What a fit raises for its data or parameters, as opposed to a failing cluster.
FIT_ERRORS = (ValueError, ArithmeticError, ArithmeticException, AnalysisException, IllegalArgumentException)


def train_state(w, season: int = SEASON, mean_window: int = MEAN_WINDOW, train_rows: int | None = None) -> dict[str, Column]:
    """What the baselines know when the row is the last train row; ``train_rows`` bounds a rolling train window."""
    value = F.col("value")
    rows = running(w) if train_rows is None else w.rowsBetween(-(train_rows - 1), 0)
    steps = running(w) if train_rows is None else w.rowsBetween(-(train_rows - 2), 0)
    mean_rows = mean_window if train_rows is None else min(mean_window, train_rows)
    return {
        "_size": F.count(F.lit(1)).over(rows),
        "_first": F.first(value).over(rows),
        "_last": value,
        "_mean": F.avg(value).over(w.rowsBetween(-(mean_rows - 1), 0)),
        "_season": F.collect_list(value).over(w.rowsBetween(-(season - 1), 0)),
        "scale_abs": F.avg(F.abs(F.col("_step"))).over(steps),
        "scale_sq": F.avg(F.col("_step") * F.col("_step")).over(steps),
    }


def add_train_state(df: DataFrame, w, near: Column, season: int = SEASON, mean_window: int = MEAN_WINDOW) -> DataFrame:
    """``train_state`` of the rows ``near`` holds for, or does not know; the others go.

    ``near`` must hold for the rows asked for and for the ``season`` and ``mean_window`` rows up to each. Frames that slide add
    up their rows anew for every row, so they run over these rows alone; what runs along is worked out before.
    """
    state = train_state(w, season, mean_window)
    sliding = {name: state.pop(name) for name in ("_mean", "_season")}
    return df.withColumns(state).filter(F.coalesce(near, F.lit(True))).withColumns(sliding)


def baseline_prediction(model: str, step: Column) -> Column:
    """Forecast ``step`` rows after the train end from the state columns."""
    if model == "naive":
        return F.col("_last")
    if model == "seasonal_naive":
        size = F.size("_season")
        return F.get("_season", (step - 1) % size)
    if model == "drift":
        slope = F.try_divide(F.col("_last") - F.col("_first"), F.col("_size") - 1)
        return F.col("_last") + step * F.coalesce(slope, F.lit(0.0))
    if model == "mean":
        return F.col("_mean")
    raise ValueError(f"baseline must be one of {BASELINES}")


def _per_model(df: DataFrame, models: Sequence[str], step: Column, keep: Sequence[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(m).alias("model"), baseline_prediction(m, step).alias("prediction")) for m in models])
    return df.select(*keep, F.inline(pairs))


def forecast_split(
    split: DataFrame,
    models: Sequence[str] = BASELINES,
    season: int = SEASON,
    mean_window: int = MEAN_WINDOW,
    keys: Sequence[str] = SERIES,
) -> DataFrame:
    """Baseline predictions for the test rows of a ``chronological_split``, in long format, with naive scales."""
    w = by_date(keys)
    is_end = F.col("row_number") == F.col("train_size")
    df = split.withColumns({"_step": F.col("value") - F.lag("value").over(w), "_at": F.row_number().over(w)})
    df = df.withColumn("_end", F.min(F.when(is_end, F.col("_at"))).over(whole(w)))
    near = (F.col("_at") > F.col("_end") - max(season, mean_window)) | (F.col("split") == "test")
    df = add_train_state(df, w, near, season, mean_window)
    state = F.struct("_size", "_first", "_last", "_mean", "_season", "scale_abs", "scale_sq")
    at_end = F.when(is_end, state)
    df = df.withColumn("_state", F.last(at_end, ignorenulls=True).over(running(w))).filter(F.col("split") == "test")
    df = df.select(*keys, "date", F.col("value").alias("actual"), "row_number", "train_size", "_state.*")
    first_test = F.min("row_number").over(whole(w))
    df = df.withColumn("step", F.col("row_number") - first_test + 1)
    return _per_model(df, models, F.col("step"), [*keys, "date", "step", "actual", "scale_abs", "scale_sq"])


def backtest_predictions(
    df: DataFrame,
    models: Sequence[str] = BASELINES,
    initial: int = 504,
    test: int = 30,
    step: int = 30,
    method: str = "walk_forward",
    n_folds: int | None = None,
    season: int = SEASON,
    mean_window: int = MEAN_WINDOW,
    keys: Sequence[str] = SERIES,
) -> DataFrame:
    """Test rows of every fold with the baseline predictions. Rows without a value are left out first."""
    if method not in FOLD_METHODS:
        raise ValueError(f"fold method must be one of {FOLD_METHODS}")
    w = by_date(keys)
    known = df.filter(F.col("value").isNotNull())
    placed = known.withColumns(
        {
            "_step": F.col("value") - F.lag("value").over(w),
            "_at": F.row_number().over(w) - 1,
            "_n": F.count(F.lit(1)).over(whole(w)),
            "_test": F.collect_list(F.struct("date", F.col("value").alias("actual"))).over(w.rowsBetween(1, test)),
        }
    )
    placed = placed.withColumns(train_state(w, season, mean_window, initial if method == "rolling" else None))
    past = F.col("_at") - (initial - 1)
    fold = (past / step).cast("int")
    ends = placed.filter((past >= 0) & (past % step == 0)).withColumn("fold_id", fold)
    ends = ends.filter(F.col("fold_id") <= last_fold(F.col("_n"), initial, test, step, n_folds))
    state = ["_size", "_first", "_last", "_mean", "_season", "scale_abs", "scale_sq"]
    rows = ends.select(*keys, "fold_id", F.col("date").alias("train_end"), *state, F.posexplode("_test").alias("_i", "_row"))
    rows = rows.select("*", (F.col("_i") + 1).alias("step"), "_row.date", "_row.actual")
    return _per_model(rows, models, F.col("step"), [*keys, "fold_id", "train_end", "step", "date", "actual", "scale_abs", "scale_sq"])


def fold_results(predictions: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """One row of metrics per series, model and fold."""
    spans = (*keys, "model", "fold_id", "train_end")
    return score(predictions, spans)


def fold_summary(results: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """Mean and population deviation of every metric over the folds of a model."""
    columns = [F.count(F.lit(1)).cast("int").alias("n_folds")]
    for m in METRICS:
        columns += [F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std")]
    return results.groupBy(*keys, "model").agg(*columns)


def compare_models(df: DataFrame, models: Sequence[str] = BASELINES, keys: Sequence[str] = SERIES, **backtest) -> DataFrame:
    return fold_summary(fold_results(backtest_predictions(df, models, keys=keys, **backtest), keys), keys)


@dataclass
class FittedBacktest:
    """``predictions`` of all folds that could be fitted, and a row ``fold_id, model, error`` for each that could not."""

    predictions: DataFrame
    failed: DataFrame
    n_folds: int


def run_backtest(
    df: DataFrame,
    fit: Callable[[DataFrame], Callable[[DataFrame], DataFrame]],
    model: str,
    keys: Sequence[str] = SERIES,
    *,
    initial: int = 504,
    test: int = 30,
    step: int = 30,
    method: str = "walk_forward",
    n_folds: int | None = None,
    parallelism: int = 4,
) -> FittedBacktest:
    """Backtest a fitted model: one distributed fit per fold over all series.

    ``fit`` takes train rows and returns a function that adds ``prediction``. Rows are stored once by fold block, and
    a fold is a range of blocks: its fit and its scoring read those alone. The number of folds comes from the longest
    series (``n_folds`` may cut it) and so is bounded by the calendar; ``parallelism`` folds are fitted at a time. A
    fold whose data or parameters do not fit (``FIT_ERRORS``) is reported; a failing cluster ends the run.
    """
    spark = df.sparkSession
    shape = {"initial": initial, "test": test, "step": step}
    placed = with_positions(df.filter(F.col("value").isNotNull()), **shape, n_folds=n_folds, keys=keys).filter(F.col("last_fold").isNotNull())
    folder = shared_path(spark, "backtest")
    placed.repartition("fold_block", *keys).write.partitionBy("fold_block").parquet(folder)
    rows = spark.read.schema(placed.schema).parquet(folder)
    last = rows.agg(F.max("last_fold")).first()[0]
    total = 0 if last is None else last + 1

    def run_fold(fold_id: int) -> DataFrame | str:
        train, held = (rows.filter(in_fold(fold_id, role, **shape, method=method)) for role in ("train", "test"))
        try:
            predict = fit(train)
        except FIT_ERRORS as error:
            return f"{type(error).__name__}: {error}"
        return predict(held).select(*keys, F.lit(fold_id).alias("fold_id"), F.lit(model).alias("model"), "date", F.col("value").alias("actual"), "prediction")

    with ThreadPoolExecutor(max(1, parallelism)) as pool:
        done = list(pool.map(inheritable_thread_target(spark)(run_fold), range(total)))
    failures = [(i, model, d) for i, d in enumerate(done) if isinstance(d, str)]
    failed = spark.createDataFrame(failures, "fold_id int, model string, error string")
    empty = rows.limit(0).select(*keys, F.lit(0).alias("fold_id"), F.lit(model).alias("model"), "date", F.col("value").alias("actual"), F.lit(None).cast("double").alias("prediction"))
    return FittedBacktest(reduce(DataFrame.unionByName, [d for d in done if not isinstance(d, str)], empty), failed, total)


def leaderboard(metrics: DataFrame, by: str = "mae", keys: Sequence[str] = SERIES) -> DataFrame:
    """Add ``place`` of each model within its series, best first; models without the metric come last."""
    order = by_date(keys).orderBy(F.col(by).asc_nulls_last(), F.col("model"))
    return metrics.withColumn("place", F.row_number().over(order))


def best_model(metrics: DataFrame, by: str = "mase", keys: Sequence[str] = SERIES) -> DataFrame:
    """The winner table: the row of the best model of each series that has the metric; ties go to the first name."""
    rest = [c for c in metrics.columns if c not in keys]
    known = metrics.filter(F.col(by).isNotNull())
    return known.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(by, "model")).alias("_best")).select(*keys, "_best.*")


def fit_length(predictions: DataFrame, test: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """Predictions by ``step`` cut or padded (with their last value) to the test steps."""
    w = by_date(keys, "step")
    joined = test.join(predictions.select(*keys, "step", "prediction"), [*keys, "step"], "left")
    return joined.withColumn("prediction", F.last("prediction", ignorenulls=True).over(running(w)))
