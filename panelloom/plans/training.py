"""From raw panel to features, trained models and their scores, for all series in one plan each."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.functions.frames import SERIES
from panelloom.operators.backtest import BASELINES, FIT_ERRORS, best_model, compare_models, forecast_split
from panelloom.operators.cleaning import clean
from panelloom.operators.features import generate
from panelloom.operators.filters import complete_cases, date_range, feature_columns, long_series, min_rows
from panelloom.operators.learners import Learner
from panelloom.operators.metrics import mape_band, naive_scale, score
from panelloom.operators.splits import chronological_split, validation_tail
from panelloom.operators.targets import add_target
from panelloom.session import checkpointed
from panelloom.sources.registry import ModelRegistry, RunLog

MIN_ROWS = 60
MIN_COMPLETE_ROWS = 100
POOLED_SCOPE = "all_series"


def prepare(
    raw: DataFrame, start: str | None = None, end: str | None = None, target: str = "none", clean_options: dict | None = None, **features
) -> DataFrame:
    """Filter, clean, add the target and the features."""
    panel = clean(date_range(raw, start, end), **(clean_options or {}))
    return generate(add_target(panel, target), **features)


def train_baselines(
    prepared: DataFrame, models: Sequence[str] = ("naive", "seasonal_naive"), **backtest
) -> tuple[DataFrame, DataFrame]:
    """Backtested baselines, and the series that are too short."""
    kept, rejected = min_rows(prepared, MIN_ROWS)
    return compare_models(kept, models, **backtest), rejected


def split_for_training(prepared: DataFrame, columns: Sequence[str], **split) -> tuple[DataFrame, DataFrame]:
    """Complete rows of the series that have enough of them, split in time, and the rejected series."""
    needed = [*columns, "value"]
    kept = long_series(complete_cases(long_series(prepared, MIN_ROWS), needed), MIN_COMPLETE_ROWS)
    complete = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in needed])
    counts = prepared.groupBy("series_id").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(complete).alias("n_complete"))
    rejected = counts.filter((F.col("n_rows") < MIN_ROWS) | (F.col("n_complete") < MIN_COMPLETE_ROWS)).select(
        "series_id",
        F.format_string(f"%d rows and %d complete rows, need {MIN_ROWS} and {MIN_COMPLETE_ROWS}", "n_rows", "n_complete").alias("error"),
    )
    return validation_tail(chronological_split(kept, **split)), rejected


def train_learners(
    prepared: DataFrame,
    kinds: Sequence[str] | Mapping[str, tuple[str, dict]] = ("gbt", "random_forest", "elastic_net"),
    params: dict[str, dict] | None = None,
    primary_metric: str = "mae",
    registry: ModelRegistry | None = None,
    runs: RunLog | None = None,
    leak_safe: bool = True,
    **split_options,
) -> dict:
    """Fit each learner on all series, score it per series, and keep the best one by the primary metric.

    ``kinds`` names learners, or maps names to a kind and its parameters. A learner whose data or parameters do not
    fit is reported in ``failed`` (``model, error``) and the others go on; a failing cluster ends the run. Returns
    also ``metrics`` (a row per series and model), ``winners`` (the best model of each series), ``rejected`` series,
    ``learners``, and ``best``, the one with the best mean over the series (None if no learner could be fitted).
    """
    wanted = kinds if isinstance(kinds, Mapping) else {kind: (kind, (params or {}).get(kind, {})) for kind in kinds}
    columns = feature_columns(prepared, leak_safe=leak_safe, day_of_week_flags=False)
    split, rejected = split_for_training(prepared, columns, **split_options)
    split = checkpointed(split)  # read by every fit and every score
    train, test = (split.filter(F.col("split") == s) for s in ("train", "test"))
    scales = naive_scale(train)
    learners, tables, failures = {}, [], []
    for name, (kind, own) in wanted.items():
        try:
            learner = Learner(kind, columns, own).fit(train, validation="is_validation" if kind == "gbt" else None)
        except FIT_ERRORS as error:
            failures.append((name, f"{type(error).__name__}: {error}"))
            continue
        learners[name] = learner
        scored = learner.predict(test).select("series_id", "date", F.col("value").alias("actual"), "prediction")
        tables.append(score(scored.join(scales, "series_id").withColumn("model", F.lit(name)), ("series_id", "model")))
    if not tables:
        none = test.limit(0).select("series_id", "date", F.col("value").alias("actual"), F.lit(None).cast("double").alias("prediction"))
        tables.append(score(none.join(scales, "series_id").withColumn("model", F.lit("")), ("series_id", "model")))
    spark = prepared.sparkSession
    metrics = checkpointed(reduce(DataFrame.unionByName, tables))
    winners = best_model(metrics, primary_metric)
    overall = {r["model"]: r.asDict() for r in metrics.groupBy("model").agg(*[F.avg(m).alias(m) for m in ("mae", "rmse", "mape", "smape", "mase")]).collect()}
    best = min(overall, key=lambda m: overall[m][primary_metric] if overall[m][primary_metric] is not None else float("inf"), default=None)
    if runs:
        for name, row in overall.items():
            runs.record(name, learners[name].params, {k: v for k, v in row.items() if k != "model"})
    if registry:
        for name, learner in learners.items():
            metric = overall.get(name, {}).get(primary_metric)
            registry.save(learner.model, POOLED_SCOPE, name, metric, primary_metric, best=name == best)
        registry.save_winners(winners, primary_metric)
    failed = spark.createDataFrame(failures, "model string, error string")
    return {"metrics": metrics, "winners": winners, "failed": failed, "rejected": rejected, "learners": learners, "best": best, "columns": columns}


def batch_results(prepared: DataFrame, model: str = "naive", columns: Sequence[str] | None = None) -> DataFrame:
    """Per series: train and test rows, errors and a band for the percentage error, or why it was left out."""
    columns = columns if columns is not None else feature_columns(prepared, leak_safe=False)
    complete = complete_cases(prepared, [*columns, "value"])
    split = chronological_split(long_series(complete, MIN_ROWS))
    sizes = split.groupBy("series_id").agg(
        F.count_if(F.col("split") == "train").alias("train_rows"), F.count_if(F.col("split") == "test").alias("test_rows")
    )
    metrics = score(forecast_split(split, (model,)), ("series_id",)).select("series_id", "mae", "rmse", "mape", "mase")
    table = sizes.join(metrics, "series_id", "left").withColumn("band", mape_band(F.col("mape")))
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (*columns, "value")])
    counts = prepared.groupBy("series_id").agg(F.count_if(known).alias("n_rows")).filter(F.col("n_rows") < MIN_ROWS)
    lost = counts.select("series_id", F.format_string(f"only %d rows, need {MIN_ROWS}", "n_rows").alias("error"))
    return table.unionByName(lost, allowMissingColumns=True)


def choose_baseline(split: DataFrame, by: str = "mase", models: Sequence[str] = BASELINES) -> DataFrame:
    """The best baseline of each series on its test rows."""
    return best_model(score(forecast_split(split, models), (*SERIES, "model")), by)
