"""Predict all series with a saved model or a baseline."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.operators.cleaning import clean
from panelloom.operators.features import generate
from panelloom.operators.filters import as_of
from panelloom.operators.forecast import HORIZONS, forecast_baselines, forecast_recursive, forecast_state, pick_horizons
from panelloom.operators.learners import apply_model, model_columns
from panelloom.session import checkpointed


def predict_all(
    raw: DataFrame,
    model: PipelineModel | str | Sequence[str] = "naive",
    horizons: Sequence[int] = HORIZONS,
    as_of_date: str | None = None,
    refresh: str = "full",
    columns: Sequence[str] | None = None,
    ticks: DataFrame | None = None,
    dealt: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """The prediction table, and the series that could not be predicted.

    ``model`` is a fitted model or the name of a baseline; several names are stacked with a ``model`` column.
    ``as_of_date`` hides later rows. ``ticks`` and ``dealt`` are those of ``clean``.
    """
    seen, ticks = (as_of(df, as_of_date) if as_of_date and df is not None else df for df in (raw, ticks))
    cleaned = clean(seen, ticks=ticks, dealt=dealt)
    horizon = max(horizons)
    if not isinstance(model, PipelineModel):
        forecast = forecast_baselines(cleaned, horizon, (model,) if isinstance(model, str) else model)
        forecast = forecast.drop("model") if isinstance(model, str) else forecast
        reached = forecast.select("series_id").distinct()
    else:
        features = generate(cleaned)
        columns = columns or model_columns(model)
        state, _ = forecast_state(features, columns)
        forecast = forecast_recursive(state, lambda df: apply_model(model, df, columns), columns, horizon, refresh)
        reached = state.select("series_id")
    lost = raw.select("series_id").distinct().join(reached, "series_id", "left_anti")
    picked = pick_horizons(forecast, horizons).withColumn("prediction_date", F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss"))
    return picked, lost.withColumn("error", F.lit("no usable rows"))


def predict_routed(
    raw: DataFrame,
    winners: DataFrame,
    models: Mapping[str, PipelineModel | str],
    horizons: Sequence[int] = HORIZONS,
    as_of_date: str | None = None,
    refresh: str = "full",
    columns: Sequence[str] | None = None,
    fallback: str = "naive",
    ticks: DataFrame | None = None,
    dealt: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """``predict_all`` with the model that ``winners`` (``series_id, model``) names for each series.

    One pass for all baselines, whose few rows of a series meet its winner at the end, and one for each fitted model, over
    the series routed to it. A series without a winner, or whose winner is not among ``models``, is routed to the
    ``fallback`` baseline. The predictions have a ``model`` column. ``ticks`` and ``dealt`` are those of ``clean``, for the rows
    of all series.
    """
    known = winners.filter(F.col("model").isin(*models)).select("series_id", F.col("model").alias("_model"))
    kinds = {**models, fallback: models.get(fallback, fallback)}
    baselines = {name: model for name, model in kinds.items() if isinstance(model, str)}
    fitted = {name: model for name, model in kinds.items() if name not in baselines}
    if fitted:
        known = checkpointed(known)  # read by every pass
    # no more names a series than there are models
    routes = known.filter(F.col("_model") != fallback).groupBy("series_id").agg(F.collect_set("_model").alias("_routes"))
    routes = routes.select(F.col("series_id").alias("_series"), F.when(F.col("series_id").isNotNull(), F.col("_routes")).alias("_routes"))
    parts, lost = [], []
    if baselines:
        bases = F.create_map(*[F.lit(x) for pair in baselines.items() for x in pair])

        def routed_rows(df: DataFrame) -> DataFrame:
            """The rows once for each baseline their series is routed to, its name in ``_name``.

            Null matches null: a plain join would drop it from the winners, whose panel would then not be the one of the
            forecasts and would be shuffled on its own.
            """
            names = F.coalesce("_routes", F.array(F.lit(fallback)))
            named = df.join(routes, F.col("series_id").eqNullSafe(F.col("_series")), "left").withColumn("_name", F.explode(names))
            return named.drop("_routes", "_series").filter(F.col("_name").isin(*baselines))

        some, shape = raw, {"ticks": ticks, "dealt": dealt}
        if fitted:
            shape = {}
            elsewhere = routes.filter(~F.arrays_overlap("_routes", F.array(*[F.lit(name) for name in baselines])))
            some = raw.join(elsewhere, F.col("series_id") == F.col("_series"), "left_anti")
        picked, missing = predict_all(some, sorted(set(baselines.values())), horizons, as_of_date, **shape)
        picked = routed_rows(picked).filter(F.col("model") == bases[F.col("_name")])
        parts.append(picked.drop("model").withColumnRenamed("_name", "model"))
        lost.append(routed_rows(missing).drop("_name"))
    for name, model in fitted.items():
        if name == fallback:
            routed = raw.join(routes, F.col("series_id") == F.col("_series"), "left_anti")
        else:
            routed = raw.join(known.filter(F.col("_model") == name), "series_id", "left_semi")
        picked, missing = predict_all(routed, model, horizons, as_of_date, refresh, columns)
        parts.append(picked.withColumn("model", F.lit(name)))
        lost.append(missing)
    return reduce(DataFrame.unionByName, parts), reduce(DataFrame.unionByName, lost)
