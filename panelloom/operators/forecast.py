"""Forecasts of all series at once.

A series is one row of state: its last date and an array of as many latest values as its features look back on
(all of them, one a day, for features that reach back to the start). A forecast step is a projection over that
table, so a horizon of H costs H narrow stages and no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelloom.functions.calendar import business_day_after
from panelloom.functions.frames import SERIES, by_date, whole
from panelloom.functions.history import last_n, needed_history, next_features, refreshed_features
from panelloom.functions.numeric import ratio
from panelloom.operators.backtest import BASELINES, MEAN_WINDOW, SEASON, add_train_state, baseline_prediction
from panelloom.operators.filters import tail
from panelloom.session import checkpointed

PRICE_FLOOR = 0.01
Z_95 = 1.96
DEFAULT_SPREAD = 0.02
HORIZONS = (1, 7, 30)
CHECKPOINT_EVERY = 7


def z_of(confidence: float) -> float:
    """Two-sided normal quantile of a confidence level."""
    from statistics import NormalDist

    return NormalDist().inv_cdf(0.5 + confidence / 2)


def residual_deviation(scored: DataFrame, by: Sequence[str] = (*SERIES, "model")) -> DataFrame:
    """``by, residual_std``: sample deviation of the errors of held-out predictions; NULL with fewer than two."""
    return scored.groupBy(*by).agg(F.stddev_samp(F.col("actual") - F.col("prediction")).alias("residual_std"))


def add_interval(df: DataFrame, residual_std: DataFrame | Column | float | None = None, z: float = Z_95) -> DataFrame:
    """``ci_lower`` and ``ci_upper``: grows with the root of the days ahead, and never goes below zero.

    ``residual_std`` is a number for all, a column, or a table of ``residual_deviation``, joined by its other columns.
    Where there is none it is two percent of the last price.
    """
    scratch = []
    if isinstance(residual_std, DataFrame):
        by = [c for c in residual_std.columns if c != "residual_std"]
        df = df.join(residual_std, by, "left")
        residual_std, scratch = F.col("residual_std"), ["residual_std"]
    elif residual_std is None:
        residual_std = F.lit(None).cast("double")
    elif not isinstance(residual_std, Column):
        residual_std = F.lit(float(residual_std))
    spread = F.coalesce(residual_std, F.col("last_price") * DEFAULT_SPREAD)
    width = z * spread * F.sqrt(F.col("day_ahead").cast("double"))
    price = F.col("predicted_price")
    return df.withColumns({"ci_lower": F.greatest(price - width, F.lit(0.0)), "ci_upper": price + width}).drop(*scratch)


def forecast_baselines(
    panel: DataFrame,
    horizon: int = 30,
    models: Sequence[str] = BASELINES,
    residual_std: DataFrame | Column | float | None = None,
    z: float = Z_95,
    keys: Sequence[str] = SERIES,
) -> DataFrame:
    """Business-day forecasts of the baselines, stacked with a ``model`` column."""
    w = by_date(keys)
    known = panel.filter(F.col("value").isNotNull()).withColumns(
        {
            "_step": F.col("value") - F.lag("value").over(w),
            "_next": F.lead("date").over(w),
            "_left": F.count(F.lit(1)).over(whole(w)) - F.row_number().over(w),
        }
    )
    # rows without a date come first, and one before another has no next date either
    state = add_train_state(known, w, F.col("date").isNull() | (F.col("_left") < max(SEASON, MEAN_WINDOW)))
    state = state.filter(F.col("_next").isNull()).withColumns({"last_date": F.col("date"), "last_price": F.col("value")})
    steps = state.withColumn("day_ahead", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    price = [
        F.struct(
            F.lit(m).alias("model"),
            F.greatest(baseline_prediction(m, F.col("day_ahead")), F.lit(PRICE_FLOOR)).alias("predicted_price"),
        )
        for m in models
    ]
    date = business_day_after(F.col("last_date"), F.col("day_ahead")).alias("date")
    rows = steps.select(*keys, "last_date", "last_price", "day_ahead", date, F.inline(F.array(*price)))
    return add_interval(rows, residual_std, z)


def forecast_state(
    features: DataFrame, columns: Sequence[str], history: int | None = None, keys: Sequence[str] = SERIES
) -> tuple[DataFrame, DataFrame]:
    """One row per series: latest values, last date and the features of the last complete row.

    ``history`` is the number of values kept; by default as many as the columns need. It must be given for columns that
    ``needed_history`` has no rule for. Values up to the last complete row are kept in their places, missing ones too,
    so lags count rows as the feature windows do. Also returns the series without any complete row.
    """
    history = history or needed_history(columns)
    w = by_date(keys)
    complete = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (*columns, "value")])
    seen = features.select(*keys, "date", "value", *columns).withColumn("_end", F.max(F.when(complete, F.col("date"))).over(whole(w)))
    seen = seen.filter(F.col("date") <= F.col("_end")).drop("_end")
    last = tail(seen, history, keys) if history else seen
    state = last.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("date", "value"))), lambda s: s["value"]).alias("history"),
        F.max("date").alias("last_date"),
        F.max_by("value", "date").alias("last_price"),
        F.max_by(F.struct(*columns), F.col("date")).alias("_features"),
    )
    lost = features.select(*keys).distinct().join(state.select(*keys), list(keys), "left_anti")
    state = state.select(*keys, "history", "last_date", "last_price", "_features.*")
    return state, lost.withColumn("error", F.lit("no complete row to forecast from"))


def forecast_recursive(
    state: DataFrame,
    predict: Callable[[DataFrame], DataFrame],
    columns: Sequence[str],
    horizon: int = 30,
    refresh: str = "full",
    residual_std: DataFrame | Column | float | None = None,
    z: float = Z_95,
    history: int | None = None,
    keys: Sequence[str] = SERIES,
) -> DataFrame:
    """Predict one business day at a time and feed each prediction back.

    ``predict`` adds a ``prediction`` column from the feature columns. ``full`` works out every feature of the
    new day from the history; ``partial`` predicts from the last row's features and afterwards updates only
    lags, rolling statistics, returns and volatility. Missing features count as 0.
    """
    if refresh not in ("full", "partial"):
        raise ValueError("refresh must be 'full' or 'partial'")
    date = F.col("_date")
    path = F.array().cast("array<struct<date:date,price:double>>")
    df = state.withColumns({"_date": F.col("last_date"), "_path": path})
    kept = [*keys, "last_date", "last_price"]
    # every step applies the same expressions, so they are built once
    fresh = next_features(F.col("history"), date, columns) if refresh == "full" else {}
    known = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns}
    floored = F.greatest(F.col("prediction"), F.lit(PRICE_FLOOR))
    history = history or needed_history(columns)
    longer = F.concat("history", F.array("prediction"))
    longer = (last_n(longer, history) if history else longer).alias("history")
    extended = F.concat("_path", F.array(F.struct(date.alias("date"), F.col("prediction").alias("price")))).alias("_path")
    updated = refreshed_features(F.col("history"), columns) if refresh == "partial" else {}
    for day in range(1, horizon + 1):
        df = df.withColumn("_date", business_day_after(date, F.lit(1)))
        if refresh == "full":
            df = df.withColumns(fresh)
        priced = predict(df.withColumns(known)).withColumn("prediction", floored)
        df = priced.select(*kept, "_date", longer, extended, *columns)
        if refresh == "partial":
            df = df.withColumns(updated)
        # also after the last step: unfolding the path would push its filter down through every step
        if day % CHECKPOINT_EVERY == 0 or day == horizon:
            df = checkpointed(df)
    rows = df.select(*kept, F.posexplode("_path").alias("_i", "_p")).select(
        *kept, (F.col("_i") + 1).alias("day_ahead"), F.col("_p.date").alias("date"), F.col("_p.price").alias("predicted_price")
    )
    return add_interval(rows, residual_std, z)


def pick_horizons(forecast: DataFrame, horizons: Sequence[int] = HORIZONS, keys: Sequence[str] = SERIES) -> DataFrame:
    """The prediction table: chosen days ahead with target date and change against the last price."""
    wanted = sorted({int(h) for h in horizons})
    if not wanted or wanted[0] < 1:
        raise ValueError("horizons must be positive")
    change = ratio(F.col("predicted_price") - F.col("last_price"), F.col("last_price")) * 100
    extra = ["model"] if "model" in forecast.columns else []
    return forecast.filter(F.col("day_ahead").isin(wanted)).select(
        *keys,
        *extra,
        F.col("last_date").alias("as_of_date"),
        F.col("day_ahead").alias("horizon"),
        F.col("date").alias("target_date"),
        F.col("predicted_price").alias("prediction"),
        F.col("last_price").alias("last_close"),
        change.alias("predicted_change_pct"),
    )


def stack_models(forecasts: dict[str, DataFrame]) -> DataFrame:
    """Union of the forecasts of several models with a ``model`` column."""
    return reduce(DataFrame.unionByName, [df.withColumn("model", F.lit(name)) for name, df in forecasts.items()])


def history_and_forecast(panel: DataFrame, forecast: DataFrame, rows: int = 60, keys: Sequence[str] = SERIES) -> DataFrame:
    """The last history rows, then per model the last known point followed by the forecast."""
    past = tail(panel.filter(F.col("value").isNotNull()), rows, keys)
    past = past.select(*keys, F.lit(None).cast("string").alias("model"), F.lit("history").alias("part"), "date", F.col("value").alias("price"))
    line = forecast.select(*keys, "model", F.lit("forecast").alias("part"), "date", F.col("predicted_price").alias("price"))
    joint = forecast.filter(F.col("day_ahead") == 1).select(
        *keys, "model", F.lit("forecast").alias("part"), F.col("last_date").alias("date"), F.col("last_price").alias("price")
    )
    return past.unionByName(joint).unionByName(line)
