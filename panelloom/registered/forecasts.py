"""Forecasts of all series."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelloom.functions.calendar import business_day_after
from panelloom.operators import forecast, splits
from panelloom.operators.backtest import BASELINES, forecast_split
from panelloom.operators.cleaning import clean
from panelloom.operators.features import generate
from panelloom.plans.prediction import predict_all, predict_routed
from panelloom.plans.training import choose_baseline
from panelloom.registered.catalog import day, query, rounded, rounded_sql, stable_sql
from panelloom.registered.panels import SHIPMENTS, TICKS, WEEKDAY, clean_sql, daily_shipments, dealt_shipments, order_ticks, shipment_ticks, weekday_orders
from panelloom.registered.splits import _MODEL_CASE, _SPLIT_FORECAST, score_sql, split_sql

_PRICES = ["predicted_price", "ci_lower", "ci_upper"]


def _baseline_sql(source: str, horizon: int) -> str:
    """CTE ``bf``: baseline forecasts on the next business days, by listing days and counting."""
    return f"""x AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY date) AS rn, count(*) OVER (PARTITION BY series_id) AS size
  FROM {source} WHERE value IS NOT NULL),
st AS (SELECT series_id, max(date) AS last_date, arg_max(value, rn) AS last_v, arg_min(value, rn) AS first_v, max(size) AS size,
    avg(value) FILTER (rn > size - 30) AS mean_v, list(value ORDER BY rn) FILTER (rn > size - 7) AS season FROM x GROUP BY 1),
dy AS (SELECT series_id, CAST(unnest(generate_series(last_date + 1, last_date + {2 * horizon + 4}, INTERVAL 1 DAY)) AS DATE) AS date FROM st),
bd AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY date) AS step FROM dy WHERE isodow(date) < 6),
pf AS (SELECT bd.series_id, m AS model, step, date, last_date, last_v, greatest({_MODEL_CASE}, 0.01) AS predicted_price
  FROM bd JOIN st ON st.series_id = bd.series_id, (VALUES ('naive'), ('seasonal_naive'), ('drift'), ('mean')) t(m) WHERE step <= {horizon}),
bf AS (SELECT *, greatest(predicted_price - 1.96 * 0.02 * last_v * sqrt(step), 0) AS ci_lower, predicted_price + 1.96 * 0.02 * last_v * sqrt(step) AS ci_upper FROM pf)"""


@query(
    "forecast_baselines",
    "I01 I03 I07",
    f"""WITH {SHIPMENTS}, {_baseline_sql('p2', 30)}
        SELECT series_id, model, CAST(step AS INTEGER) AS day_ahead, CAST(date AS VARCHAR) AS date, {rounded_sql(_PRICES)} FROM bf""",
)
def forecast_baselines(spark, sf_dir):
    rows = forecast.forecast_baselines(daily_shipments(spark, sf_dir), 30)
    return rounded(rows.select("series_id", "model", "day_ahead", day(), *_PRICES), _PRICES)


@query(
    "forecast_interval_confidence",
    "I03",
    f"""WITH {SHIPMENTS}, {_baseline_sql('p2', 30)}
        SELECT series_id, CAST(step AS INTEGER) AS day_ahead, {stable_sql('greatest(predicted_price - 1.2815515655446004e0 * 500e0 * sqrt(step), 0)')} AS ci_lower,
          {stable_sql('predicted_price + 1.2815515655446004e0 * 500e0 * sqrt(step)')} AS ci_upper FROM bf WHERE model = 'naive'""",
)
def forecast_interval_confidence(spark, sf_dir):
    rows = forecast.forecast_baselines(daily_shipments(spark, sf_dir), 30, ("naive",), residual_std=500, z=forecast.z_of(0.8))
    return rounded(rows.select("series_id", "day_ahead", "ci_lower", "ci_upper"), ["ci_lower", "ci_upper"])


# test errors of every baseline of a series, as a table of deviations
_RESIDUALS = f"""rs AS (WITH {split_sql('p2')}, {_SPLIT_FORECAST}
  SELECT series_id, model, stddev_samp(actual - prediction) AS spread FROM fc GROUP BY 1, 2)"""


@query(
    "forecast_interval_per_series",
    "I03",
    f"""WITH {SHIPMENTS}, {_RESIDUALS}, {_baseline_sql('p2', 30)}
        SELECT bf.series_id, bf.model, CAST(step AS INTEGER) AS day_ahead,
          {stable_sql('greatest(predicted_price - 1.96e0 * coalesce(spread, 0.02e0 * last_v) * sqrt(step), 0)')} AS ci_lower,
          {stable_sql('predicted_price + 1.96e0 * coalesce(spread, 0.02e0 * last_v) * sqrt(step)')} AS ci_upper
        FROM bf LEFT JOIN rs ON rs.series_id = bf.series_id AND rs.model = bf.model""",
)
def forecast_interval_per_series(spark, sf_dir):
    """Each series and baseline with the deviation of its own errors on the held-out rows."""
    panel = daily_shipments(spark, sf_dir)
    spreads = forecast.residual_deviation(forecast_split(splits.chronological_split(panel)))
    rows = forecast.forecast_baselines(panel, 30, residual_std=spreads)
    return rounded(rows.select("series_id", "model", "day_ahead", "ci_lower", "ci_upper"), ["ci_lower", "ci_upper"])


# the winner of each series on its held-out rows, and the forecast of that model alone
_WINNERS = f"""known AS (SELECT * FROM cleaned WHERE value IS NOT NULL), wn AS (WITH {split_sql('known')}, {_SPLIT_FORECAST}, {score_sql('series_id, model')}
  SELECT series_id, model FROM sc WHERE mase IS NOT NULL QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY mase, model) = 1)"""


@query(
    "predict_best_per_series",
    "S13 I05 P14",
    f"""WITH {SHIPMENTS}, {clean_sql('p2')}, {_WINNERS}, {_baseline_sql('cleaned', 30)}
        SELECT bf.series_id, bf.model, CAST(last_date AS VARCHAR) AS as_of_date, CAST(step AS INTEGER) AS horizon, CAST(date AS VARCHAR) AS target_date,
          {stable_sql('predicted_price')} AS prediction, last_v AS last_close, {stable_sql('(predicted_price - last_v) / last_v * 100')} AS predicted_change_pct
        FROM bf LEFT JOIN wn ON wn.series_id = bf.series_id WHERE bf.model = coalesce(wn.model, 'naive') AND step IN (1, 7, 30)""",
)
def predict_best_per_series(spark, sf_dir):
    """Every series forecast by the baseline that did best on its held-out rows, one pass for each kind of model."""
    raw, dealt = dealt_shipments(spark, sf_dir)
    shape = {"ticks": shipment_ticks(spark, sf_dir), "dealt": dealt}
    winners = choose_baseline(splits.chronological_split(clean(raw, **shape).filter(F.col("value").isNotNull())))
    rows, _ = predict_routed(raw, winners, {m: m for m in BASELINES}, **shape)
    rows = rows.drop("prediction_date").withColumns({c: F.col(c).cast("string") for c in ("as_of_date", "target_date")})
    return rounded(rows, ["prediction", "predicted_change_pct"])


@query(
    "forecast_pick_horizons",
    "I04",
    f"""WITH {SHIPMENTS}, {_baseline_sql('p2', 30)} SELECT series_id, model, CAST(last_date AS VARCHAR) AS as_of_date, CAST(step AS INTEGER) AS horizon,
          CAST(date AS VARCHAR) AS target_date, {stable_sql('predicted_price')} AS prediction, last_v AS last_close,
          {stable_sql('(predicted_price - last_v) / last_v * 100')} AS predicted_change_pct FROM bf WHERE step IN (1, 7, 30)""",
)
def forecast_pick_horizons(spark, sf_dir):
    rows = forecast.pick_horizons(forecast.forecast_baselines(daily_shipments(spark, sf_dir), 30))
    rows = rows.withColumns({c: F.col(c).cast("string") for c in ("as_of_date", "target_date")})
    return rounded(rows, ["prediction", "predicted_change_pct"])


@query(
    "predict_all_naive",
    "I05 F02",
    f"""WITH {TICKS}, past AS (SELECT * FROM p0 WHERE date <= DATE '2000-06-30'), {clean_sql('past')}, {_baseline_sql('cleaned', 30)}
        SELECT series_id, CAST(last_date AS VARCHAR) AS as_of_date, CAST(step AS INTEGER) AS horizon, CAST(date AS VARCHAR) AS target_date,
          {stable_sql('predicted_price')} AS prediction, last_v AS last_close, {stable_sql('(predicted_price - last_v) / last_v * 100')} AS predicted_change_pct
        FROM bf WHERE model = 'naive' AND step IN (1, 7, 30)""",
)
def predict_all_naive(spark, sf_dir):
    rows, _ = predict_all(order_ticks(spark, sf_dir), "naive", as_of_date="2000-06-30")
    rows = rows.drop("prediction_date").withColumns({c: F.col(c).cast("string") for c in ("as_of_date", "target_date")})
    return rounded(rows, ["prediction", "predicted_change_pct"])


@query(
    "forecast_stack_and_history",
    "I07 I08",
    f"""WITH {SHIPMENTS}, {_baseline_sql('p2', 30)},
        h AS (SELECT series_id, NULL AS model, 'history' AS part, date, value AS price FROM p2 QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY date DESC) <= 60),
        j AS (SELECT series_id, model, 'forecast' AS part, last_date AS date, last_v AS price FROM bf WHERE step = 1 AND model IN ('naive', 'drift')),
        f AS (SELECT series_id, model, 'forecast' AS part, date, predicted_price AS price FROM bf WHERE model IN ('naive', 'drift')),
        a AS (SELECT * FROM h UNION ALL SELECT * FROM j UNION ALL SELECT * FROM f)
        SELECT series_id, model, part, CAST(date AS VARCHAR) AS date, {rounded_sql(['price'])} FROM a""",
)
def forecast_stack_and_history(spark, sf_dir):
    panel = daily_shipments(spark, sf_dir)
    runs = {m: forecast.forecast_baselines(panel, 30, (m,)).drop("model") for m in ("naive", "drift")}
    line = forecast.history_and_forecast(panel, forecast.stack_models(runs))
    return rounded(line.withColumn("date", F.col("date").cast("string")), ["price"])


_STEPS = 30
_COLUMNS = ["lag_1", "rolling_mean_7", "day_of_week"]


def _blend(df):
    """A stand-in for a fitted model with a closed form, so SQL can follow the recursion."""
    return df.withColumn("prediction", 0.6 * F.col("lag_1") + 0.4 * F.col("rolling_mean_7") + F.col("day_of_week"))


def _recursive_sql(price: str, weekday: str, keep: int = 60, least: int = 1) -> str:
    """Recursion over day numbers with the history as a list."""
    return f"""WITH RECURSIVE {WEEKDAY}, k AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY date DESC) AS k FROM p1b),
        b AS (SELECT series_id, max(date) AS last_date, list(value ORDER BY date) AS h FROM k WHERE k <= {keep} GROUP BY 1 HAVING max(k) >= {least}),
        r(series_id, last_date, date, step, h) AS (
          SELECT series_id, last_date, last_date, 0, h FROM b
          UNION ALL
          SELECT series_id, last_date, nd, step + 1, list_append(h, greatest({price} + {weekday}, 0.01))
          FROM (SELECT *, date + CASE isodow(date) WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 1 END AS nd FROM r WHERE step < {_STEPS}))
        SELECT series_id, step AS day_ahead, CAST(date AS VARCHAR) AS date, {stable_sql('h[-1]')} AS predicted_price FROM r WHERE step > 0"""


def _recursive(spark, sf_dir, refresh):
    features = generate(weekday_orders(spark, sf_dir), (1, 7), (7,), ("mean",), volatility=False, returns=False)
    state, _ = forecast.forecast_state(features, _COLUMNS)
    rows = forecast.forecast_recursive(state, _blend, _COLUMNS, _STEPS, refresh)
    return rounded(rows.select("series_id", "day_ahead", day(), "predicted_price"), ["predicted_price"])


@query("forecast_recursive_full", "I01 I06", _recursive_sql("0.6 * h[-1] + 0.4 * list_avg(h[-7:])", "(isodow(nd) - 1)"))
def forecast_recursive_full(spark, sf_dir):
    return _recursive(spark, sf_dir, "full")


# the features belong to the last row: its lag is the value before it, and its weekday stays as it was
@query("forecast_recursive_partial", "I01 I02", _recursive_sql("0.6 * h[-2] + 0.4 * list_avg(h[-8:-2])", "(isodow(last_date) - 1)"))
def forecast_recursive_partial(spark, sf_dir):
    return _recursive(spark, sf_dir, "partial")


@query("forecast_recursive_long", "I01 I06", _recursive_sql("0.6 * h[-300] + 0.4 * list_avg(h[-365:])", "0", 365, 301))
def forecast_recursive_long(spark, sf_dir):
    """Features that look back over a year; series too short for the lag are left out."""
    columns = ["lag_300", "rolling_mean_365"]
    features = generate(weekday_orders(spark, sf_dir), (300,), (365,), ("mean",), volatility=False, returns=False)
    state, _ = forecast.forecast_state(features, columns)

    def blend(df):
        return df.withColumn("prediction", 0.6 * F.col("lag_300") + 0.4 * F.col("rolling_mean_365"))

    rows = forecast.forecast_recursive(state, blend, columns, _STEPS)
    return rounded(rows.select("series_id", "day_ahead", day(), "predicted_price"), ["predicted_price"])


@query(
    "calendar_kth_business_day",
    "F08 F09",
    """WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CAST(o_custkey % 40 + 1 AS INTEGER) AS k FROM orders),
       c AS (SELECT DISTINCT d FROM o), g AS (SELECT d, d + CAST(n AS INTEGER) AS e FROM c, generate_series(1, 70) t(n)),
       w AS (SELECT d, e, row_number() OVER (PARTITION BY d ORDER BY e) AS k FROM g WHERE isodow(e) < 6)
       SELECT o_orderkey, CAST(w.e AS VARCHAR) AS due FROM o JOIN w ON w.d = o.d AND w.k = o.k""",
)
def calendar_kth_business_day(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    due = business_day_after(F.col("o_orderdate").cast("date"), (F.col("o_custkey") % 40 + 1).cast("int"))
    return orders.select("o_orderkey", due.cast("string").alias("due"))
