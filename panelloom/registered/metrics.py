"""Error metrics and error analytics beyond the metric bundle."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelloom.functions.frames import by_date
from panelloom.operators import backtest, metrics, monitoring, splits
from panelloom.operators.quantiles import exact_quantiles
from panelloom.registered.catalog import query, rounded, rounded_sql, stable_sql
from panelloom.registered.logs import LOG, prediction_log
from panelloom.registered.panels import SHIPMENTS, daily_shipments
from panelloom.registered.splits import SCORE_EXPR, _SPLIT_FORECAST, score_sql, split_sql
from panelloom.sources.writers import wide_predictions


def _forecasts(spark, sf_dir, models=backtest.BASELINES):
    return backtest.forecast_split(splits.chronological_split(daily_shipments(spark, sf_dir)), models)


_BASE = f"WITH {SHIPMENTS}, {split_sql('p2')}, {_SPLIT_FORECAST}"


@query(
    "metric_naive_scale_seasonal",
    "M05 M06",
    f"""WITH {SHIPMENTS}, d AS (SELECT series_id, value - lag(value, 7) OVER (PARTITION BY series_id ORDER BY date) AS d FROM p2),
        s AS (SELECT series_id, avg(abs(d)) AS scale_abs, avg(d * d) / 1e6 AS scale_sq FROM d GROUP BY 1)
        SELECT series_id, {rounded_sql(['scale_abs', 'scale_sq'])} FROM s""",
)
def metric_naive_scale_seasonal(spark, sf_dir):
    scale = metrics.naive_scale(daily_shipments(spark, sf_dir), 7)
    return rounded(scale.withColumn("scale_sq", F.col("scale_sq") / 1e6), ["scale_abs", "scale_sq"])


_FOUR = ["mae", "rmse", "mape", "smape", "direction_accuracy"]


@query(
    "metric_by_horizon",
    "M09",
    f"""WITH {LOG}, b AS (SELECT *, lag(actual) OVER w AS before, lag(prediction) OVER w AS before_p, NULL AS scale_abs, NULL AS scale_sq FROM lg
            WINDOW w AS (PARTITION BY series_id, horizon ORDER BY target_date)),
        s AS (SELECT series_id, horizon, {SCORE_EXPR} FROM b GROUP BY 1, 2)
        SELECT series_id, horizon, n, n_dropped, {rounded_sql(_FOUR)} FROM s""",
)
def metric_by_horizon(spark, sf_dir):
    log = prediction_log(spark, sf_dir).withColumnRenamed("target_date", "date")
    return rounded(metrics.score_by_horizon(log, [1, 7, 30, 90]), _FOUR)


_MATCHED = """m AS (SELECT lg.*, lg.prediction - p2.value AS err, (lg.prediction - p2.value) / p2.value * 100 AS pct
  FROM lg JOIN p2 ON p2.series_id = lg.series_id AND p2.date = lg.target_date + 1)"""


def _matched(spark, sf_dir):
    """The log's predictions taken as forecasts of the next day, so some have no actual."""
    predictions = prediction_log(spark, sf_dir).drop("actual", "error").withColumn("target_date", F.date_add("target_date", 1))
    return metrics.match_actuals(predictions, daily_shipments(spark, sf_dir))


@query(
    "metric_match_actuals",
    "M10",
    f"""WITH {LOG}, {_MATCHED} SELECT series_id, record_seq, horizon, CAST(target_date + 1 AS VARCHAR) AS target_date,
          {stable_sql('err')} AS error, {stable_sql('abs(err)')} AS abs_error, {stable_sql('pct')} AS pct_error, {stable_sql('abs(pct)')} AS abs_pct_error
        FROM m""",
)
def metric_match_actuals(spark, sf_dir):
    names = ["error", "abs_error", "pct_error", "abs_pct_error"]
    rows = _matched(spark, sf_dir).select("series_id", "record_seq", "horizon", F.col("target_date").cast("string").alias("target_date"), *names)
    return rounded(rows, names)


@query(
    "metric_horizon_accuracy",
    "M11",
    f"""WITH {LOG}, {_MATCHED}, s AS (SELECT horizon, avg(abs(pct)) AS mape, stddev_samp(abs(pct)) AS std, count(*) AS n FROM m GROUP BY 1)
        SELECT horizon, {rounded_sql(['mape', 'std'])}, n FROM s""",
)
def metric_horizon_accuracy(spark, sf_dir):
    return rounded(metrics.horizon_accuracy(_matched(spark, sf_dir)), ["mape", "std"])


@query(
    "metric_error_quartiles",
    "M12",
    f"""WITH {LOG}, {_MATCHED}, s AS (SELECT horizon, count(pct) AS n, quantile_cont(pct, 0.25) AS q25, quantile_cont(pct, 0.5) AS q50,
            quantile_cont(pct, 0.75) AS q75, min(pct) AS low, max(pct) AS high FROM m GROUP BY 1)
        SELECT horizon, n, {rounded_sql(['q25', 'q50', 'q75', 'low', 'high'])} FROM s""",
)
def metric_error_quartiles(spark, sf_dir):
    boxes = exact_quantiles(_matched(spark, sf_dir), ["horizon"], "pct_error", [0.25, 0.5, 0.75, 0.0, 1.0])
    names = ["q25", "q50", "q75", "low", "high"]
    return rounded(boxes.select("horizon", "n", *[F.get("quantiles", F.lit(i)).alias(c) for i, c in enumerate(names)]), names)


@query(
    "metric_residual_stats",
    "M13",
    f"""{_BASE}, s AS (SELECT series_id, model, count(*) AS n, avg(actual - prediction) AS mean_error, stddev_pop(actual - prediction) AS std_error
          FROM fc GROUP BY 1, 2) SELECT series_id, model, n, {rounded_sql(['mean_error', 'std_error'])} FROM s""",
)
def metric_residual_stats(spark, sf_dir):
    return rounded(metrics.residual_stats(_forecasts(spark, sf_dir), ("series_id", "model")), ["mean_error", "std_error"])


@query(
    "metric_error_histogram",
    "M14",
    f"""{_BASE}, e AS (SELECT series_id, model, actual - prediction AS e FROM fc),
        b AS (SELECT series_id, model, min(e) AS lo, max(e) AS hi FROM e GROUP BY 1, 2),
        c AS (SELECT e.series_id, e.model, CAST(least(floor((e - lo) / (hi - lo) * 20), 19) AS INTEGER) AS bin, count(*) AS n
              FROM e JOIN b ON b.series_id = e.series_id AND b.model = e.model GROUP BY 1, 2, 3)
        SELECT b.series_id, b.model, CAST(k AS INTEGER) AS bin, {stable_sql('lo + (hi - lo) * k / 20', 2)} AS bin_start,
          {stable_sql('lo + (hi - lo) * (k + 1) / 20', 2)} AS bin_end, coalesce(c.n, 0) AS n
        FROM b CROSS JOIN generate_series(0, 19) g(k) LEFT JOIN c ON c.series_id = b.series_id AND c.model = b.model AND c.bin = k""",
)
def metric_error_histogram(spark, sf_dir):
    bins = metrics.error_histogram(_forecasts(spark, sf_dir), 20, ("series_id", "model"))
    return rounded(bins, ["bin_start", "bin_end"], 2)


@query(
    "metric_improvement",
    "M15",
    f"""{_BASE}, s AS (SELECT series_id, avg(abs(actual - prediction)) FILTER (model = 'naive') AS mae_before,
            avg(abs(actual - prediction)) FILTER (model = 'mean') AS mae_after FROM fc GROUP BY 1),
        g AS (SELECT *, CASE WHEN mae_before > 0 THEN (mae_before - mae_after) / mae_before * 100 ELSE 0.0 END AS improvement_pct FROM s)
        SELECT series_id, {rounded_sql(['mae_before', 'mae_after', 'improvement_pct'])} FROM g""",
)
def metric_improvement(spark, sf_dir):
    table = metrics.score(_forecasts(spark, sf_dir, ("naive", "mean")), ("series_id", "model"))
    gain = metrics.improvement(*(table.filter(F.col("model") == m) for m in ("naive", "mean")), ("series_id",))
    return rounded(gain, ["mae_before", "mae_after", "improvement_pct"])


@query(
    "metric_mape_band",
    "M16",
    f"""{_BASE}, {score_sql('series_id, model')} SELECT series_id, model,
        CASE WHEN mape < 5 THEN 'good' WHEN mape < 10 THEN 'fair' ELSE 'poor' END AS band FROM sc""",
)
def metric_mape_band(spark, sf_dir):
    table = metrics.score(_forecasts(spark, sf_dir), ("series_id", "model"))
    return table.select("series_id", "model", metrics.mape_band(F.col("mape")).alias("band"))


@query(
    "metric_sequence_evaluation",
    "M17",
    f"""WITH {SHIPMENTS}, i AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY date) AS i, count(*) OVER (PARTITION BY series_id) AS n FROM p2),
        e AS (SELECT a.series_id, b.value - a.value AS e FROM i a JOIN i b ON b.series_id = a.series_id AND b.i BETWEEN a.i + 1 AND a.i + 5 WHERE a.i + 5 <= a.n),
        s AS (SELECT series_id, count(*) AS n_steps, avg(e * e) / 1e6 AS mse, sqrt(avg(e * e)) AS rmse, avg(abs(e)) AS mae FROM e GROUP BY 1)
        SELECT series_id, n_steps, {rounded_sql(['mse', 'rmse', 'mae'])} FROM s""",
)
def metric_sequence_evaluation(spark, sf_dir):
    """Five-step sequences predicted by repeating the last value."""
    w = by_date()
    samples = daily_shipments(spark, sf_dir).withColumn("y", F.collect_list("value").over(w.rowsBetween(1, 5))).filter(F.size("y") == 5)
    result = metrics.evaluate_sequences(samples.withColumn("y_hat", F.array_repeat("value", 5)))
    return rounded(result.withColumn("mse", F.col("mse") / 1e6), ["mse", "rmse", "mae"])


@query(
    "metric_rolling_log",
    "M18 M19",
    f"""WITH {LOG}, s AS (SELECT series_id, record_seq, avg(error) OVER (PARTITION BY series_id ORDER BY timestamp, record_seq
            ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS rolling_error FROM lg)
        SELECT series_id, record_seq, {rounded_sql(['rolling_error'])} FROM s""",
)
def metric_rolling_log(spark, sf_dir):
    rolled = monitoring.rolling_metric(prediction_log(spark, sf_dir), "error", chunk_rows=512)
    return rounded(rolled.select("series_id", "record_seq", "rolling_error"), ["rolling_error"])


@query(
    "metric_degradation",
    "M20",
    f"""WITH {LOG}, r AS (SELECT series_id, avg(error) OVER (PARTITION BY series_id ORDER BY record_seq ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS r,
            row_number() OVER (PARTITION BY series_id ORDER BY record_seq DESC) AS k, count(*) OVER (PARTITION BY series_id) AS n FROM lg),
        s AS (SELECT series_id, avg(r) FILTER (k <= 30) AS recent, avg(r) FILTER (k BETWEEN 31 AND 60) AS earlier, max(n) AS n FROM r GROUP BY 1)
        SELECT series_id, n >= 60 AND earlier >= 1e-10 AND (recent - earlier) / earlier > 0.2 AS degraded, {rounded_sql(['recent', 'earlier'])} FROM s""",
)
def metric_degradation(spark, sf_dir):
    return rounded(monitoring.degradation(prediction_log(spark, sf_dir), "error"), ["recent", "earlier"])


@query(
    "export_wide_predictions",
    "S11",
    f"""{_BASE} SELECT series_id, CAST(date AS VARCHAR) AS date, max(actual) AS actual,
        {', '.join(stable_sql(f"max(prediction) FILTER (model = '{m}')") + f' AS {m}' for m in backtest.BASELINES)} FROM fc GROUP BY 1, 2""",
)
def export_wide_predictions(spark, sf_dir):
    wide = wide_predictions(_forecasts(spark, sf_dir), backtest.BASELINES)
    return rounded(wide.withColumn("date", F.col("date").cast("string")), list(backtest.BASELINES))
