"""Splits, folds, baseline backtests and model comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelloom.operators import backtest, splits
from panelloom.operators.cleaning import clean
from panelloom.operators.features import generate
from panelloom.operators.filters import complete_cases, feature_columns
from panelloom.operators.metrics import METRICS, score
from panelloom.plans.training import batch_results, choose_baseline
from panelloom.registered.catalog import day, query, rounded, rounded_sql, stable_sql
from panelloom.registered.panels import DAILY, EVENTS, SHIPMENTS, TICKS, clean_sql, daily_events, daily_orders, daily_shipments, order_ticks
from panelloom.session import shared_path
from panelloom.sources.registry import ModelRegistry, RunLog

FOLDS = {"initial": 252, "test": 30, "step": 30}


def split_sql(source: str, ratio: float = 0.8, min_test: int = 30, gap: int = 0) -> str:
    return f"""i AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY date) AS rn, count(*) OVER (PARTITION BY series_id) AS n FROM {source}),
sp AS (SELECT *, CASE WHEN rn <= cut THEN 'train' WHEN rn <= cut + {gap} THEN 'gap' ELSE 'test' END AS split FROM
  (SELECT *, CASE WHEN floor(n * {ratio}) > n - {min_test} - {gap} THEN greatest(n - {min_test} - {gap}, {min_test}) ELSE floor(n * {ratio}) END AS cut FROM i))"""


@query(
    "split_chronological",
    "P01",
    f"""WITH {SHIPMENTS}, {EVENTS}, u AS (SELECT * FROM p2 UNION ALL SELECT * FROM p3), {split_sql('u', gap=5)}
        SELECT series_id, CAST(date AS VARCHAR) AS date, value, split, CAST(cut AS INTEGER) AS train_size, cut + 5 >= n AS too_short FROM sp""",
)
def split_chronological(spark, sf_dir):
    union = daily_shipments(spark, sf_dir).unionByName(daily_events(spark, sf_dir))
    return splits.chronological_split(union, gap=5).select("series_id", day(), "value", "split", "train_size", "too_short")


@query(
    "split_features_target",
    "P02",
    f"""WITH {SHIPMENTS}, l AS (SELECT *, lag(value, 1) OVER w AS lag_1, lag(value, 7) OVER w AS lag_7 FROM p2
            WINDOW w AS (PARTITION BY series_id ORDER BY date)),
        c AS (SELECT * FROM l WHERE lag_7 IS NOT NULL), {split_sql('c')}
        SELECT series_id, CAST(date AS VARCHAR) AS date, split AS side, lag_1, lag_7, value AS label FROM sp""",
)
def split_features_target(spark, sf_dir):
    panel = generate(daily_shipments(spark, sf_dir), (1, 7), (), calendar=False, volatility=False, returns=False)
    sides = splits.features_and_target(splits.chronological_split(complete_cases(panel, ["lag_1", "lag_7"])), ["lag_1", "lag_7"])
    both = sides["train"].withColumn("side", F.lit("train")).unionByName(sides["test"].withColumn("side", F.lit("test")))
    return both.withColumn("date", F.col("date").cast("string"))


_SIDES = ", ".join(
    f"count(*) FILTER (split = '{s}') AS {s}_rows, CAST(min(date) FILTER (split = '{s}') AS VARCHAR) AS {s}_start, "
    f"CAST(max(date) FILTER (split = '{s}') AS VARCHAR) AS {s}_end"
    for s in ("train", "test")
)


@query(
    "split_summary",
    "P03",
    f"""WITH {SHIPMENTS}, {split_sql('p2', gap=7)} SELECT series_id, {_SIDES}, count(*) FILTER (split = 'gap') AS gap_rows,
        bool_or(cut + 7 >= n) AS too_short, CAST(max(date) FILTER (split = 'train') AS VARCHAR) AS split_date FROM sp GROUP BY 1""",
)
def split_summary(spark, sf_dir):
    summary = splits.split_summary(splits.chronological_split(daily_shipments(spark, sf_dir), gap=7))
    dates = ["train_start", "train_end", "test_start", "test_end", "split_date"]
    return summary.withColumns({c: F.col(c).cast("string") for c in dates})


@query(
    "split_validation_tail",
    "P04",
    f"""WITH {SHIPMENTS}, {split_sql('p2')} SELECT series_id, CAST(date AS VARCHAR) AS date, split,
        split = 'train' AND rn > cut - floor(cut * 0.1) AS is_validation FROM sp""",
)
def split_validation_tail(spark, sf_dir):
    split = splits.validation_tail(splits.chronological_split(daily_shipments(spark, sf_dir)))
    return split.select("series_id", day(), "split", "is_validation")


def _folds_sql(method: str, n_folds: int | None) -> str:
    start = "k * 30" if method == "rolling" else "0"
    cap = f"AND k < {n_folds}" if n_folds else ""
    return f"""WITH {SHIPMENTS}, i AS (SELECT series_id, date, row_number() OVER (PARTITION BY series_id ORDER BY date) - 1 AS i FROM p2),
        n AS (SELECT series_id, count(*) AS n FROM p2 GROUP BY 1),
        f AS (SELECT series_id, k, {start} AS s, 251 + k * 30 AS e FROM n, generate_series(0, 400) g(k)
              WHERE 251 + k * 30 + 30 < n {cap})
        SELECT f.series_id, CAST(k AS INTEGER) AS fold_id, CAST(max(CASE WHEN i = s THEN date END) AS VARCHAR) AS train_start,
          CAST(max(CASE WHEN i = e THEN date END) AS VARCHAR) AS train_end, CAST(max(CASE WHEN i = e + 1 THEN date END) AS VARCHAR) AS test_start,
          CAST(max(CASE WHEN i = e + 30 THEN date END) AS VARCHAR) AS test_end, CAST(e - s + 1 AS INTEGER) AS train_size, 30 AS test_size
        FROM f JOIN i ON i.series_id = f.series_id GROUP BY f.series_id, k, s, e"""


def _folds(spark, sf_dir, method, n_folds=None):
    rows = splits.folds(daily_shipments(spark, sf_dir), **FOLDS, method=method, n_folds=n_folds)
    return rows.withColumns({c: F.col(c).cast("string") for c in ("train_start", "train_end", "test_start", "test_end")})


@query("folds_walk_forward", "P05", _folds_sql("walk_forward", None))
def folds_walk_forward(spark, sf_dir):
    return _folds(spark, sf_dir, "walk_forward")


@query("folds_rolling", "P06", _folds_sql("rolling", None))
def folds_rolling(spark, sf_dir):
    return _folds(spark, sf_dir, "rolling")


@query("folds_expanding", "P07", _folds_sql("expanding", None))
def folds_expanding(spark, sf_dir):
    return _folds(spark, sf_dir, "expanding")


@query("folds_capped", "P08", _folds_sql("walk_forward", 4))
def folds_capped(spark, sf_dir):
    return _folds(spark, sf_dir, "walk_forward", 4)


def _rows_sql(method: str) -> str:
    low = "i.i >= k * 30" if method == "rolling" else "TRUE"
    return f"""WITH {SHIPMENTS}, i AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY date) - 1 AS i,
            count(*) OVER (PARTITION BY series_id) AS n FROM p2)
        SELECT series_id, CAST(date AS VARCHAR) AS date, value, CAST(k AS INTEGER) AS fold_id,
          CASE WHEN i.i <= 251 + k * 30 THEN 'train' ELSE 'test' END AS role
        FROM i JOIN generate_series(0, (SELECT max(n) // 30 FROM i)) g(k) ON 251 + k * 30 + 30 < n AND i.i <= 251 + k * 30 + 30 AND {low}"""


@query("fold_rows_walk_forward", "P09", _rows_sql("walk_forward"))
def fold_rows_walk_forward(spark, sf_dir):
    rows = splits.assign_folds(daily_shipments(spark, sf_dir), **FOLDS)
    return rows.select("series_id", day(), "value", "fold_id", "role")


@query("fold_rows_rolling", "P09", _rows_sql("rolling"))
def fold_rows_rolling(spark, sf_dir):
    rows = splits.assign_folds(daily_shipments(spark, sf_dir), **FOLDS, method="rolling")
    return rows.select("series_id", day(), "value", "fold_id", "role")


# ---- baseline forecasts

_MODEL_CASE = """CASE m WHEN 'naive' THEN last_v WHEN 'seasonal_naive' THEN season[CAST((step - 1) % 7 AS INTEGER) + 1]
   WHEN 'drift' THEN last_v + step * (last_v - first_v) / nullif(size - 1, 0) WHEN 'mean' THEN mean_v END"""


def forecast_sql(source: str, train: str, test: str) -> str:
    """CTE ``fc``: joins train statistics with test rows. ``train`` and ``test`` select rows of ``source`` per key."""
    return f"""tr AS ({train}),
st AS (SELECT key, arg_max(value, rn) AS last_v, arg_min(value, rn) AS first_v, count(*) AS size,
    avg(value) FILTER (rn > top - 30) AS mean_v, list(value ORDER BY rn) FILTER (rn > top - 7) AS season,
    avg(abs(diff)) AS scale_abs, avg(diff * diff) AS scale_sq
  FROM (SELECT *, max(rn) OVER (PARTITION BY key) AS top, value - lag(value) OVER (PARTITION BY key ORDER BY rn) AS diff FROM tr) GROUP BY key),
te AS ({test}),
fc AS (SELECT te.*, m AS model, {_MODEL_CASE} AS prediction, scale_abs, scale_sq
  FROM te JOIN st ON st.key = te.key, (VALUES ('naive'), ('seasonal_naive'), ('drift'), ('mean')) t(m))"""


SCORE_EXPR = """count(*) AS n, CAST(0 AS BIGINT) AS n_dropped, avg(abs(actual - prediction)) AS mae, sqrt(avg((actual - prediction) ** 2)) AS rmse,
  avg(abs(actual - prediction) / (abs(actual) + 1e-8)) * 100 AS mape,
  avg(2 * abs(actual - prediction) / (abs(actual) + abs(prediction) + 1e-8)) * 100 AS smape,
  CASE WHEN max(scale_abs) >= 1e-10 THEN avg(abs(actual - prediction)) / max(scale_abs) END AS mase,
  CASE WHEN max(scale_sq) >= 1e-10 THEN avg((actual - prediction) ** 2) / max(scale_sq) END AS msse,
  avg(CASE WHEN before IS NOT NULL THEN CAST(sign(actual - before) = sign(prediction - before_p) AS INTEGER) END) * 100 AS direction_accuracy"""


def score_sql(keys: str, source: str = "fc") -> str:
    return f"""sc AS (SELECT {keys}, {SCORE_EXPR} FROM (SELECT *, lag(actual) OVER w AS before, lag(prediction) OVER w AS before_p FROM {source}
        WINDOW w AS (PARTITION BY {keys} ORDER BY date)) GROUP BY {keys})"""


_SPLIT_FORECAST = forecast_sql(
    "sp",
    "SELECT series_id AS key, rn, value FROM sp WHERE split = 'train'",
    "SELECT series_id AS key, series_id, date, value AS actual, row_number() OVER (PARTITION BY series_id ORDER BY date) AS step FROM sp WHERE split = 'test'",
)
_M = list(METRICS)
_MODELS = {"baseline_naive": ("naive", "B01"), "baseline_seasonal_naive": ("seasonal_naive", "B02"), "baseline_drift": ("drift", "B03"), "baseline_mean": ("mean", "B04")}


def _register_baseline(name: str, model: str, item: str) -> None:
    sql = f"""WITH {SHIPMENTS}, {split_sql('p2')}, {_SPLIT_FORECAST}
        SELECT series_id, CAST(date AS VARCHAR) AS date, CAST(step AS INTEGER) AS step, actual, {rounded_sql(['prediction'])} FROM fc WHERE model = '{model}'"""

    @query(name, item, sql)
    def run(spark, sf_dir):
        split = splits.chronological_split(daily_shipments(spark, sf_dir))
        rows = backtest.forecast_split(split, (model,)).select("series_id", day(), "step", "actual", "prediction")
        return rounded(rows, ["prediction"])


for _name, (_model, _item) in _MODELS.items():
    _register_baseline(_name, _model, _item)


@query(
    "metric_bundle",
    "M01 M02 M03 M04 M05 M06 M07 M08",
    f"""WITH {SHIPMENTS}, {split_sql('p2')}, {_SPLIT_FORECAST}, {score_sql('series_id, model')}
        SELECT series_id, model, n, n_dropped, {rounded_sql(_M)} FROM sc""",
)
def metric_bundle(spark, sf_dir):
    split = splits.chronological_split(daily_shipments(spark, sf_dir))
    return rounded(score(backtest.forecast_split(split), ("series_id", "model")), _M)


_FLAG_FEATURES = ["lag_1", "lag_2", "lag_7", "lag_14", "lag_30", "rolling_mean_7", "rolling_std_7", "rolling_mean_30", "rolling_std_30"]
_FLAG_SQL = ", ".join(
    [f"lag(value, {k}) OVER w AS lag_{k}" for k in (1, 2, 7, 14, 30)]
    + [f"{f}(value) OVER (w ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) AS rolling_{s}_{n}" for n in (7, 30) for s, f in (("mean", "avg"), ("std", "stddev_samp"))]
)


@query(
    "baseline_scores_per_series",
    "B01 B12 C11 G01 G02 G03 P01 M08",
    f"""WITH {TICKS}, {clean_sql('p0')}, ft AS (SELECT series_id, date, value, {_FLAG_SQL} FROM cleaned WINDOW w AS (PARTITION BY series_id ORDER BY date)),
        ok AS (SELECT * FROM ft WHERE value IS NOT NULL AND {' AND '.join(f'{c} IS NOT NULL' for c in _FLAG_FEATURES)}),
        {split_sql('ok')}, {_SPLIT_FORECAST}, {score_sql('series_id, model')}
        SELECT series_id, model, n, n_dropped, {rounded_sql(_M)} FROM sc WHERE model = 'naive'""",
)
def baseline_scores_per_series(spark, sf_dir):
    """Orders to daily panel, cleaned, featured, split in time, forecast with the last value and scored per series."""
    features = generate(
        clean(order_ticks(spark, sf_dir)), (1, 2, 7, 14, 30), (7, 30), ("mean", "std"), calendar=False, volatility=False, returns=False
    )
    split = splits.chronological_split(complete_cases(features, [*_FLAG_FEATURES, "value"]))
    return rounded(score(backtest.forecast_split(split, ("naive",)), ("series_id", "model")), _M)


# ---- backtests


def _backtest_cte(method: str = "walk_forward") -> str:
    """CTE ``fc``: running statistics at the last train row of each fold, met by the test rows through their fold number.

    Test side and step are both 30 rows, so a row is tested in one fold.
    """
    rows = "ROWS BETWEEN {} PRECEDING AND CURRENT ROW"
    train = rows.format("251" if method == "rolling" else "UNBOUNDED")
    steps = rows.format("250" if method == "rolling" else "UNBOUNDED")
    return f"""i AS (SELECT series_id, date, value, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY series_id) AS n,
        value - lag(value) OVER w AS diff FROM p2 WINDOW w AS (PARTITION BY series_id ORDER BY date)),
en AS (SELECT series_id, (i - 251) // 30 AS fold_id, last_v, first_v, size, mean_v, season, scale_abs, scale_sq FROM (
        SELECT *, value AS last_v, first_value(value) OVER (w {train}) AS first_v, count(*) OVER (w {train}) AS size,
          avg(value) OVER (w {rows.format(29)}) AS mean_v, list(value) OVER (w {rows.format(6)}) AS season,
          avg(abs(diff)) OVER (w {steps}) AS scale_abs, avg(diff * diff) OVER (w {steps}) AS scale_sq
        FROM i WINDOW w AS (PARTITION BY series_id ORDER BY i))
    WHERE i >= 251 AND (i - 251) % 30 = 0 AND i + 30 < n),
te AS (SELECT series_id, (i - 252) // 30 AS fold_id, (i - 252) % 30 + 1 AS step, date, value AS actual FROM i WHERE i >= 252),
fc AS (SELECT te.*, m AS model, {_MODEL_CASE} AS prediction, scale_abs, scale_sq
    FROM te JOIN en USING (series_id, fold_id), (VALUES ('naive'), ('seasonal_naive'), ('drift'), ('mean')) t(m))"""


def _predictions(spark, sf_dir, method="walk_forward"):
    return backtest.backtest_predictions(daily_shipments(spark, sf_dir), **FOLDS, method=method)


def _predictions_sql(method: str) -> str:
    return f"""WITH {SHIPMENTS}, {_backtest_cte(method)}
        SELECT series_id, model, CAST(fold_id AS INTEGER) AS fold_id, CAST(step AS INTEGER) AS step, CAST(date AS VARCHAR) AS date, actual,
          {rounded_sql(['prediction'])}, {rounded_sql(['scale_abs'])} FROM fc"""


def _prediction_rows(df):
    return rounded(df.select("series_id", "model", "fold_id", "step", day(), "actual", "prediction", "scale_abs"), ["prediction", "scale_abs"])


@query("backtest_run_walk_forward", "P10", _predictions_sql("walk_forward"))
def backtest_run_walk_forward(spark, sf_dir):
    return _prediction_rows(_predictions(spark, sf_dir))


@query("backtest_run_rolling", "P10 P06", _predictions_sql("rolling"))
def backtest_run_rolling(spark, sf_dir):
    return _prediction_rows(_predictions(spark, sf_dir, "rolling"))


@query(
    "backtest_fold_results",
    "P11",
    f"""WITH {SHIPMENTS}, {_backtest_cte()}, {score_sql('series_id, model, fold_id')}
        SELECT series_id, model, CAST(fold_id AS INTEGER) AS fold_id, n, n_dropped, {rounded_sql(_M)} FROM sc""",
)
def backtest_fold_results(spark, sf_dir):
    return rounded(backtest.fold_results(_predictions(spark, sf_dir)).drop("train_end"), _M)


_MEANS = ", ".join(f"{stable_sql(f'avg({m})')} AS {m}_mean, {stable_sql(f'stddev_pop({m})')} AS {m}_std" for m in _M)
_MEAN_NAMES = [f"{m}_{k}" for m in _M for k in ("mean", "std")]


@query(
    "backtest_compare_models",
    "P12 P13",
    f"""WITH {SHIPMENTS}, {_backtest_cte()}, {score_sql('series_id, model, fold_id')}
        SELECT series_id, model, CAST(count(*) AS INTEGER) AS n_folds, {_MEANS} FROM sc GROUP BY 1, 2""",
)
def backtest_compare_models(spark, sf_dir):
    return rounded(backtest.compare_models(daily_shipments(spark, sf_dir), **FOLDS), _MEAN_NAMES)


@query(
    "model_leaderboard",
    "P14",
    f"""WITH {SHIPMENTS}, {split_sql('p2')}, {_SPLIT_FORECAST}, {score_sql('series_id, model')}
        SELECT series_id, model, {rounded_sql(['mae'])}, CAST(row_number() OVER (PARTITION BY series_id ORDER BY mae, model) AS INTEGER) AS place FROM sc""",
)
def model_leaderboard(spark, sf_dir):
    split = splits.chronological_split(daily_shipments(spark, sf_dir))
    board = backtest.leaderboard(score(backtest.forecast_split(split), ("series_id", "model")))
    return rounded(board.select("series_id", "model", "mae", "place"), ["mae"])


@query(
    "model_best",
    "P14",
    f"""WITH {SHIPMENTS}, {split_sql('p2')}, {_SPLIT_FORECAST}, {score_sql('series_id, model')}
        SELECT series_id, model, {rounded_sql(['mase'])} FROM sc QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY mase, model) = 1""",
)
def model_best(spark, sf_dir):
    best = choose_baseline(splits.chronological_split(daily_shipments(spark, sf_dir)))
    return rounded(best.select("series_id", "model", "mase"), ["mase"])


@query(
    "registry_winners",
    "S13 P14",
    f"""WITH {SHIPMENTS}, {split_sql('p2')}, {_SPLIT_FORECAST}, {score_sql('series_id, model')},
        w AS (SELECT series_id, model, 'mase' AS metric_name, mase AS metric FROM sc WHERE mase IS NOT NULL
              QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY mase, model) = 1)
        SELECT series_id, model, metric_name, {rounded_sql(['metric'])} FROM w""",
)
def registry_winners(spark, sf_dir):
    """Winners saved twice, first by another metric; the registry gives the last ones."""
    registry = ModelRegistry(spark, shared_path(spark, "registry"))
    scores = score(backtest.forecast_split(splits.chronological_split(daily_shipments(spark, sf_dir))), ("series_id", "model"))
    for metric in ("mae", "mase"):
        registry.save_winners(backtest.best_model(scores, metric), metric)
    return rounded(registry.winners(), ["metric"])


@query(
    "run_log_entries",
    "S14",
    f"""WITH {SHIPMENTS}, {split_sql('p2')}, {_SPLIT_FORECAST}, {score_sql('series_id, model')}
        SELECT model AS run_name, '0.8' AS train_ratio, {stable_sql('avg(mae)', 2)} AS mae, {stable_sql('avg(rmse)', 2)} AS rmse FROM sc GROUP BY model""",
)
def run_log_entries(spark, sf_dir):
    """A run of each baseline with its parameters and mean errors, recorded and read back."""
    runs = RunLog(spark, shared_path(spark, "runs"))
    scores = score(backtest.forecast_split(splits.chronological_split(daily_shipments(spark, sf_dir))), ("series_id", "model"))
    for row in scores.groupBy("model").agg(F.avg("mae").alias("mae"), F.avg("rmse").alias("rmse")).collect():  # a row a model
        runs.record(row["model"], {"train_ratio": 0.8}, {"mae": row["mae"], "rmse": row["rmse"]})
    metrics = {m: F.col("metrics")[m] for m in ("mae", "rmse")}
    return rounded(runs.read().select("run_name", F.col("params")["train_ratio"].alias("train_ratio"), *[c.alias(m) for m, c in metrics.items()]), ["mae", "rmse"], 2)


@query(
    "predictions_fit_length",
    "P15",
    f"""WITH {SHIPMENTS}, {split_sql('p2')}, {_SPLIT_FORECAST}, d AS (SELECT * FROM fc WHERE model = 'drift'),
        s AS (SELECT series_id, step, arg_max(prediction, step) OVER (PARTITION BY series_id ORDER BY step) AS p0, prediction FROM d),
        l AS (SELECT series_id, max(CASE WHEN step = 20 THEN prediction END) AS tail FROM d GROUP BY 1)
        SELECT s.series_id, CAST(step AS INTEGER) AS step, {stable_sql('CASE WHEN step <= 20 THEN s.prediction ELSE tail END')} AS prediction
        FROM s JOIN l ON l.series_id = s.series_id""",
)
def predictions_fit_length(spark, sf_dir):
    """Forecasts of twenty steps, held at their last value over the longer test side."""
    rows = backtest.forecast_split(splits.chronological_split(daily_shipments(spark, sf_dir)), ("drift",))
    fitted = backtest.fit_length(rows.filter(F.col("step") <= 20), rows.select("series_id", "step"))
    return rounded(fitted.select("series_id", "step", "prediction"), ["prediction"])


@query(
    "batch_result_table",
    "B11 M16 F07",
    f"""WITH {SHIPMENTS}, {EVENTS}, u AS (SELECT * FROM p2 UNION ALL SELECT * FROM p3),
        l AS (SELECT *, lag(value, 30) OVER (PARTITION BY series_id ORDER BY date) AS lag_30 FROM u),
        c AS (SELECT * FROM l WHERE lag_30 IS NOT NULL), e AS (SELECT *, count(*) OVER (PARTITION BY series_id) AS k FROM c),
        ok AS (SELECT * FROM e WHERE k >= 60), {split_sql('ok')}, {_SPLIT_FORECAST}, {score_sql('series_id, model')},
        sz AS (SELECT series_id, count(*) FILTER (split = 'train') AS train_rows, count(*) FILTER (split = 'test') AS test_rows FROM sp GROUP BY 1)
        SELECT sz.series_id, train_rows, test_rows, {rounded_sql(['mae', 'rmse', 'mape', 'mase'])},
          CASE WHEN mape < 5 THEN 'good' WHEN mape < 10 THEN 'fair' ELSE 'poor' END AS band, CAST(NULL AS VARCHAR) AS error
        FROM sz JOIN sc ON sc.series_id = sz.series_id AND model = 'naive'
        UNION ALL
        SELECT u.series_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL,
          'only ' || count(c.date) || ' rows, need 60' FROM (SELECT DISTINCT series_id FROM u) u LEFT JOIN c ON c.series_id = u.series_id
        GROUP BY 1 HAVING count(c.date) < 60""",
)
def batch_result_table(spark, sf_dir):
    union = daily_shipments(spark, sf_dir).unionByName(daily_events(spark, sf_dir))
    panel = generate(union.drop("ingest_seq"), (30,), (), calendar=False, volatility=False, returns=False)
    return rounded(batch_results(panel, "naive", feature_columns(panel)), ["mae", "rmse", "mape", "mase"])
