"""Pooled Spark ML models with their default parameters, on a panel with a planted weekly course.

Fitting has no SQL twin. SQL states what must hold whatever the fit gives: which rows are held out, in which fold, that
each gets a prediction, and that the planted course is learned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.operators import forecast, learners
from panelloom.operators.backtest import run_backtest
from panelloom.operators.filters import complete_cases, feature_columns
from panelloom.plans.prediction import predict_all
from panelloom.plans.training import prepare, split_for_training, train_learners
from panelloom.registered.catalog import day, query, stable_sql
from panelloom.registered.features import _ALL, _RETURNS_CTE, _W
from panelloom.registered.panels import clean_sql, planted_ticks, PLANTED
from panelloom.registered.splits import split_sql
from panelloom.session import checkpointed

# rows where every feature is known; the weighted deviation wants seven returns, runs want yesterday's return
_COMPLETE = f"""{PLANTED}, {clean_sql('p5')}, {_RETURNS_CTE.format(stage='cleaned')},
fe AS (SELECT series_id, date, value, {', '.join(f'{e} AS {n}' for n, e in _ALL.items())},
    count(return_1d) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n_returns FROM r WINDOW {_W}),
cc AS (SELECT series_id, date, value FROM fe WHERE value IS NOT NULL AND n_returns >= 7 AND {' AND '.join(f'{n} IS NOT NULL' for n in _ALL)}),
ok AS (SELECT * FROM cc QUALIFY count(*) OVER (PARTITION BY series_id) >= 100), {split_sql('ok')}"""


def _prepared(spark, sf_dir) -> DataFrame:
    return prepare(planted_ticks(spark, sf_dir))


def _split(spark, sf_dir):
    prepared = _prepared(spark, sf_dir)
    columns = feature_columns(prepared, day_of_week_flags=False)
    split, _ = split_for_training(prepared, columns)
    return checkpointed(split), columns


def _fitted(spark, sf_dir, kind):
    split, columns = _split(spark, sf_dir)
    return learners.Learner(kind, columns).fit(split.filter(F.col("split") == "train"), "is_validation"), split, columns


def _register(name: str, kind: str, item: str) -> None:
    sql = f"WITH {_COMPLETE} SELECT series_id, CAST(date AS VARCHAR) AS date, value AS actual, TRUE AS predicted, TRUE AS beats_mean FROM sp WHERE split = 'test'"

    @query(name, item, sql)
    def run(spark, sf_dir):
        learner, split, _ = _fitted(spark, sf_dir, kind)
        train, test = (split.filter(F.col("split") == side) for side in ("train", "test"))
        means = train.groupBy("series_id").agg(F.avg("value").alias("mean"))
        scored = learner.predict(test).join(means, "series_id").select("series_id", "date", F.col("value").alias("actual"), "mean", "prediction")
        scored = checkpointed(scored)
        errors = scored.agg(*[F.avg(F.abs(F.col("actual") - F.col(c))).alias(c) for c in ("prediction", "mean")]).first()
        known = F.col("prediction").isNotNull() & ~F.isnan("prediction")
        better = errors["prediction"] is not None and errors["prediction"] < errors["mean"]
        return scored.select("series_id", day(), "actual", known.alias("predicted"), F.lit(better).alias("beats_mean"))


_register("learner_gradient_boosting", "gbt", "B05")
_register("learner_random_forest", "random_forest", "B06")
_register("learner_elastic_net", "elastic_net", "B07")


@query(
    "learner_random_search",
    "B08",
    "SELECT CAST(i AS INTEGER) AS place, i = 1 AS chosen, TRUE AS scored, CAST(10 AS BIGINT) AS different FROM generate_series(1, 10) t(i)",
)
def learner_random_search(spark, sf_dir):
    """Ten draws from the space of the linear learner, each scored over three contiguous blocks of dates."""
    split, columns = _split(spark, sf_dir)
    best, scores = learners.random_search(split.filter(F.col("split") == "train"), "elastic_net", columns)
    ranked = sorted(scores, key=lambda s: s[1])
    rows = [(i, params == best.params, score > 0) for i, (params, score) in enumerate(ranked, 1)]
    different = len({str(sorted(params.items())) for params, _ in scores})
    return spark.createDataFrame(rows, "place int, chosen boolean, scored boolean").withColumn("different", F.lit(different).cast("bigint"))


@query(
    "learner_feature_importance",
    "B09",
    "SELECT CAST(i AS INTEGER) AS place, TRUE AS in_order, TRUE AS share_of_one, TRUE AS planted_first FROM generate_series(1, 20) t(i)",
)
def learner_feature_importance(spark, sf_dir):
    """The twenty most important features of a forest: in falling order, shares of one, the weekly course first."""
    learner, _, _ = _fitted(spark, sf_dir, "random_forest")
    top = learner.importances(20).collect()
    every = learner.importances(len(learner.columns)).agg(F.sum("importance")).first()[0]
    weekly = top[0]["feature"] in ("day_of_week", "lag_7", "lag_14", "lag_21")
    rows = [(i + 1, i == 0 or top[i - 1]["importance"] >= r["importance"], abs(every - 1) < 1e-9, weekly) for i, r in enumerate(top)]
    return spark.createDataFrame(rows, "place int, in_order boolean, share_of_one boolean, planted_first boolean")


@query(
    "learner_train_all",
    "B10 B12 S13",
    f"""WITH {_COMPLETE}, a AS (SELECT series_id, count(*) AS n_rows FROM cleaned GROUP BY 1), t AS (SELECT series_id, count(*) FILTER (split = 'test') AS n FROM sp GROUP BY 1)
        SELECT series_id, model, n, FALSE AS failed FROM t, (VALUES ('gbt'), ('random_forest'), ('elastic_net'), ('best')) m(model)
        UNION ALL SELECT NULL, 'broken', NULL, TRUE
        UNION ALL SELECT series_id, NULL, NULL, TRUE FROM a WHERE series_id NOT IN (SELECT series_id FROM ok)""",
)
def learner_train_all(spark, sf_dir):
    """All learners with their defaults, and one whose parameters cannot be used; a winner for each series."""
    kinds = {k: (k, {}) for k in ("gbt", "random_forest", "elastic_net")} | {"broken": ("random_forest", {"numTrees": 0})}
    result = train_learners(_prepared(spark, sf_dir), kinds)
    scored = result["metrics"].select("series_id", "model", "n", F.lit(False).alias("failed"))
    winners = result["winners"].select("series_id", F.lit("best").alias("model"), "n", F.lit(False).alias("failed"))
    broken = result["failed"].select(F.lit(None).cast("string").alias("series_id"), "model", F.lit(None).cast("bigint").alias("n"), F.lit(True).alias("failed"))
    rejected = result["rejected"].select("series_id", F.lit(None).cast("string").alias("model"), F.lit(None).cast("bigint").alias("n"), F.lit(True).alias("failed"))
    return scored.unionByName(winners).unionByName(broken).unionByName(rejected)


@query(
    "learner_backtest",
    "P10 B07",
    f"""WITH {_COMPLETE}, pn AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY date) - 1 AS pos, count(*) OVER (PARTITION BY series_id) AS size FROM cc)
        SELECT series_id, CAST((pos - 504) // 30 AS INTEGER) AS fold_id, CAST(date AS VARCHAR) AS date, value AS actual, 'elastic_net' AS model, TRUE AS predicted, CAST(0 AS BIGINT) AS failed_folds
        FROM pn WHERE pos >= 504 AND 504 + 30 * ((pos - 504) // 30) + 30 <= size""",
)
def learner_backtest(spark, sf_dir):
    """The linear learner over all folds."""
    prepared = _prepared(spark, sf_dir)
    columns = feature_columns(prepared, day_of_week_flags=False)

    def fit(train):
        return learners.Learner("elastic_net", columns).fit(train).predict

    done = run_backtest(complete_cases(prepared, [*columns, "value"]), fit, "elastic_net")
    known = F.col("prediction").isNotNull() & ~F.isnan("prediction")
    return done.predictions.select(
        "series_id", "fold_id", day(), "actual", "model", known.alias("predicted"), F.lit(done.failed.count()).cast("bigint").alias("failed_folds")
    )


_LAST = f"""{_COMPLETE}, la AS (SELECT series_id, max(date) AS last_date, arg_max(value, date) AS last_v FROM cc GROUP BY 1),
dy AS (SELECT series_id, last_date, last_v, CAST(unnest(generate_series(last_date + 1, last_date + 64, INTERVAL 1 DAY)) AS DATE) AS date FROM la),
bd AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY date) AS step FROM dy WHERE isodow(date) < 6)"""


@query(
    "learner_forecast_recursive",
    "I01 I05 I06",
    f"""WITH {_LAST} SELECT series_id, CAST(last_date AS VARCHAR) AS as_of_date, CAST(step AS INTEGER) AS horizon, CAST(date AS VARCHAR) AS target_date,
        {stable_sql('last_v')} AS last_close, TRUE AS within_reason FROM bd WHERE step IN (1, 7, 30)""",
)
def learner_forecast_recursive(spark, sf_dir):
    learner, _, columns = _fitted(spark, sf_dir, "elastic_net")
    picked, _ = predict_all(planted_ticks(spark, sf_dir), learner.model, (1, 7, 30), columns=columns)
    sane = F.col("prediction").between(500, 4000)  # the planted course runs from 1000 to 3000
    picked = picked.select("series_id", "as_of_date", "horizon", "target_date", F.round(F.col("last_close") + 3.1e-6, 4).alias("last_close"), sane.alias("within_reason"))
    return picked.withColumns({c: F.col(c).cast("string") for c in ("as_of_date", "target_date")})


@query(
    "learner_forecast_partial",
    "I02",
    f"""WITH {_LAST} SELECT series_id, CAST(step AS INTEGER) AS day_ahead, CAST(date AS VARCHAR) AS date, TRUE AS within_reason
        FROM bd WHERE step <= 30 AND series_id IN (SELECT series_id FROM ok)""",
)
def learner_forecast_partial(spark, sf_dir):
    learner, split, columns = _fitted(spark, sf_dir, "random_forest")
    state, _ = forecast.forecast_state(split, columns)
    rows = forecast.forecast_recursive(state, learner.predict, columns, 30, "partial")
    return rows.select("series_id", "day_ahead", day(), F.col("predicted_price").between(200, 10_000).alias("within_reason"))
