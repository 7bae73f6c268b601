import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelloom.functions.history import next_features
from panelloom.operators import forecast, learners, splits
from panelloom.operators.backtest import run_backtest
from panelloom.plans.config import RunConfig
from panelloom.plans.prediction import predict_all, predict_routed
from panelloom.plans.training import POOLED_SCOPE, prepare, train_baselines, train_learners
from panelloom.sources.errors import SourceError
from panelloom.sources.registry import ModelRegistry, RunLog
from tests.conftest import days


@pytest.fixture(scope="module")
def raw(spark):
    rng = np.random.default_rng(7)
    rows = []
    for name, level in (("a", 50.0), ("b", 5000.0)):
        values = level * np.exp(np.cumsum(rng.normal(0, 0.01, 260)))
        rows += [(name, d, float(v), i) for i, (d, v) in enumerate(zip(days("2023-01-01", 260), values))]
    rows += [("tiny", d, 1.0, i) for i, d in enumerate(days("2023-01-01", 20))]
    df = spark.createDataFrame(rows, "series_id string, date string, value double, ingest_seq bigint")
    return df.withColumn("date", F.col("date").cast("date")).cache()


def test_train_save_load_predict(spark, raw, tmp_path):
    prepared = prepare(raw).cache()
    registry, runs = ModelRegistry(spark, str(tmp_path)), RunLog(spark, str(tmp_path / "runs"))
    result = train_learners(prepared, ("random_forest", "elastic_net"), {"random_forest": {"numTrees": 5, "maxDepth": 4}, "elastic_net": {"regParam": 0.001}}, registry=registry, runs=runs)
    table = {(r["series_id"], r["model"]): r for r in result["metrics"].collect()}
    assert set(table) == {(s, m) for s in ("a", "b") for m in ("random_forest", "elastic_net")}
    assert all(r["mape"] < 10 for r in table.values())
    assert [r["series_id"] for r in result["rejected"].collect()] == ["tiny"]
    assert runs.read().count() == 2
    assert registry.load("nobody") is None
    model = registry.load(POOLED_SCOPE)
    assert model is registry.load(POOLED_SCOPE)
    assert set(learners.model_columns(model)) == set(result["columns"])
    picked, lost = predict_all(raw, model, (1, 3), columns=result["columns"])
    rows = picked.collect()
    assert {(r["series_id"], r["horizon"]) for r in rows} == {(s, h) for s in ("a", "b") for h in (1, 3)}
    assert all(abs(r["predicted_change_pct"]) < 20 for r in rows)
    assert [r["series_id"] for r in lost.collect()] == ["tiny"]


def test_routes_that_repeat_or_lack_a_series(spark, panel):
    """Series by series, the rows of ``predict_all`` for the models that each is routed to, and no other."""
    points = [(d, (i * 37 % 11) + i / 10) for i, d in enumerate(days("2024-01-01", 40))]
    raw = panel({s: points for s in ("own", "two", "twice", "both", "strange", "none", "gone", None)}).filter("series_id is null or series_id <> 'gone'")
    raw = raw.unionByName(spark.createDataFrame([("lost", None, 1.0, 0)], raw.schema))
    routes = [("own", "last"), ("two", "drift"), ("two", "mean"), ("twice", "mean"), ("twice", "mean"), ("both", "naive"), ("both", "drift"), ("strange", "x"), ("gone", "mean"), (None, "drift"), ("lost", "mean")]
    winners = spark.createDataFrame(routes, "series_id string, model string")
    models = {"naive": "naive", "drift": "drift", "mean": "mean", "last": "naive"}
    picked, lost = predict_routed(raw, winners, models, (1, 3))
    expected = {"own": ["last"], "two": ["drift", "mean"], "twice": ["mean"], "both": ["drift"], "strange": ["naive"], "none": ["naive"], None: ["naive"]}
    rows = sorted(((r["series_id"] or "", r["model"], r["horizon"], r["prediction"]) for r in picked.collect()))
    plain = {m: {r["horizon"]: r["prediction"] for r in predict_all(raw.filter("series_id = 'own'"), m, (1, 3))[0].collect()} for m in set(models.values())}
    assert rows == sorted((s or "", m, h, plain[models[m]][h]) for s, names in expected.items() for m in names for h in (1, 3))
    assert picked.columns[-1] == "model"
    assert sorted(r["series_id"] or "" for r in lost.collect()) == ["", "lost"]  # as in predict_all, a missing series is never reached


def test_baseline_training(raw):
    table, rejected = train_baselines(prepare(raw), initial=200, test=20, step=20)
    assert {r["model"] for r in table.collect()} == {"naive", "seasonal_naive"}
    assert [r["series_id"] for r in rejected.collect()] == ["tiny"]


def test_forecast_state_needs_a_complete_row(raw):
    """A feature that no rule is known for is kept as it is, if the caller says how many values to keep."""
    known = raw.withColumn("f", F.when(F.col("series_id") != "tiny", 1.0))
    with pytest.raises(ValueError, match="no rule"):
        forecast.forecast_state(known, ["f"])
    state, lost = forecast.forecast_state(known, ["f"], history=5)
    assert {r["series_id"]: (len(r["history"]), r["f"]) for r in state.collect()} == {"a": (5, 1.0), "b": (5, 1.0)}
    assert [r["series_id"] for r in lost.collect()] == ["tiny"]
    rows = forecast.forecast_recursive(state, lambda df: df.withColumn("prediction", F.col("f") * 7), ["f"], 3, "partial", history=5)
    assert {r["predicted_price"] for r in rows.collect()} == {7.0}


def test_forecast_history_keeps_missing_values_in_their_places(panel):
    df = panel({"a": [("2024-01-01", 1), ("2024-01-02", 2), ("2024-01-03", None), ("2024-01-04", 4), ("2024-01-05", None)]})
    state, _ = forecast.forecast_state(df.withColumn("lag_2", F.coalesce(F.col("value"), F.lit(9.0))), ["lag_2"])
    row = state.first()
    assert row["history"] == [1.0, 2.0, None, 4.0] and str(row["last_date"]) == "2024-01-04"
    means = state.select(*next_features(F.col("history"), F.col("last_date"), ["lag_2", "rolling_mean_3", "rolling_min_3"]).values()).first()
    assert list(means) == [None, 3.0, 2.0]


def test_a_failing_learner_is_a_row_and_the_best_of_each_series_wins(raw, tmp_path):
    import duckdb

    registry = ModelRegistry(raw.sparkSession, str(tmp_path / "registry"))
    kinds = {"forest": ("random_forest", {"numTrees": 3, "maxDepth": 3}), "linear": ("elastic_net", {}), "none": ("svr", {}), "bad": ("random_forest", {"numTrees": 0})}
    result = train_learners(prepare(raw), kinds, registry=registry)
    assert {r["model"] for r in result["failed"].collect()} == {"none", "bad"}
    result["metrics"].write.parquet(str(tmp_path / "metrics"))
    want = duckdb.sql(f"SELECT series_id, arg_min(model, (mae, model)) FROM '{tmp_path}/metrics/*.parquet' GROUP BY 1").fetchall()
    assert sorted((r["series_id"], r["model"]) for r in result["winners"].collect()) == sorted(want)
    assert sorted((r["series_id"], r["model"]) for r in registry.winners().collect()) == sorted(want)
    models = {name: learner.model for name, learner in result["learners"].items()} | {"drift": "drift"}
    winners = raw.sparkSession.createDataFrame([("a", "forest"), ("b", "drift"), ("other", "linear")], "series_id string, model string")
    rows, lost = predict_routed(raw, winners, models, (1, 3), columns=result["columns"])
    assert {(r["series_id"], r["model"], r["horizon"]) for r in rows.collect()} == {(s, m, h) for s, m in (("a", "forest"), ("b", "drift"), ("tiny", "naive")) for h in (1, 3)}
    assert lost.count() == 0
    none = train_learners(prepare(raw), {"bad": ("random_forest", {"numTrees": 0})})
    assert none["best"] is None and none["metrics"].count() == none["winners"].count() == 0


def test_folds_of_a_fitted_backtest(raw):
    def fit(train):
        sizes = {r["series_id"]: r["n"] for r in train.groupBy("series_id").agg(F.count(F.lit(1)).alias("n")).collect()}
        seen.append(sizes)
        if sizes["a"] == 130:
            raise ValueError("this fold cannot be fitted")
        return lambda df: df.withColumn("prediction", F.col("value") * 0 + sizes["a"])

    for method, sizes in (("walk_forward", {100, 130, 160, 190, 220}), ("rolling", {100})):
        seen = []
        done = run_backtest(raw, fit, "m", initial=100, test=30, step=30, method=method)
        assert done.n_folds == 5 and {s["a"] for s in seen} == sizes and not any("tiny" in s for s in seen)
        rows = done.predictions.collect()
        if method == "walk_forward":
            assert [(r["fold_id"], r["model"]) for r in done.failed.collect()] == [(1, "m")]
            assert {r["fold_id"]: r["prediction"] for r in rows} == {k: 100.0 + 30 * k for k in (0, 2, 3, 4)}
        assert len(rows) == 2 * 30 * (5 - done.failed.count()) and len({(r["series_id"], r["date"]) for r in rows}) == len(rows)
    assert run_backtest(raw, fit, "m", initial=500, test=30, step=30).predictions.count() == 0

    def broken(train):
        raise RuntimeError("the cluster is gone")

    with pytest.raises(RuntimeError):
        run_backtest(raw, broken, "m", initial=100, test=30, step=30)


def test_folds_match_the_listed_ones(raw):
    shape = {"initial": 90, "test": 40, "step": 25}
    placed = splits.with_positions(raw, **shape).cache()
    for method in splits.FOLD_METHODS:
        listed = splits.assign_folds(raw, **shape, method=method)
        for fold_id in range(6):
            for role in ("train", "test"):
                own = {(r["series_id"], r["date"]) for r in placed.filter(splits.in_fold(fold_id, role, **shape, method=method)).collect()}
                want = {(r["series_id"], r["date"]) for r in listed.filter((F.col("fold_id") == fold_id) & (F.col("role") == role)).collect()}
                assert own == want, (method, fold_id, role)


def test_intervals_from_the_errors_of_each_series(spark):
    errors = spark.createDataFrame([("a", "m", 1.0, 2.0), ("a", "m", 1.0, 4.0), ("b", "m", 5.0, 5.0)], "series_id string, model string, actual double, prediction double")
    rows = spark.createDataFrame([(s, "m", 4, 100.0, 100.0) for s in "abc"], "series_id string, model string, day_ahead int, last_price double, predicted_price double")
    spreads = forecast.residual_deviation(errors)
    found = {r["series_id"]: r["ci_upper"] - r["predicted_price"] for r in forecast.add_interval(rows, spreads, z=1.0).collect()}
    assert found == pytest.approx({"a": 2 * 2**0.5, "b": 4.0, "c": 4.0})  # one error, or none: two percent of the price


def test_run_settings_from_a_file(tmp_path):
    document = {
        "forecast": {"target": "log_close", "horizons": [1, 5]},
        "features": {"lag_days": [1, 2], "calendar_features": False},
        "train_test_split": {"train_ratio": 0.7, "gap_days": 3, "method": "chronological"},
        "backtesting": {"initial_train_days": 252, "method": "rolling"},
        "models": {
            "naive": {"enabled": True}, "seasonal_naive": {"enabled": False}, "arima": {"enabled": True}, "svr": {"enabled": False},
            "catboost": {"enabled": True, "params": {"iterations": 50, "depth": 4, "colsample_bytree": 0.8, "l2_leaf_reg": 3}},
            "elasticnet": {"params": {"alpha": 0.5}}, "transformer": {"patchtst": {"enabled": True}, "dlinear": {"enabled": False}},
        },
        "evaluation": {"primary_metric": "mase"},
        "future_forecast": {"n_days": 10, "confidence_level": 0.8},
    }
    (tmp_path / "run.json").write_text(json.dumps(document))
    config = RunConfig.read(tmp_path / "run.json")
    assert (config.target, config.horizons, config.features) == ("log", (1, 5), {"lags": [1, 2], "calendar": False})
    assert (config.split, config.backtest) == ({"train_ratio": 0.7, "gap": 3}, {"initial": 252, "method": "rolling"})
    assert config.learners == {"catboost": ("gbt", {"maxIter": 50, "maxDepth": 4, "featureSubsetStrategy": "0.8"}), "elasticnet": ("elastic_net", {"regParam": 0.5})}
    assert config.baselines == ("naive",) and config.unsupported == ("arima", "transformer.patchtst") and config.ignored == ("catboost.l2_leaf_reg",)
    assert (config.primary_metric, config.n_days, round(config.z, 4)) == ("mase", 10, 1.2816)
    assert RunConfig.of({}) == RunConfig()
    with pytest.raises(SourceError):
        RunConfig.of({"evaluation": {"primary_metric": "r2"}})


def test_the_linear_penalty_is_in_units_of_the_value(spark):
    """Values a thousand times as large with a penalty a thousand times as large give the same model."""
    rng = np.random.default_rng(1)
    noise = rng.normal(0, 0.1, 200).tolist()
    fits = []
    for scale in (1.0, 1000.0):
        rows = [("a", scale * (2 + n), scale * (2 + n / 2), i) for i, n in enumerate(noise)]
        df = spark.createDataFrame(rows, "series_id string, value double, lag_1 double, day_of_week int")
        learner = learners.Learner("elastic_net", ["lag_1", "day_of_week"], {"regParam": 0.001 * scale}).fit(df)
        fits.append([r["prediction"] / scale for r in learner.predict(df).orderBy("day_of_week").collect()])
    assert fits[0] == pytest.approx(fits[1], rel=1e-4)
    with pytest.raises(ValueError, match="no training row"):
        learners.Learner("elastic_net", ["lag_1"]).fit(df.limit(0))


def test_sampled_parameters_are_distinct_and_repeatable():
    drawn = learners.sample_params(learners.SEARCH["gbt"])
    assert len({tuple(sorted(d.items())) for d in drawn}) == 10
    assert drawn == learners.sample_params(learners.SEARCH["gbt"])
    assert len(learners.sample_params({"maxDepth": [1, 2]}, 10)) == 2


def test_bad_arguments(raw):
    with pytest.raises(ValueError):
        learners.Learner("svr", ["lag_1"])
    with pytest.raises(ValueError):
        learners.Learner("gbt", ["lag_2"])
    with pytest.raises(ValueError):
        forecast.pick_horizons(raw, [0])
