"""Window operators against pandas, and features from arrays against features from windows."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelloom.functions.history import needed_history, next_features
from panelloom.operators import backtest, drift, features, metrics, monitoring, sequences, splits, targets
from panelloom.operators.quantiles import exact_quantiles
from panelloom.plans import hot_series
from panelloom.plans.hot_series import with_row_index
from tests.conftest import days


def series(n, seed=1, gaps=0.0):
    rng = np.random.default_rng(seed)
    values = np.round(100 + np.cumsum(rng.normal(0, 1, n)), 2)
    return [None if rng.random() < gaps else float(v) for v in values]


def frame(df):
    return df.orderBy("series_id", "date").toPandas()


@pytest.mark.parametrize("gaps", [0.0, 0.3])
def test_features_match_pandas(panel, gaps):
    n = 1300  # more than two blocks of the weighted deviation
    values = series(n, gaps=gaps)
    got = frame(features.generate(panel({"a": list(zip(days("2020-01-01", n), values))})))
    s = pd.Series(values, dtype=float)
    r = s.pct_change(fill_method=None)
    sign = np.sign(r)
    run = (sign.groupby((sign != sign.shift()).cumsum()).cumcount() + 1) * sign
    expected = {
        "lag_30": s.shift(30),
        "rolling_mean_60": s.shift(1).rolling(60, min_periods=1).mean(),
        "rolling_std_7": s.shift(1).rolling(7, min_periods=2).std(),
        "rolling_min_14": s.shift(1).rolling(14, min_periods=1).min(),
        "rolling_max_30": s.shift(1).rolling(30, min_periods=1).max(),
        "volatility_14": r.shift(1).rolling(14, min_periods=2).std(),
        "volatility_ewm_14": r.shift(1).ewm(span=14, min_periods=7).std(),
        "return_5d_lag1": s.pct_change(5, fill_method=None).shift(1),
        "momentum_20d": np.sign(s.pct_change(20, fill_method=None).shift(1)),
        "consecutive_direction": run,
    }
    for name, want in expected.items():
        np.testing.assert_allclose(got[name].astype(float), want, rtol=1e-8, atol=1e-10, err_msg=name)
    assert len(got.columns) == 4 + 52 + 1


def test_array_features_match_window_features(spark, panel):
    values = series(240)
    df = panel({"a": list(zip(days("2023-01-01", 240), values))})
    names = [n for n in features.generate(df).columns if n not in ("series_id", "date", "value", "ingest_seq", *features.RETURN_DAYS)]
    names = [n for n in names if n not in ("return_1d", "return_5d", "return_20d", "consecutive_direction")]
    last = frame(features.generate(df)).iloc[-1]
    state = spark.createDataFrame([(values[:-1], last["date"])], "history array<double>, date date")
    built = state.select(*[c.cast("double").alias(n) for n, c in next_features(F.col("history"), F.col("date"), names).items()]).first()
    for name in names:
        assert built[name] == pytest.approx(float(last[name]), rel=1e-9, abs=1e-12), name


def test_zero_return_and_zero_price(panel):
    got = frame(features.add_direction_run(panel({"a": list(zip(days("2024-01-01", 6), [1, 2, 2, 0, 5, 6]))}).withColumns(features.return_features(features.by_date()))))
    assert [None if pd.isna(v) else v for v in got["consecutive_direction"]] == [None, 1, 0, -1, None, 1]


def test_inverse_of_transform_is_identity(panel):
    df = panel({"a": list(zip(days("2024-01-01", 60), series(60)))})
    for method in targets.METHODS:
        first = df.orderBy("date").first()["value"]
        with_target = targets.add_target(df, method, clip_at=None).filter(F.col("target").isNotNull()).withColumn("reference_price", F.lit(first))
        got = frame(targets.invert_path(with_target, method))
        np.testing.assert_allclose(got["price"], got["value"], rtol=1e-10)
    with pytest.raises(ValueError):
        targets.add_target(df, "log_close")


def test_clip_and_pad(panel):
    df = panel({"a": list(zip(days("2024-01-01", 4), [1, None, 3, 3.3]))})
    assert [None if pd.isna(v) else round(v, 6) for v in frame(targets.add_target(df, "return"))["target"]] == [None, None, None, 0.1]
    assert [None if pd.isna(v) else round(v, 6) for v in frame(targets.add_target(df, "return", pad=True))["target"]] == [None, 0, 0.5, 0.1]


def test_splits_are_disjoint_and_counted(panel):
    df = panel({"long": list(zip(days("2024-01-01", 200), range(200))), "short": list(zip(days("2024-01-01", 40), range(40)))})
    counts = {(r["series_id"], r["split"]): r["count"] for r in splits.chronological_split(df, gap=5).groupBy("series_id", "split").count().collect()}
    assert counts[("long", "train")] == 160 and counts[("long", "gap")] == 5 and counts[("long", "test")] == 35
    assert counts[("short", "train")] == 30 and counts[("short", "test")] == 5
    with pytest.raises(ValueError):
        splits.chronological_split(df, train_ratio=0.99)


@pytest.mark.parametrize("n, expected", [(59, 0), (60, 1), (69, 1), (70, 2), (100, 5)])
def test_fold_count(panel, n, expected):
    df = panel({"a": list(zip(days("2024-01-01", n), range(n)))})
    assert splits.folds(df, 50, 10, 10).count() == expected
    rows = splits.assign_folds(df, 50, 10, 10)
    assert rows.filter("role = 'test'").count() == expected * 10
    assert rows.filter("role = 'train'").count() == sum(50 + 10 * f for f in range(expected))
    assert backtest.backtest_predictions(df, ("naive",), 50, 10, 10).count() == expected * 10


def test_constant_series_has_no_scaled_error(panel):
    df = panel({"a": list(zip(days("2024-01-01", 100), [5] * 100))})
    row = metrics.score(backtest.forecast_split(splits.chronological_split(df), ("naive",)), ("series_id", "model")).first()
    assert row["mae"] == 0 and row["mase"] is None and row["direction_accuracy"] == 100


def test_incomplete_rows_are_dropped_and_counted(spark):
    df = spark.createDataFrame([("a", i, 1.0, p, 1.0, 1.0) for i, p in enumerate([1.0, None, 2.0])], "series_id string, date int, actual double, prediction double, scale_abs double, scale_sq double")
    row = metrics.score(df, ("series_id",)).first()
    assert (row["n"], row["n_dropped"], row["mae"]) == (2, 1, 0.5)


def test_windows_never_cross_the_cut(panel):
    df = panel({"a": list(zip(days("2024-01-01", 50), range(50)))})
    samples = sequences.split_windows(df.withColumn("f", F.col("value")), ["f"], length=5, horizon=2, train_ratio=0.8)
    got = samples.select("split", F.get(F.get("x", F.lit(0)), F.lit(0)).alias("first"), F.element_at("y", -1).alias("last")).toPandas()
    assert got[got["split"] == "train"]["last"].max() == 39 and got[got["split"] == "validation"]["first"].min() == 40
    assert (got["split"] == "train").sum() == 40 - 7 + 1


def test_context_cut_leaves_out_the_exact_fit(panel):
    exact = panel({"a": list(zip(days("2024-01-01", 20), range(20)))})
    longer = panel({"a": list(zip(days("2024-01-01", 21), range(21)))})
    assert sequences.context_target_samples(exact, 15, 5).count() == 0
    assert sequences.context_target_samples(longer, 15, 5).count() == 1


def test_drift_edges(panel):
    same = panel({"a": list(zip(days("2024-01-01", 90), [i % 30 for i in range(90)])), "short": list(zip(days("2024-01-01", 89), range(89)))})
    found = {r["series_id"]: r for r in drift.detect_drift(same).collect()}
    assert found["a"]["psi"] == pytest.approx(0, abs=1e-9) and found["a"]["ks_pvalue"] == pytest.approx(1.0)
    assert found["short"]["error"] and found["short"]["drift_detected"] is None
    flat = panel({"a": list(zip(days("2024-01-01", 90), [1] * 60 + [2] * 30))})
    row = drift.detect_drift(flat).first()
    assert row["drift_detected"] and row["ks_statistic"] == 1.0 and row["ks_pvalue"] < 1e-20


def test_ks_pvalues_against_enumeration():
    from itertools import combinations

    n, m = 4, 3
    counts = {}
    for chosen in combinations(range(n + m), n):
        i = j = gap = 0
        for k in range(n + m):
            i, j = (i + 1, j) if k in chosen else (i, j + 1)
            gap = max(gap, abs(i * 3 - j * 4))
        counts[gap] = counts.get(gap, 0) + 1
    total = sum(counts.values())
    for gap, p in enumerate(drift.ks_pvalues(np.arange(math.lcm(n, m) + 1), n, m)):
        assert p == pytest.approx(sum(c for g, c in counts.items() if g >= gap) / total)


@pytest.mark.parametrize("buckets", [2, 7, 256])
def test_exact_quantiles(spark, buckets):
    rng = np.random.default_rng(3)
    values = {"a": np.round(rng.normal(0, 1, 997), 2), "hot": np.array([5.0] * 400 + list(rng.exponential(2, 211))), "one": np.array([3.0])}
    df = spark.createDataFrame([(k, float(v)) for k, vs in values.items() for v in vs] + [("a", None)], "k string, v double")
    probabilities = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    for row in exact_quantiles(df, ["k"], "v", probabilities, buckets).collect():
        np.testing.assert_allclose(row["quantiles"], np.quantile(values[row["k"]], probabilities))
        assert row["n"] == len(values[row["k"]])


@pytest.mark.parametrize("block_rows", [5, 40, 1000])
def test_row_index_of_a_hot_series_with_times_of_day(spark, monkeypatch, block_rows):
    """A series with a third of all rows, a stamp of its own for most of them, some equal and some missing."""
    monkeypatch.setattr(hot_series, "EDGES", 8)
    rng = np.random.default_rng(6)
    stamps = [None if i % 50 == 0 else f"2024-01-01 {rng.integers(0, 24):02d}:{rng.integers(0, 60):02d}:{rng.integers(0, 60):02d}" for i in range(900)]
    rows = [("hot" if i % 3 == 0 else f"s{i % 31}", s, i) for i, s in enumerate(stamps)]
    df = spark.createDataFrame(rows, "series_id string, timestamp string, seq bigint")
    got = with_row_index(df, ["series_id"], ["timestamp", "seq"], block_rows=block_rows).toPandas()
    assert len(got) == len(rows)
    for name, part in got.groupby("series_id"):
        want = sorted((r for r in rows if r[0] == name), key=lambda r: (r[1] is not None, r[1] or "", r[2]))
        assert list(part.sort_values("row_index")["seq"]) == [r[2] for r in want]
        assert sorted(part["row_index"]) == list(range(len(want)))


def test_edges_cut_a_hot_series_evenly(spark):
    df = spark.range(20_000).select(F.lit("hot").alias("series_id"), F.col("id").alias("seq"))
    tagged, large = hot_series._cut(df, ["series_id"], ["seq"], 1000, "_piece")
    sizes = [r["count"] for r in tagged.groupBy("_piece").count().collect()]
    assert large and len(sizes) == 20 and max(sizes) < 3000


def log(spark, errors):
    rows = [("a", f"2024-{i:05d}", 1, 0.0, float(e), float(e), i) for i, e in enumerate(errors)]
    return spark.createDataFrame(rows, "series_id string, timestamp string, horizon int, prediction double, actual double, error double, record_seq bigint")


def test_alerts_and_degradation(spark):
    assert monitoring.check_alerts(log(spark, [1] * 30 + [2] * 30)).first()["degradation"] == 1.0
    assert monitoring.check_alerts(log(spark, [1] * 59)).count() == 0
    assert monitoring.check_alerts(log(spark, [1] * 30 + [1.2] * 30)).count() == 0
    assert monitoring.degradation(log(spark, [1] * 60 + [3] * 30), "error").first()["degraded"]
    assert not monitoring.degradation(log(spark, [1] * 59), "error").first()["degraded"]


def test_prediction_log_round_trip(spark, tmp_path):
    path = str(tmp_path / "log")
    assert monitoring.read_log(spark, path, monitoring.PREDICTION_LOG).count() == 0
    monitoring.record_predictions(log(spark, [1, 2]).withColumn("actual", F.when(F.col("record_seq") == 0, F.col("actual"))), path)
    stored = monitoring.read_log(spark, path, monitoring.PREDICTION_LOG)
    assert sorted((r["record_seq"], r["error"]) for r in stored.collect()) == [(0, 1.0), (1, None)]
    actuals = spark.createDataFrame([("a", "2024-00001", 9.0, 0), ("a", "2024-00001", 5.0, 1)], "series_id string, timestamp string, actual double, arrival int")
    updated = monitoring.update_actuals(stored, actuals)
    assert sorted((r["record_seq"], r["error"], r["updated"]) for r in updated.collect()) == [(0, 1.0, False), (1, 5.0, True)]


def test_training_log(spark, tmp_path):
    path = str(tmp_path / "trained")
    one = spark.sql("SELECT 'a' AS series_id, TIMESTAMP '2024-01-01 00:00:00' AS trained_at")
    monitoring.record_training(one, path)
    series_table = spark.createDataFrame([("a",), ("b",)], "series_id string")
    got = monitoring.should_retrain(series_table, monitoring.read_log(spark, path), F.lit("2024-01-31 12:00:00").cast("timestamp"))
    assert {r["series_id"]: r["reason"] for r in got.collect()} == {
        "a": "Scheduled retrain (30 days since last)",
        "b": "No training record found",
    }


def test_metric_log_round_trip(spark, tmp_path):
    path = str(tmp_path / "metrics")
    first = spark.createDataFrame([("a", "2024-01-01", 1, 2.0, 0)], "series_id string, timestamp string, horizon int, mae double, record_seq bigint")
    monitoring.record_metrics(first, path)
    monitoring.record_metrics(first.withColumns({"mae": F.lit(4.0), "timestamp": F.lit("2024-01-02"), "record_seq": F.lit(1).cast("bigint")}), path)
    rolled = monitoring.rolling_metric(monitoring.read_log(spark, path))
    assert sorted(r["rolling_mae"] for r in rolled.collect()) == [2.0, 3.0]


def test_history_follows_the_features(spark):
    assert needed_history(["lag_300", "rolling_mean_365", "day_of_week"]) == 367
    assert needed_history(["return_5d_lag1", "volatility_21"]) == 23
    assert needed_history(["lag_1", "volatility_ewm_14"]) is None
    with pytest.raises(ValueError):
        needed_history(["mystery"])


def test_write_back_replaces_the_months_it_changes_and_survives_a_crash(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "log")
    rows = [("a", f"2024-0{m}-01", h, 1.0, None, None, 10 * m + h) for m in (1, 2, 3) for h in (1, 7)] + [("a", "2024-01-02", 1, 1.0, 9.0, 8.0, 99)]
    log = spark.createDataFrame(rows, monitoring.PREDICTION_LOG)
    monitoring.record_predictions(log, path)
    actuals = spark.createDataFrame([("a", "2024-01-01", 3.0, 0), ("a", "2024-01-01", 4.0, 1), ("a", "2024-01-02", 5.0, 0), ("b", "2024-03-01", 6.0, 0)], "series_id string, timestamp string, actual double, arrival int")
    untouched = {f.name: f.stat().st_mtime_ns for f in (tmp_path / "log" / "log_month=2024-02").iterdir()}
    # the run dies after its rows are stored and before they are in place
    with monkeypatch.context() as crash:
        crash.setattr(monitoring, "_put_in_place", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            monitoring.write_back(spark, path, actuals)
    assert monitoring.read_log(spark, path).filter("actual is null").count() == 6
    assert monitoring.write_back(spark, path, actuals) == 0  # finishes what was stored; nothing is left to fill
    stored = {(r["timestamp"], r["horizon"]): (r["actual"], r["error"]) for r in monitoring.read_log(spark, path).collect()}
    assert len(stored) == 7 and stored[("2024-01-01", 1)] == stored[("2024-01-01", 7)] == (4.0, 3.0) and stored[("2024-01-02", 1)] == (9.0, 8.0)
    assert stored[("2024-03-01", 1)] == (None, None)
    assert untouched == {f.name: f.stat().st_mtime_ns for f in (tmp_path / "log" / "log_month=2024-02").iterdir()}
    more = spark.createDataFrame([("a", "2024-03-01", 2.5, 0)], actuals.schema)
    assert monitoring.write_back(spark, path, more) == 2 and monitoring.write_back(spark, path, more) == 0
