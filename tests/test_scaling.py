"""Plans whose tasks grow no faster than their tables."""

from __future__ import annotations

import datetime as dt
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelloom.functions import frames, lookback
from panelloom.operators import backtest, features, filters, forecast, monitoring, splits
from panelloom.operators.cleaning import align_calendar, clean
from panelloom.plans import hot_series
from panelloom.registered import REGISTERED, logs, panels

DAY = dt.date(2024, 1, 1)


def _sparse(spark):
    """Twenty series of two days each, a hundred days apart, and one without dates."""
    rows = [(f"s{i}", DAY + dt.timedelta(days=d), float(i + d), d) for i in range(20) for d in (0, 100)]
    return spark.createDataFrame([*rows, ("none", None, 1.0, 0)], "series_id string, date date, value double, ingest_seq bigint")


def test_partitions_follow_the_unfolded_days(spark, monkeypatch):
    panel = _sparse(spark).filter(F.col("date").isNotNull())
    plain = {tuple(r) for r in align_calendar(panel).collect()}
    monkeypatch.setattr(frames, "TASK_ROWS", 10)
    dealt = align_calendar(panel)
    assert dealt.rdd.getNumPartitions() == 202  # twenty series of 101 days, ten days a task
    assert {tuple(r) for r in dealt.collect()} == plain
    assert clean(_sparse(spark)).rdd.getNumPartitions() == 202


def test_prediction_log_is_dealt_by_its_rows(spark, monkeypatch, tmp_path):
    lines = [(i % 3, dt.datetime(2024, 1, 1) + dt.timedelta(days=i), float(i), i) for i in range(120)]
    schema = "l_suppkey bigint, l_shipdate timestamp, l_extendedprice double, l_orderkey bigint"
    spark.createDataFrame(lines, schema).write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(frames, "TASK_ROWS", 10)
    assert logs.prediction_log(spark, str(tmp_path)).rdd.getNumPartitions() == 36


def test_row_index_of_cut_groups_without_interpreted_steps(spark, monkeypatch):
    stored = []
    monkeypatch.setattr(hot_series, "stored", lambda df, name: stored.append(df) or df)
    rows = [("a", None if i % 50 == 0 else DAY + dt.timedelta(days=i * 7 % 90), i) for i in range(400)] + [("b", DAY, 1), ("b", DAY, 0)]
    df = spark.createDataFrame(rows, "series_id string, date date, ingest_seq bigint")
    numbered = hot_series.with_row_index(df, ["series_id"], ["date", "ingest_seq"], block_rows=16)
    assert len(stored) == 1
    assert "lambdafunction" not in numbered._jdf.queryExecution().optimizedPlan().toString()
    found = {(r["series_id"], r["ingest_seq"]): r["row_index"] for r in numbered.collect()}
    expected = {}
    for s in ("a", "b"):
        order = sorted((r for r in rows if r[0] == s), key=lambda r: (r[1] is not None, r[1] or DAY, r[2]))
        expected |= {(s, r[2]): i for i, r in enumerate(order)}
    assert found == expected


def test_small_groups_are_not_stored(spark, monkeypatch):
    monkeypatch.setattr(hot_series, "stored", lambda df, name: 1 / 0)
    df = spark.createDataFrame([("a", i) for i in range(5)], "series_id string, ingest_seq bigint")
    assert sorted(r["row_index"] for r in hot_series.with_row_index(df, ["series_id"], ["ingest_seq"]).collect()) == [0, 1, 2, 3, 4]


def test_write_back_query_works_out_its_actuals_once(spark, monkeypatch, tmp_path):
    lines = [(i % 3, dt.datetime(2000, 11, 1) + dt.timedelta(days=i), float(i + 1), i) for i in range(120)]
    schema = "l_suppkey bigint, l_shipdate timestamp, l_extendedprice double, l_orderkey bigint"
    spark.createDataFrame(lines, schema).write.parquet(f"{tmp_path}/lineitem.parquet")
    plans, write_back = [], monitoring.write_back

    def spied(session, path, actuals):
        plans.append(actuals._jdf.queryExecution().optimizedPlan().toString())
        return write_back(session, path, actuals)

    monkeypatch.setattr(monitoring, "write_back", spied)
    assert REGISTERED["monitor_write_back"].run(spark, str(tmp_path)).count() > 0
    assert len(plans) == 2
    assert not any("Aggregate" in p for p in plans)


def test_rolling_statistics_take_no_sliding_frames(spark):
    plan = features.generate(_sparse(spark).filter(F.col("date").isNotNull()))._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" in plan and not re.search(r"(?:avg|stddev_samp|min|max)\(\w+#\d+\) windowspecdefinition", plan)


def test_rows_before_match_frames_to_the_last_bit(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")  # frames reach over several batches
    try:
        odd = {3: None, 40: float("nan"), 90: float("inf"), 91: None, 150: None}
        rows = [(s, DAY + dt.timedelta(days=i), odd.get(i, (i * 37 % 101) / 7) if s != "c" else 0.1, i) for s in ("a", "b", "c", None) for i in range(170)]
        df = spark.createDataFrame([*rows, ("one", DAY, 1.0, 0)], "series_id string, date date, value double, ingest_seq bigint")
        expected = df.withColumns(features.rolling_features(features.by_date()))
        found = features.add_rolling(df)
        assert found.columns == expected.columns and found.dtypes == expected.dtypes

        def listed(rows):
            return sorted(([repr(x) for x in r] for r in rows.drop("date").collect()))

        assert listed(found) == listed(expected)
        late = features.add_rolling(df).filter(F.col("date") > DAY + dt.timedelta(days=100))
        assert listed(late) == listed(expected.filter(F.col("date") > DAY + dt.timedelta(days=100)))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_rows_out_of_order_fail():
    batches = [(pa.array([1, 2]), pa.array([1.0, 2.0])), (pa.array([4]), pa.array([3.0]))]
    with pytest.raises(ValueError, match="in order"):
        list(lookback._pass(iter(batches), {"x": lookback.Lookback("value", "mean", 2)}, ["value"]))


def test_shipments_are_grouped_in_tasks_dealt_by_their_lines(spark, monkeypatch, tmp_path):
    lines = [(i % 3, dt.datetime(2024, 1, 1) + dt.timedelta(days=i // 6), float(i), i) for i in range(120)]
    schema = "l_suppkey bigint, l_shipdate timestamp, l_extendedprice double, l_orderkey bigint"
    spark.createDataFrame(lines, schema).write.parquet(f"{tmp_path}/lineitem.parquet")
    plain = {tuple(r) for r in panels.daily_shipments(spark, str(tmp_path)).collect()}
    monkeypatch.setattr(frames, "TASK_ROWS", 10)
    dealt = panels.daily_shipments(spark, str(tmp_path))
    assert {tuple(r) for r in dealt.collect()} == plain and len(plain) == 60
    plan = dealt._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 2  # the final plan and the first one hold one each
    assert dealt.rdd.getNumPartitions() == 12


@pytest.mark.parametrize("name", ["feature_range", "feature_returns", "feature_volatility", "target_log_return"])
def test_supplier_queries_deal_lines_and_days_by_their_numbers(spark, monkeypatch, tmp_path, name):
    lines = [(i % 3, dt.datetime(2024, 1, 1) + dt.timedelta(days=i // 6), float(i * 37 % 101 + 1), i) for i in range(120)]
    schema = "l_suppkey bigint, l_shipdate timestamp, l_extendedprice double, l_orderkey bigint"
    spark.createDataFrame(lines, schema).write.parquet(f"{tmp_path}/lineitem.parquet")
    plain = {tuple(r) for r in REGISTERED[name].run(spark, str(tmp_path)).collect()}
    monkeypatch.setattr(frames, "TASK_ROWS", 10)
    dealt = REGISTERED[name].run(spark, str(tmp_path))
    assert {tuple(r) for r in dealt.collect()} == plain and len(plain) == 60
    plan = re.sub(r"#\d+", "", dealt._jdf.queryExecution().executedPlan().toString())
    # 120 lines, then 60 days, ten a task; no shuffle of another size, which would grow with the tables
    assert set(re.findall(r"Exchange hashpartitioning\((.*?)\), (\w+)", plan)) == {("series_id, date, 12", "REPARTITION_BY_NUM"), ("series_id, 6", "REPARTITION_BY_NUM")}
    below = plan[plan.rindex("Exchange hashpartitioning") :]
    assert "Aggregate" not in below  # nothing is combined with the scan


def test_complete_cases_are_one_condition_a_column(spark):
    rows = [("a", 1.0, 1), ("b", None, 2), ("c", float("nan"), 3), ("d", 4.0, None), (None, 5.0, 5), ("f", 6.0, 6)]
    df = spark.createDataFrame(rows, "name string, x double, n int").select("name", (F.col("x") + 1).alias("y"), (F.col("n") + 1).alias("m"))
    kept = filters.complete_cases(df, ["name", "y", "m"])
    assert kept.collect() == df.dropna(subset=["name", "y", "m"]).collect() and [r["name"] for r in kept.collect()] == ["a", "f"]
    assert filters.complete_cases(df, []).count() == len(rows)
    # a condition over all columns is copied for every subset of the renamed ones
    assert "atleastnnonnulls" not in kept._jdf.queryExecution().optimizedPlan().toString().lower()


def test_best_baselines_are_predicted_from_one_panel(spark, monkeypatch, tmp_path):
    lines = [(i % 3 if i % 40 else None, dt.datetime(2024, 1, 1) + dt.timedelta(days=i // 3), float(i * i * 37 % 101 + 1), i) for i in range(360)]
    schema = "l_suppkey bigint, l_shipdate timestamp, l_extendedprice double, l_orderkey bigint"
    spark.createDataFrame(lines, schema).write.parquet(f"{tmp_path}/lineitem.parquet")
    known = []
    for task_rows, shuffles in ((100, 2), (130, 1)):  # series of less than 130 lines, some of more than 100
        monkeypatch.setattr(frames, "TASK_ROWS", task_rows)
        found = REGISTERED["predict_best_per_series"].run(spark, str(tmp_path))
        known.append(sorted(repr(tuple(r)) for r in found.collect()))
        assert len(known[-1]) == 12 and {r["series_id"] for r in found.collect()} == {None, "0", "1", "2"}
        plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")
        # winners and forecasts read the lines once each, and share the shuffles of them
        assert plan[1].count("FileScan parquet") == 2 and "ReusedExchange" in plan[0]
        assert plan[1].count("REPARTITION_BY_NUM") == 2 * shuffles
    assert known[0] == known[1]


def test_full_set_shuffles_lines_once_unless_a_series_is_large(spark, monkeypatch, tmp_path):
    lines = [(i % 3 if i % 40 else None, dt.datetime(2024, 1, 1) + dt.timedelta(days=i // 6) if i != 7 else None, float(i * 37 % 101 + 1), i) for i in range(120)]
    schema = "l_suppkey bigint, l_shipdate timestamp, l_extendedprice double, l_orderkey bigint"
    spark.createDataFrame(lines, schema).write.parquet(f"{tmp_path}/lineitem.parquet")
    run = REGISTERED["feature_full_set_wide"].run
    plain = sorted(repr(tuple(r)) for r in run(spark, str(tmp_path)).collect())
    assert len(plain) > 60
    for task_rows, keys in ((50, ["series_id"]), (20, ["series_id, date", "series_id"])):
        monkeypatch.setattr(frames, "TASK_ROWS", task_rows)
        found = run(spark, str(tmp_path))
        plan = re.sub(r"#\d+", "", found._jdf.queryExecution().executedPlan().toString())
        dealt = re.findall(r"Exchange hashpartitioning\((.*?), \d+\), (\w+)", plan)
        assert sorted(dealt) == sorted((k, "REPARTITION_BY_NUM") for k in keys)
        assert sorted(repr(tuple(r)) for r in found.collect()) == plain


def test_sliding_states_are_worked_out_for_the_needed_rows_alone(spark):
    odd = {3: None, 60: float("nan"), 61: None}
    rows = [(s, DAY + dt.timedelta(days=i), odd.get(i, (i * 37 % 101) / 7), i) for s, n in (("a", 170), ("b", 45), ("c", 1), (None, 90)) for i in range(n)]
    rows += [("undated", None, 1.0, 0), ("undated", None, 2.0, 1), ("undated", DAY, 3.0, 2)]
    df = spark.createDataFrame(rows, "series_id string, date date, value double, ingest_seq bigint")
    w = frames.by_date()
    state = ["_size", "_first", "_last", "_mean", "_season", "scale_abs", "scale_sq"]

    def listed(df):
        return sorted(repr(tuple(r)) for r in df.collect())

    split = splits.chronological_split(df)
    at_end = F.when(F.col("row_number") == F.col("train_size"), F.struct(*state))
    every = split.withColumn("_step", F.col("value") - F.lag("value").over(w)).withColumns(backtest.train_state(w))
    every = every.withColumn("_state", F.last(at_end, ignorenulls=True).over(frames.running(w))).filter("split = 'test'")
    step = F.col("row_number") - F.min("row_number").over(frames.whole(w)) + 1
    every = every.select("series_id", "date", step.alias("step"), F.col("value").alias("actual"), "_state.*")
    expected = backtest._per_model(every, backtest.BASELINES, F.col("step"), ["series_id", "date", "step", "actual", "scale_abs", "scale_sq"])
    found = backtest.forecast_split(split)
    assert listed(found.select(expected.columns)) == listed(expected)

    known = df.filter("value is not null").withColumn("_step", F.col("value") - F.lag("value").over(w))
    last = known.withColumns({**backtest.train_state(w), "_next": F.lead("date").over(w)}).filter("_next is null")
    last = backtest._per_model(last, backtest.BASELINES, F.lit(2), ["series_id", "date"])
    expected = last.select("series_id", F.col("date").alias("last_date"), "model", F.greatest("prediction", F.lit(forecast.PRICE_FLOOR)).alias("predicted_price"))
    ahead = forecast.forecast_baselines(df, 3)
    assert listed(ahead.filter("day_ahead = 2").select(expected.columns)) == listed(expected)

    for plan in (found, ahead):
        steps = [x for x in plan._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Project" not in x]
        (sliding,) = [i for i, x in enumerate(steps) if "RowFrame, -29" in x]
        assert "Filter" in steps[sliding + 1] and "Window" in steps[sliding + 2]
