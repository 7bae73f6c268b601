"""The physical plans keep their shape: few shuffles, pruned scans, early limits, no hot task."""

import re

import pytest
from pyspark.sql import functions as F

from panelloom.operators import backtest, cleaning, drift, features, filters, metrics, monitoring, quality, quantiles, splits

COLUMNS = "series_id string, date date, value double, ingest_seq bigint"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return len(re.findall(r"Exchange hashpartitioning", plan_of(df)))


@pytest.fixture
def stored(spark, tmp_path):
    rows = spark.range(2000).select(
        F.concat(F.lit("s"), F.col("id") % 4).alias("series_id"),
        F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") / 4).cast("int")).alias("date"),
        F.rand(1).alias("value"),
        F.col("id").alias("ingest_seq"),
        F.lit("unused").alias("note"),
    )
    rows.write.parquet(str(tmp_path / "ticks"))
    return spark.read.parquet(str(tmp_path / "ticks"))


def test_clean_features_split_and_scores_take_two_shuffles(stored):
    prepared = features.generate(cleaning.clean(stored))
    assert exchanges(prepared) == 2  # by day for the dedupe, by series for everything else
    split = splits.chronological_split(filters.complete_cases(prepared, ["lag_30", "value"]))
    assert exchanges(metrics.score(backtest.forecast_split(split), ("series_id", "model"))) == 2


def test_backtest_takes_one_shuffle(stored):
    results = backtest.compare_models(stored.select("series_id", "date", "value"), initial=100, test=30, step=30)
    assert exchanges(results) == 1


def test_scan_is_pruned_and_filtered(stored):
    plan = plan_of(cleaning.clean(filters.date_range(stored, "2020-02-01", "2020-12-31")))
    assert "note" not in plan.split("ReadSchema")[1]
    assert "GreaterThanOrEqual(date,2020-02-01)" in plan and "LessThanOrEqual(date,2020-12-31)" in plan


@pytest.mark.parametrize(
    "build",
    [
        lambda df: filters.tail(df, 10),
        lambda df: monitoring.check_alerts(df.withColumns({"error": F.col("value"), "actual": F.col("value"), "record_seq": F.col("ingest_seq")})),
        lambda df: monitoring.degradation(df.withColumns({"timestamp": F.col("date"), "record_seq": F.col("ingest_seq")}), "value"),
    ],
)
def test_recent_rows_are_limited_before_the_shuffle(stored, build):
    plan = plan_of(build(stored))
    assert plan.count("WindowGroupLimit") >= 2
    assert re.search(r"WindowGroupLimit.*Final.*Exchange hashpartitioning.*WindowGroupLimit.*Partial", plan, re.S)


def test_raw_tick_windows_are_not_partitioned_by_series_alone(stored):
    plan = plan_of(quality.outlier_rows(stored, block_rows=100))
    for window in re.findall(r"Window \[(?:avg|count|stddev|row_number|lag)\(.*", plan):
        assert "chunk" in window or "_block" in window, window[:200]


def test_offsets_of_a_hot_series_are_summed_in_two_levels(stored):
    log = stored.withColumns({"timestamp": F.col("date").cast("string"), "record_seq": F.col("ingest_seq"), "mae": F.col("value")})
    plan = plan_of(monitoring.rolling_metric(log, block_rows=50))
    sums = [w for w in re.findall(r"Window \[.*", plan) if re.match(r"Window \[(?:coalesce\()?sum\(", w)]
    keys = [re.search(r", \[([^\[\]]*)\], \[[^\[\]]*\]$", w)[1] for w in sums]
    assert len(keys) == 2 and any("_piece" in k for k in keys)
    # a small log is numbered by series, without a table of offsets
    assert not re.search(r"Window \[(?:coalesce\()?sum\(", plan_of(monitoring.rolling_metric(log)))


def scans(df):
    return len(re.findall(r"FileScan parquet", plan_of(df)))


def test_quality_report_reads_its_table_four_times(stored):
    raw = stored.withColumn("value_text", F.col("value").cast("string"))
    report = quality.validate(raw)
    assert scans(report) <= 4
    catalog = raw.sparkSession.createDataFrame([("s0",)], "series_id string")
    assert scans(quality.validity_table(raw, catalog)) <= 4
    assert len(re.findall(r"Exchange hashpartitioning", plan_of(report))) <= 8


def test_quantiles_shuffle_counts_and_few_values(stored):
    plan = plan_of(quantiles.exact_quantiles(stored, ["series_id"], "value", [0.25, 0.5]))
    # what is left after the checkpointed edges and wanted buckets: one shuffle of merged values, filtered before
    first = plan.split("Exchange hashpartitioning")[-1]
    assert "LeftSemi" in first and "partial_count" in plan


def test_a_fold_reads_its_blocks_alone(spark, stored, tmp_path):
    placed = splits.with_positions(stored.select("series_id", "date", "value"), 100, 30, 30)
    placed.write.partitionBy("fold_block").parquet(str(tmp_path / "folds"))
    rows = spark.read.parquet(str(tmp_path / "folds"))
    plan = plan_of(rows.filter(splits.in_fold(3, "test", 100, 30, 30)))
    assert re.search(r"PartitionFilters: \[.*fold_block#\d+ >= 4.*fold_block#\d+ <= 4", plan)
    assert "Generate" not in plan_of(placed)


def test_drift_reads_its_table_once(stored):
    verdicts = drift.detect_drift(stored)
    assert scans(verdicts) == 1
    trained = stored.select("series_id", F.col("date").cast("timestamp").alias("trained_at"))
    assert scans(monitoring.should_retrain(verdicts, trained, F.current_timestamp())) == 2
