"""Time the headline queries and print one JSON line.

Reads ``BENCH_SF_DIR`` (default /root/testdata/sf0.1) and ``BENCH_CPUS`` (default all cores).
"""

from __future__ import annotations

import json
import os
import time

from panelloom.registered import REGISTERED
from panelloom.session import get_spark

HEADLINE = (
    "clean_dedupe_keep_last",
    "clean_flag_outliers",
    "quality_report",
    "quality_outlier_rows",
    "target_statistics",
    "feature_rolling",
    "feature_ewm_volatility_gaps",
    "feature_full_set",
    "feature_full_set_wide",
    "sequence_windows",
    "split_summary",
    "baseline_scores_per_series",
    "metric_bundle",
    "metric_error_quartiles",
    "metric_rolling_log",
    "backtest_compare_models",
    "drift_verdict",
    "monitor_performance_summary",
    "forecast_baselines",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    shuffle = str(max(8, int(cpus)))
    spark = get_spark(
        "bench",
        f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": shuffle, "spark.ui.enabled": "false", "spark.driver.memory": "12g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("o_orderpriority").count().collect()  # start-up is not measured
    timings = {}
    for name in HEADLINE:
        start = time.perf_counter()
        REGISTERED[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - start, 3)
    total = round(sum(timings.values()), 3)
    scale = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": timings, "sf": float(scale)}))
    spark.stop()


if __name__ == "__main__":
    main()
