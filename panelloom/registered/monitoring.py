"""Drift, alerts and retraining."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelloom.operators import drift, monitoring, splits
from panelloom.operators.backtest import forecast_split
from panelloom.operators.metrics import score
from panelloom.registered.catalog import query, rounded, rounded_sql
from panelloom.registered.logs import LOG, prediction_log
from panelloom.registered.panels import EVENTS, SHIPMENTS, TICKS, daily_events, daily_shipments, order_ticks, table
from panelloom.registered.splits import _SPLIT_FORECAST, score_sql, split_sql
from panelloom.session import shared_path, stored

_UNION = f"{SHIPMENTS}, {EVENTS}, u AS (SELECT * FROM p2 UNION ALL SELECT * FROM p3)"


def _union(spark, sf_dir):
    return daily_shipments(spark, sf_dir).unionByName(daily_events(spark, sf_dir))


_WINDOWS = """k AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY date DESC) AS k, count(*) OVER (PARTITION BY series_id) AS n FROM u),
dw AS (SELECT series_id, value, k <= 30 AS is_cur FROM k WHERE n >= 90 AND k <= 90)"""


@query(
    "drift_windows",
    "D01",
    f"""WITH {_UNION}, {_WINDOWS}, s AS (SELECT series_id, count(*) FILTER (NOT is_cur) AS ref_rows, count(*) FILTER (is_cur) AS cur_rows,
            sum(value) FILTER (NOT is_cur) AS ref_sum, sum(value) FILTER (is_cur) AS cur_sum FROM dw GROUP BY 1)
        SELECT a.series_id, s.series_id IS NULL AS failed, CAST(ref_rows AS INTEGER) AS ref_rows, CAST(cur_rows AS INTEGER) AS cur_rows,
          {rounded_sql(['ref_sum', 'cur_sum'], 2)} FROM (SELECT DISTINCT series_id FROM u) a LEFT JOIN s ON s.series_id = a.series_id""",
)
def drift_windows(spark, sf_dir):
    windows, short = drift.drift_windows(_union(spark, sf_dir))

    def total(c):
        return F.aggregate(c, F.lit(0.0), lambda acc, v: acc + v)

    found = windows.select(
        "series_id", F.lit(False).alias("failed"), F.size("ref").alias("ref_rows"), F.size("cur").alias("cur_rows"),
        total("ref").alias("ref_sum"), total("cur").alias("cur_sum"),
    )
    lost = short.select("series_id", F.lit(True).alias("failed"))
    return rounded(found, ["ref_sum", "cur_sum"], 2).unionByName(lost, allowMissingColumns=True)


_PSI = """q AS (SELECT series_id, quantile_cont(value, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS edges FROM dw WHERE NOT is_cur GROUP BY 1),
bn AS (SELECT dw.series_id, is_cur, len(list_filter(edges, lambda e: e <= value)) AS bin, count(*) AS c FROM dw JOIN q ON q.series_id = dw.series_id GROUP BY 1, 2, 3),
gr AS (SELECT q.series_id, b, coalesce(max(c) FILTER (NOT is_cur AND bin = b), 0) + 1e-8 AS r, coalesce(max(c) FILTER (is_cur AND bin = b), 0) + 1e-8 AS c
  FROM q CROSS JOIN generate_series(0, 9) g(b) LEFT JOIN bn ON bn.series_id = q.series_id AND bn.bin = b GROUP BY 1, 2),
sh AS (SELECT series_id, r / sum(r) OVER (PARTITION BY series_id) AS r, c / sum(c) OVER (PARTITION BY series_id) AS c FROM gr),
ps AS (SELECT series_id, sum((c - r) * ln(c / r)) AS psi FROM sh GROUP BY 1)"""

_KS = """vc AS (SELECT series_id, value, count(*) FILTER (NOT is_cur) AS r, count(*) FILTER (is_cur) AS c FROM dw GROUP BY 1, 2),
cd AS (SELECT series_id, abs(sum(r) OVER w - 2 * sum(c) OVER w) AS gap FROM vc WINDOW w AS (PARTITION BY series_id ORDER BY value)),
kg AS (SELECT series_id, CAST(max(gap) AS INTEGER) AS gap FROM cd GROUP BY 1)"""

# share of random orders of 60 reference and 30 current values whose distribution functions stay closer than the gap
_KS_EXACT = """walk(gap, s, i, p) AS (
  SELECT CAST(g AS INTEGER), 0, 0, CAST(1.0 AS DOUBLE) FROM generate_series(1, 60) t(g)
  UNION ALL
  SELECT gap, s + 1, i + d, sum(p * CASE d WHEN 1 THEN (60 - i) / (90.0 - s) ELSE (30 - (s - i)) / (90.0 - s) END)
  FROM walk, (VALUES (0), (1)) t(d)
  WHERE s < 90 AND i + d <= 60 AND s + 1 - i - d <= 30 AND abs((i + d) - 2 * (s + 1 - i - d)) < gap
  GROUP BY gap, s, i + d)"""


@query(
    "drift_psi",
    "D02",
    f"WITH {_UNION}, {_WINDOWS}, {_PSI} SELECT series_id, {rounded_sql(['psi'])} FROM ps",
)
def drift_psi(spark, sf_dir):
    windows, _ = drift.drift_windows(_union(spark, sf_dir))
    return rounded(windows.select("series_id", drift.psi(F.col("ref"), F.col("cur")).alias("psi")), ["psi"])


@query(
    "drift_ks_statistic",
    "D03",
    f"WITH {_UNION}, {_WINDOWS}, {_KS}, s AS (SELECT series_id, gap / 60.0 AS ks_statistic FROM kg) SELECT series_id, {rounded_sql(['ks_statistic'], 8)} FROM s",
)
def drift_ks_statistic(spark, sf_dir):
    windows, _ = drift.drift_windows(_union(spark, sf_dir))
    return rounded(drift.add_drift(windows).select("series_id", "ks_statistic"), ["ks_statistic"], 8)


@query(
    "drift_ks_exact_pvalue",
    "D04",
    f"""WITH RECURSIVE {_KS_EXACT}, {_UNION}, {_WINDOWS}, {_KS},
        s AS (SELECT kg.series_id, CASE WHEN kg.gap = 0 THEN 1.0 ELSE 1 - coalesce(p, 0) END AS ks_pvalue
              FROM kg LEFT JOIN walk ON walk.gap = kg.gap AND s = 90)
        SELECT series_id, {rounded_sql(['ks_pvalue'], 8)} FROM s""",
)
def drift_ks_exact_pvalue(spark, sf_dir):
    windows, _ = drift.drift_windows(_union(spark, sf_dir))
    return rounded(drift.add_drift(windows).select("series_id", "ks_pvalue"), ["ks_pvalue"], 8)


@query(
    "drift_ks_asymptotic_pvalue",
    "D04",
    f"""WITH {_UNION}, {_WINDOWS}, {_KS}, s AS (SELECT series_id, least(greatest(2 * sum((CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END)
            * exp(-2.0 * k * k * (gap / 60.0) * (gap / 60.0) * 20)), 0), 1) AS ks_pvalue FROM kg CROSS JOIN generate_series(1, 100) g(k) GROUP BY series_id, gap)
        SELECT series_id, {rounded_sql(['ks_pvalue'], 8)} FROM s""",
)
def drift_ks_asymptotic_pvalue(spark, sf_dir):
    windows, _ = drift.drift_windows(_union(spark, sf_dir))
    return rounded(drift.add_drift(windows, method="asymptotic").select("series_id", "ks_pvalue"), ["ks_pvalue"], 8)


_DRIFT = ["psi", "ks_statistic", "ks_pvalue", "reference_mean", "current_mean", "mean_change_pct"]
_VERDICT = f"""{_UNION}, {_WINDOWS}, {_PSI}, {_KS},
mn AS (SELECT series_id, avg(value) FILTER (NOT is_cur) AS reference_mean, avg(value) FILTER (is_cur) AS current_mean FROM dw GROUP BY 1),
dr AS (SELECT kg.series_id, psi, kg.gap / 60.0 AS ks_statistic, CASE WHEN kg.gap = 0 THEN 1.0 ELSE 1 - coalesce(p, 0) END AS ks_pvalue, reference_mean, current_mean,
    (current_mean - reference_mean) / reference_mean * 100 AS mean_change_pct
  FROM kg JOIN ps ON ps.series_id = kg.series_id JOIN mn ON mn.series_id = kg.series_id LEFT JOIN walk ON walk.gap = kg.gap AND s = 90)"""


@query(
    "drift_verdict",
    "D05",
    f"""WITH RECURSIVE {_KS_EXACT}, {_VERDICT} SELECT a.series_id, psi > 0.2 OR ks_pvalue < 0.05 AS drift_detected, {rounded_sql(_DRIFT)},
          CASE WHEN dr.series_id IS NULL THEN 'Not enough data for drift detection' END AS error
        FROM (SELECT DISTINCT series_id FROM u) a LEFT JOIN dr ON dr.series_id = a.series_id""",
)
def drift_verdict(spark, sf_dir):
    return rounded(drift.detect_drift(_union(spark, sf_dir)), _DRIFT)


_OPEN = f"""{LOG}, op AS (SELECT series_id, timestamp, horizon, prediction, record_seq, CASE WHEN target_date <= DATE '1998-06-30' THEN actual END AS actual,
    CASE WHEN target_date <= DATE '1998-06-30' THEN error END AS error FROM lg),
ar AS (SELECT series_id, CAST(date AS VARCHAR) AS timestamp, value AS actual FROM p2 WHERE date <= DATE '2000-12-31'),
up AS (SELECT op.series_id, op.timestamp, horizon, prediction, record_seq, coalesce(op.actual, ar.actual) AS actual,
    op.actual IS NULL AND ar.actual IS NOT NULL AS updated,
    CASE WHEN op.actual IS NULL AND ar.actual IS NOT NULL THEN abs(prediction - ar.actual) ELSE error END AS error
  FROM op LEFT JOIN ar ON ar.series_id = op.series_id AND ar.timestamp = op.timestamp)"""


def _open_log(spark, sf_dir):
    """Actuals after mid-1998 are open; they arrive up to the end of 2000, each first with a wrong value."""
    log = prediction_log(spark, sf_dir)
    known = F.col("target_date") <= F.lit("1998-06-30").cast("date")
    log = log.withColumns({c: F.when(known, F.col(c)) for c in ("actual", "error")}).drop("target_date")
    arrived = daily_shipments(spark, sf_dir).filter(F.col("date") <= F.lit("2000-12-31").cast("date"))
    tries = F.array(*[F.struct(F.lit(i).alias("arrival"), (F.col("value") * m).alias("actual")) for i, m in ((0, 3.0), (1, 1.0))])
    return log, arrived.select("series_id", F.col("date").cast("string").alias("timestamp"), F.inline(tries))


def _updated(spark, sf_dir):
    return monitoring.update_actuals(*_open_log(spark, sf_dir))


@query(
    "monitor_update_actuals",
    "D06 D07",
    f"WITH {_OPEN} SELECT series_id, timestamp, horizon, prediction, record_seq, actual, updated, {rounded_sql(['error'])} FROM up",
)
def monitor_update_actuals(spark, sf_dir):
    return rounded(_updated(spark, sf_dir), ["error"])


@query(
    "monitor_update_count",
    "D07",
    f"WITH {_OPEN} SELECT series_id, count(*) FILTER (updated) AS n_updated, count(*) FILTER (actual IS NULL) AS n_open FROM up GROUP BY 1",
)
def monitor_update_count(spark, sf_dir):
    return _updated(spark, sf_dir).groupBy("series_id").agg(
        F.count_if("updated").alias("n_updated"), F.count_if(F.col("actual").isNull()).alias("n_open")
    )


@query(
    "monitor_write_back",
    "D06 D07 S10",
    f"""WITH {_OPEN} SELECT series_id, timestamp, horizon, prediction, record_seq, actual, {rounded_sql(['error'])},
        count(*) FILTER (updated) OVER () AS n_filled, CAST(0 AS BIGINT) AS n_again FROM up""",
)
def monitor_write_back(spark, sf_dir):
    """The log recorded, its actuals written back twice, and read again."""
    path = shared_path(spark, "prediction-log")
    log, actuals = _open_log(spark, sf_dir)
    actuals = stored(actuals, "actuals")  # both write-backs read them, the first one twice
    monitoring.record_predictions(log, path)
    filled, again = (monitoring.write_back(spark, path, actuals) for _ in range(2))
    written = monitoring.read_log(spark, path, monitoring.PREDICTION_LOG)
    return rounded(written.withColumns({"n_filled": F.lit(filled).cast("bigint"), "n_again": F.lit(again).cast("bigint")}), ["error"])


@query(
    "monitor_performance_summary",
    "D08",
    f"""WITH {_OPEN} SELECT series_id, round_even(avg(error), 4) AS error_mean, round_even(stddev_samp(error), 4) AS error_std, count(error) AS error_count,
        round_even(avg(prediction), 4) AS prediction_mean, round_even(avg(actual), 4) AS actual_mean FROM up WHERE actual IS NOT NULL GROUP BY 1""",
)
def monitor_performance_summary(spark, sf_dir):
    return monitoring.performance_summary(_updated(spark, sf_dir))


@query(
    "monitor_alerts",
    "D09",
    f"""WITH {_OPEN}, k AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY record_seq DESC) AS k, count(*) OVER (PARTITION BY series_id) AS n
            FROM up WHERE actual IS NOT NULL),
        s AS (SELECT series_id, avg(error) FILTER (k <= 30) AS recent_mae, avg(error) FILTER (k BETWEEN 31 AND 60) AS historical_mae FROM k WHERE n >= 60 GROUP BY 1),
        d AS (SELECT *, (recent_mae - historical_mae) / historical_mae AS degradation FROM s WHERE historical_mae > 0)
        SELECT series_id, 'performance_degradation' AS type, 'warning' AS severity, {rounded_sql(['recent_mae', 'historical_mae', 'degradation'])}
        FROM d WHERE degradation > 0.2""",
)
def monitor_alerts(spark, sf_dir):
    return rounded(monitoring.check_alerts(_updated(spark, sf_dir)), ["recent_mae", "historical_mae", "degradation"])


@query(
    "monitor_last_training",
    "D10",
    f"WITH {TICKS} SELECT series_id, CAST(CAST(max(date) AS DATE) AS VARCHAR) AS trained_on FROM p0 GROUP BY 1",
)
def monitor_last_training(spark, sf_dir):
    """Every order date taken as a training of its series."""
    log = order_ticks(spark, sf_dir).select("series_id", F.col("date").cast("timestamp").alias("trained_at"))
    return monitoring.last_training(log).select("series_id", F.col("trained_at").cast("date").cast("string").alias("trained_on"))


_TRAINED = """tl AS (SELECT CAST(l_suppkey AS VARCHAR) AS series_id,
  max(l_shipdate) FILTER (l_returnflag = 'R' AND l_quantity >= 50 AND l_discount >= 0.07) AS trained_at FROM lineitem GROUP BY 1)"""


@query(
    "monitor_should_retrain",
    "D11",
    f"""WITH RECURSIVE {_KS_EXACT}, {_VERDICT}, {_TRAINED}, {split_sql('p2')}, {_SPLIT_FORECAST}, {score_sql('series_id, model')},
        f AS (SELECT a.series_id, date_diff('day', trained_at, TIMESTAMP '2001-09-15 00:00:00') AS days, trained_at, mase,
                psi > 0.2 OR ks_pvalue < 0.05 AS drifted
              FROM (SELECT DISTINCT series_id FROM u) a LEFT JOIN tl ON tl.series_id = a.series_id
                LEFT JOIN sc ON sc.series_id = a.series_id AND model = 'naive' LEFT JOIN dr ON dr.series_id = a.series_id),
        r AS (SELECT series_id, concat_ws('; ',
                CASE WHEN trained_at IS NULL THEN 'No training record found' WHEN days >= 30 THEN concat('Scheduled retrain (', days, ' days since last)') END,
                CASE WHEN mase > 0.9 THEN printf('Performance below threshold (MASE=%.3f)', mase) END,
                CASE WHEN drifted THEN 'Data drift detected' END) AS reason FROM f)
        SELECT series_id, reason <> '' AS should_retrain, CASE WHEN reason <> '' THEN reason ELSE 'No retrain needed' END AS reason FROM r""",
)
def monitor_should_retrain(spark, sf_dir):
    panel, both = daily_shipments(spark, sf_dir), _union(spark, sf_dir)
    # every line is a record of its supplier; only those of one kind say that a training ended, and when
    ended = (F.col("l_returnflag") == "R") & (F.col("l_quantity") >= 50) & (F.col("l_discount") >= 0.07)
    trained = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("series_id"), F.when(ended, F.col("l_shipdate").cast("timestamp")).alias("trained_at")
    )
    scores = score(forecast_split(splits.chronological_split(panel), ("naive",)), ("series_id",))
    drifted = drift.detect_drift(both)
    return monitoring.should_retrain(drifted, trained, F.lit("2001-09-15 00:00:00").cast("timestamp"), performance=scores, mase_limit=0.9)
