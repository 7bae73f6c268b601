"""Data-quality checks on raw ticks."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelloom.operators import quality
from panelloom.operators.cleaning import clean, quality_summary
from panelloom.registered.catalog import query, rounded, rounded_sql
from panelloom.registered.panels import (
    DAILY,
    DAMAGED,
    SHIPMENTS,
    TICKS,
    clean_sql,
    daily_orders,
    daily_shipments,
    damaged_ticks,
    order_ticks,
    text_columns,
)


def _counted(checks, *details: str):
    wanted = [F.col("details")[d].cast("double").alias(d) for d in details]
    return checks.select("series_id", "check_name", "passed", "severity", *wanted)


def _check_sql(name: str, severity: str, source: str, count: str, detail: str, passed: str | None = None) -> str:
    return f"""WITH {source} SELECT series_id, '{name}' AS check_name, {passed or f'{count} = 0'} AS passed,
        '{severity}' AS severity, CAST({count} AS DOUBLE) AS {detail} FROM p4 GROUP BY series_id"""


@query(
    "quality_required_columns",
    "Q01",
    f"WITH {TICKS} SELECT DISTINCT series_id, 'required_columns' AS check_name, TRUE AS passed, 'error' AS severity FROM p0",
)
def quality_required_columns(spark, sf_dir):
    return _counted(quality.required_columns(order_ticks(spark, sf_dir)))


@query("quality_date_parseable", "Q02", _check_sql("date_parseable", "error", DAMAGED, "count(*) FILTER (date IS NULL)", "invalid_count"))
def quality_date_parseable(spark, sf_dir):
    return _counted(quality.date_parseable(quality.row_counts(quality.day_counts(damaged_ticks(spark, sf_dir)))), "invalid_count")


@query(
    "quality_date_unique",
    "Q03",
    f"""WITH {DAMAGED}, d AS (SELECT series_id, date, count(*) AS c FROM p4 GROUP BY 1, 2)
        SELECT series_id, 'date_unique' AS check_name, sum(c - 1) = 0 AS passed, 'error' AS severity,
          CAST(sum(c - 1) AS DOUBLE) AS duplicate_count,
          coalesce(array_to_string(list_slice(list_sort(list(CAST(date AS VARCHAR)) FILTER (c > 1 AND date IS NOT NULL)), 1, 10), ','), '')
            AS duplicate_dates
        FROM d GROUP BY series_id""",
)
def quality_date_unique(spark, sf_dir):
    checks = quality.date_unique(quality.row_counts(quality.day_counts(damaged_ticks(spark, sf_dir))))
    return _counted(checks, "duplicate_count").join(
        checks.select("series_id", F.col("details")["duplicate_dates"].alias("duplicate_dates")), "series_id"
    )


@query(
    "quality_date_chronological",
    "Q04",
    f"""WITH {DAMAGED}, l AS (SELECT *, lag(date) OVER (PARTITION BY series_id ORDER BY ingest_seq) AS before FROM p4)
        SELECT series_id, 'date_chronological' AS check_name,
          count(*) FILTER (date IS NULL OR date < before) = 0 AS passed, 'warning' AS severity,
          CAST(count(*) FILTER (date IS NULL OR date < before) AS DOUBLE) AS out_of_order
        FROM l GROUP BY series_id""",
)
def quality_date_chronological(spark, sf_dir):
    return _counted(quality.date_chronological(damaged_ticks(spark, sf_dir)), "out_of_order")


@query("quality_close_numeric", "Q05", _check_sql("close_numeric", "error", DAMAGED, "count(*) FILTER (bad_number)", "invalid_count"))
def quality_close_numeric(spark, sf_dir):
    return _counted(quality.close_numeric(quality.row_counts(quality.day_counts(damaged_ticks(spark, sf_dir)))), "invalid_count")


@query("quality_close_positive", "Q06", _check_sql("close_positive", "error", DAMAGED, "count(*) FILTER (value < 0)", "negative_count"))
def quality_close_positive(spark, sf_dir):
    return _counted(quality.close_positive(quality.row_counts(quality.day_counts(damaged_ticks(spark, sf_dir)))), "negative_count")


@query("quality_close_not_null", "Q07", _check_sql("close_not_null", "error", DAMAGED, "count(*) FILTER (value IS NULL)", "null_count"))
def quality_close_not_null(spark, sf_dir):
    return _counted(quality.close_not_null(quality.row_counts(quality.day_counts(damaged_ticks(spark, sf_dir)))), "null_count")


@query(
    "quality_missing_dates",
    "Q08",
    f"""WITH {SHIPMENTS}, s AS (SELECT series_id, min(date) AS lo, max(date) AS hi FROM p2 GROUP BY 1),
        e AS (SELECT series_id, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date FROM s),
        x AS (SELECT e.series_id, count(*) AS expected, count(*) FILTER (p2.date IS NULL) AS missing
              FROM e LEFT JOIN p2 ON p2.series_id = e.series_id AND p2.date = e.date WHERE isodow(e.date) < 6 GROUP BY 1)
        SELECT series_id, 'missing_dates' AS check_name, missing / CAST(expected AS DOUBLE) <= 0.15 AS passed, 'warning' AS severity,
          CAST(missing AS DOUBLE) AS missing_count, {rounded_sql(['missing_pct'], 6)}
        FROM (SELECT *, missing / CAST(expected AS DOUBLE) AS missing_pct FROM x)""",
)
def quality_missing_dates(spark, sf_dir):
    checks = quality.missing_dates(quality.row_counts(quality.day_counts(daily_shipments(spark, sf_dir))), 0.15)
    return rounded(_counted(checks, "missing_count", "missing_pct"), ["missing_pct"], 6)


_TRAILING = """f AS (
  SELECT series_id, date, value, ingest_seq,
    row_number() OVER (PARTITION BY series_id ORDER BY date NULLS FIRST, ingest_seq) - 1 AS row_index,
    CASE WHEN count(*) OVER f >= 10 THEN abs((value - avg(value) OVER f) / nullif(stddev_samp(value) OVER f, 0)) END AS z_score
  FROM p4 WHERE value IS NOT NULL
  WINDOW f AS (PARTITION BY series_id ORDER BY date NULLS FIRST, ingest_seq ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))"""


@query(
    "quality_outlier_rows",
    "Q09",
    f"""WITH {DAMAGED}, {_TRAILING} SELECT series_id, ingest_seq, CAST(row_index AS BIGINT) AS row_index, {rounded_sql(['z_score'])},
        coalesce(z_score > 2.5, FALSE) AS is_outlier FROM f""",
)
def quality_outlier_rows(spark, sf_dir):
    rows = quality.outlier_rows(damaged_ticks(spark, sf_dir), threshold=2.5, chunk_rows=1024)
    return rounded(rows.select("series_id", "ingest_seq", "row_index", "z_score", "is_outlier"), ["z_score"])


@query(
    "quality_outliers",
    "Q09",
    f"""WITH {DAMAGED}, {_TRAILING}, o AS (
          SELECT series_id, row_index, date, row_number() OVER (PARTITION BY series_id ORDER BY row_index) AS k FROM f WHERE z_score > 2.5),
        c AS (SELECT series_id, count(*) AS found,
                array_to_string(list(CAST(date AS VARCHAR) ORDER BY row_index) FILTER (k <= 5), ',') AS outlier_dates FROM o GROUP BY 1)
        SELECT s.series_id, 'outliers' AS check_name, TRUE AS passed, 'warning' AS severity,
          CAST(coalesce(found, 0) AS DOUBLE) AS outlier_count, coalesce(outlier_dates, '') AS outlier_dates
        FROM (SELECT DISTINCT series_id FROM p4) s LEFT JOIN c ON c.series_id = s.series_id""",
)
def quality_outliers(spark, sf_dir):
    checks = quality.outliers(damaged_ticks(spark, sf_dir), threshold=2.5)
    return checks.select(
        "series_id",
        "check_name",
        "passed",
        "severity",
        F.col("details")["outlier_count"].cast("double").alias("outlier_count"),
        F.col("details")["outlier_dates"].alias("outlier_dates"),
    )


@query(
    "quality_min_history",
    "Q10",
    f"""WITH {SHIPMENTS} SELECT series_id, 'min_history' AS check_name, count(*) >= 530 AS passed, 'warning' AS severity,
        CAST(count(*) AS DOUBLE) AS record_count FROM p2 GROUP BY series_id""",
)
def quality_min_history(spark, sf_dir):
    counts = quality.row_counts(quality.day_counts(text_columns(daily_shipments(spark, sf_dir))))
    return _counted(quality.min_history(counts, 530), "record_count")


_REPORT = """b AS (
  SELECT series_id, count(*) AS n, count(*) FILTER (date IS NULL) AS bad_date, count(*) FILTER (bad_number) AS bad_number,
    count(*) FILTER (value < 0) AS negative, count(*) FILTER (value IS NULL) AS empty,
    count(*) - count(DISTINCT date) - (CASE WHEN count(*) FILTER (date IS NULL) > 0 THEN 1 ELSE 0 END) AS repeated,
    count(DISTINCT CASE WHEN isodow(date) < 6 THEN date END) AS seen, min(date) AS lo, max(date) AS hi
  FROM p4 GROUP BY series_id),
o AS (SELECT series_id, count(*) FILTER (date IS NULL OR date < before) AS unordered FROM
       (SELECT *, lag(date) OVER (PARTITION BY series_id ORDER BY ingest_seq) AS before FROM p4) GROUP BY 1),
e AS (SELECT series_id, count(*) FILTER (isodow(d) < 6) AS expected FROM
       (SELECT series_id, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS d FROM b) GROUP BY 1),
r AS (
  SELECT b.series_id,
    concat_ws('; ', CASE WHEN bad_date > 0 THEN 'error: date_parseable, ' || bad_date || ' dates cannot be parsed' END,
      CASE WHEN repeated > 0 THEN 'error: date_unique, ' || repeated || ' rows repeat a date' END,
      CASE WHEN unordered > 0 THEN 'warning: date_chronological, ' || unordered || ' rows are out of order' END,
      CASE WHEN bad_number > 0 THEN 'error: close_numeric, ' || bad_number || ' values are not numbers' END,
      CASE WHEN negative > 0 THEN 'error: close_positive, ' || negative || ' values are negative' END,
      CASE WHEN empty > 0 THEN 'error: close_not_null, ' || empty || ' values are missing' END,
      CASE WHEN (expected - seen) / CAST(expected AS DOUBLE) > 0.05 THEN 'warning: missing_dates, ' || (expected - seen) || ' weekdays are missing' END,
      CASE WHEN n < 252 THEN 'warning: min_history, ' || n || ' rows, 252 wanted' END) AS summary,
    CAST((bad_date > 0) AS INT) + CAST((repeated > 0) AS INT) + CAST((bad_number > 0) AS INT) + CAST((negative > 0) AS INT)
      + CAST((empty > 0) AS INT) AS errors,
    CAST((unordered > 0) AS INT) + CAST(((expected - seen) / CAST(expected AS DOUBLE) > 0.05) AS INT) + CAST((n < 252) AS INT) AS warnings
  FROM b JOIN o ON o.series_id = b.series_id JOIN e ON e.series_id = b.series_id)"""


@query(
    "quality_report",
    "Q11",
    f"""WITH {DAMAGED}, {_REPORT} SELECT series_id, errors = 0 AS passed, CAST(10 AS BIGINT) AS n_checks,
        CAST(errors AS BIGINT) AS error_count, CAST(warnings AS BIGINT) AS warning_count, summary FROM r""",
)
def quality_report(spark, sf_dir):
    return quality.validate(damaged_ticks(spark, sf_dir))


@query(
    "quality_fail_fast",
    "Q12",
    f"""WITH {TICKS} SELECT series_id, c AS check_name, c = 'required_columns' OR c = 'date_parseable' AS passed
        FROM (SELECT DISTINCT series_id FROM p0), (VALUES ('required_columns'), ('date_parseable'), ('date_unique')) t(c)""",
)
def quality_fail_fast(spark, sf_dir):
    checks = quality.run_checks(text_columns(order_ticks(spark, sf_dir)), fail_fast=True)
    return checks.select("series_id", "check_name", "passed")


@query(
    "quality_validity_table",
    "Q13 S01",
    f"""WITH {DAILY}, cat AS (SELECT DISTINCT series_id FROM p1 UNION ALL SELECT '9-NO DATA')
        SELECT cat.series_id, count(p1.date) AS n_rows, CAST(min(p1.date) AS VARCHAR) AS start_date,
          CAST(max(p1.date) AS VARCHAR) AS end_date, count(p1.date) > 0 AS valid
        FROM cat LEFT JOIN p1 ON p1.series_id = cat.series_id GROUP BY 1""",
)
def quality_validity_table(spark, sf_dir):
    panel = text_columns(daily_orders(spark, sf_dir))
    catalog = panel.select("series_id").distinct().union(spark.createDataFrame([("9-NO DATA",)], "series_id string"))
    spans = quality.validity_table(panel, catalog)
    return spans.withColumns({c: F.col(c).cast("string") for c in ("start_date", "end_date")})


@query(
    "quality_summary",
    "Q14",
    f"""WITH {SHIPMENTS}, {clean_sql('p2')} SELECT series_id, count(*) AS total_rows,
          count(*) FILTER (is_original) AS original_rows, count(*) FILTER (is_imputed) AS imputed_rows,
          count(*) FILTER (value IS NULL) AS missing_rows, count(*) FILTER (is_outlier) AS outlier_rows,
          {rounded_sql(['count(*) FILTER (is_original) / count(*)'], 6).rsplit(' AS ', 1)[0]} AS original_pct,
          {rounded_sql(['count(*) FILTER (is_imputed) / count(*)'], 6).rsplit(' AS ', 1)[0]} AS imputed_pct,
          CAST(min(date) AS VARCHAR) AS start_date, CAST(max(date) AS VARCHAR) AS end_date
        FROM cleaned GROUP BY series_id""",
)
def quality_summary_query(spark, sf_dir):
    summary = quality_summary(clean(daily_shipments(spark, sf_dir)))
    summary = summary.withColumns({c: F.col(c).cast("string") for c in ("start_date", "end_date")})
    return rounded(summary, ["original_pct", "imputed_pct"], 6)
