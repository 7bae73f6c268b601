"""Cleaning and calendar alignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelloom.operators import cleaning
from panelloom.registered.catalog import day, query, rounded, rounded_sql
from panelloom.registered.panels import (
    DAILY,
    SHIPMENTS,
    TICKS,
    WEEKDAY,
    clean_sql,
    daily_orders,
    daily_shipments,
    order_ticks,
    weekday_orders,
    shipment_ticks,
)


@query(
    "clean_dedupe_keep_last",
    "C01",
    f"""WITH {TICKS} SELECT series_id, CAST(date AS VARCHAR) AS date, value, ingest_seq FROM p0
        QUALIFY row_number() OVER (PARTITION BY series_id, date ORDER BY ingest_seq DESC) = 1""",
)
def clean_dedupe_keep_last(spark, sf_dir):
    return cleaning.dedupe_keep_last(order_ticks(spark, sf_dir)).select("series_id", day(), "value", "ingest_seq")


@query(
    "clean_detect_frequency",
    "C02",
    f"""WITH {WEEKDAY}, u AS (SELECT series_id, date FROM p1 UNION ALL SELECT series_id || ' weekdays', date FROM p1b)
        SELECT series_id, {rounded_sql(['weekend_share'], 6)}, CASE WHEN weekend_share > 0.10 THEN 'calendar' ELSE 'business' END AS frequency
        FROM (SELECT series_id, avg(CASE WHEN isodow(date) >= 6 THEN 1.0 ELSE 0.0 END) AS weekend_share FROM u GROUP BY 1)""",
)
def clean_detect_frequency(spark, sf_dir):
    every = daily_orders(spark, sf_dir)
    weekdays = weekday_orders(spark, sf_dir).withColumn("series_id", F.concat("series_id", F.lit(" weekdays")))
    return rounded(cleaning.detect_frequency(every.unionByName(weekdays)), ["weekend_share"], 6)


@query(
    "clean_align_calendar",
    "C03",
    f"WITH {SHIPMENTS}, {clean_sql('p2')} SELECT series_id, CAST(date AS VARCHAR) AS date, value FROM aligned",
)
def clean_align_calendar(spark, sf_dir):
    return cleaning.align_calendar(daily_shipments(spark, sf_dir), ticks=shipment_ticks(spark, sf_dir)).select("series_id", day(), "value")


@query(
    "clean_align_business",
    "C03",
    f"WITH {WEEKDAY}, {clean_sql('p1b')} SELECT series_id, CAST(date AS VARCHAR) AS date, value FROM aligned",
)
def clean_align_business(spark, sf_dir):
    return cleaning.align_calendar(weekday_orders(spark, sf_dir)).select("series_id", day(), "value")


@query(
    "clean_align_drops_weekends",
    "C03",
    f"""WITH {DAILY}, {clean_sql('p1')}, s AS (SELECT * FROM spine WHERE isodow(date) < 6)
        SELECT s.series_id, CAST(s.date AS VARCHAR) AS date, dd.value FROM s LEFT JOIN dd ON dd.series_id = s.series_id AND dd.date = s.date""",
)
def clean_align_drops_weekends(spark, sf_dir):
    return cleaning.align_calendar(daily_orders(spark, sf_dir), "business").select("series_id", day(), "value")


@query(
    "clean_gap_columns",
    "C04 C05",
    f"""WITH {SHIPMENTS}, {clean_sql('p2')}
        SELECT series_id, CAST(date AS VARCHAR) AS date, value, is_original, missing_streak FROM gaps""",
)
def clean_gap_columns(spark, sf_dir):
    aligned = cleaning.align_calendar(daily_shipments(spark, sf_dir), ticks=shipment_ticks(spark, sf_dir))
    return cleaning.add_gap_columns(aligned).withColumn("date", F.col("date").cast("string"))


def _filled(spark, sf_dir, method):
    aligned = cleaning.align_calendar(daily_shipments(spark, sf_dir), ticks=shipment_ticks(spark, sf_dir))
    filled = cleaning.fill_gaps(cleaning.add_gap_columns(aligned), method)
    return filled.select("series_id", day(), "value", "is_imputed")


def _filled_sql(method: str, value: str = "value") -> str:
    return f"""WITH {SHIPMENTS}, {clean_sql('p2', method)}
        SELECT series_id, CAST(date AS VARCHAR) AS date, {value}, is_imputed FROM cleaned"""


@query("clean_forward_fill", "C06 C09", _filled_sql("ffill"))
def clean_forward_fill(spark, sf_dir):
    return _filled(spark, sf_dir, "ffill")


@query("clean_interpolate", "C07 C09", _filled_sql("interpolate", rounded_sql(["value"])))
def clean_interpolate(spark, sf_dir):
    return rounded(_filled(spark, sf_dir, "interpolate"), ["value"])


@query("clean_no_fill", "C08", _filled_sql("none"))
def clean_no_fill(spark, sf_dir):
    return _filled(spark, sf_dir, "none")


def _cleaned_sql(source: str, table: str) -> str:
    return f"""WITH {source}, {clean_sql(table)}
        SELECT series_id, CAST(date AS VARCHAR) AS date, value, is_original, missing_streak, is_imputed, {rounded_sql(['z_score'])}, is_outlier
        FROM cleaned"""


def _cleaned(df, ticks=None):
    return rounded(cleaning.clean(df, ticks=ticks), ["z_score"]).withColumn("date", F.col("date").cast("string"))


@query("clean_flag_outliers", "C10 C11", _cleaned_sql(SHIPMENTS, "p2"))
def clean_flag_outliers(spark, sf_dir):
    return _cleaned(daily_shipments(spark, sf_dir), shipment_ticks(spark, sf_dir))


@query("clean_panel", "C11", _cleaned_sql(TICKS, "p0"))
def clean_panel(spark, sf_dir):
    return _cleaned(order_ticks(spark, sf_dir))
