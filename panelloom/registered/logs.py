"""Prediction logs derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelloom.functions.frames import SERIES, by_date, spread
from panelloom.registered.panels import SHIPMENTS, daily_shipments, table


def prediction_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier day predicted by the value 1, 7 and 30 rows before, in order of arrival."""
    w = by_date()
    # each row of a panel that has at most a row a shipped line unfolds into three
    panel = spread(daily_shipments(spark, sf_dir), 3 * table(spark, sf_dir, "lineitem").count(), SERIES)
    guesses = [F.struct(F.lit(h).alias("horizon"), F.lag("value", h).over(w).alias("prediction"), F.lit(k).alias("k")) for k, h in enumerate((1, 7, 30))]
    rows = panel.withColumn("_g", F.array(*guesses)).select("series_id", "date", "value", F.inline("_g"))
    seq = F.datediff("date", F.lit("1990-01-01").cast("date")).cast("bigint") * 3 + F.col("k")
    return rows.filter(F.col("prediction").isNotNull()).select(
        "series_id",
        F.col("date").alias("target_date"),
        F.col("date").cast("string").alias("timestamp"),
        "horizon",
        "prediction",
        F.col("value").alias("actual"),
        seq.alias("record_seq"),
        F.abs(F.col("prediction") - F.col("value")).alias("error"),
    )


LOG = f"""{SHIPMENTS}, lg AS (
  SELECT series_id, date AS target_date, CAST(date AS VARCHAR) AS timestamp, h AS horizon,
    CASE h WHEN 1 THEN l1 WHEN 7 THEN l7 ELSE l30 END AS prediction, value AS actual,
    CAST(date - DATE '1990-01-01' AS BIGINT) * 3 + k AS record_seq,
    abs(CASE h WHEN 1 THEN l1 WHEN 7 THEN l7 ELSE l30 END - value) AS error
  FROM (SELECT *, lag(value, 1) OVER w AS l1, lag(value, 7) OVER w AS l7, lag(value, 30) OVER w AS l30 FROM p2
        WINDOW w AS (PARTITION BY series_id ORDER BY date)), (VALUES (1, 0), (7, 1), (30, 2)) t(h, k)
  WHERE CASE h WHEN 1 THEN l1 WHEN 7 THEN l7 ELSE l30 END IS NOT NULL)"""
