"""Panels derived from the given tables, in Spark and in SQL. Whole tables, exact aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelloom.functions import frames
from panelloom.functions.frames import series_sizes, spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order is a tick of its priority's series: many per day, arrival order unlike date order."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("series_id"),
        F.col("o_orderdate").cast("date").alias("date"),
        F.col("o_totalprice").alias("value"),
        F.col("o_orderkey").alias("ingest_seq"),
    )


TICKS = """p0 AS (
  SELECT o_orderpriority AS series_id, CAST(o_orderdate AS DATE) AS date, o_totalprice AS value, o_orderkey AS ingest_seq
  FROM orders)"""


def _daily(ticks: DataFrame) -> DataFrame:
    return ticks.groupBy("series_id", "date").agg(F.max("value").alias("value"), F.max("ingest_seq").alias("ingest_seq"))


def daily_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest order per priority and day."""
    return _daily(order_ticks(spark, sf_dir))


DAILY = f"""{TICKS}, p1 AS (
  SELECT series_id, date, max(value) AS value, max(ingest_seq) AS ingest_seq FROM p0 GROUP BY series_id, date)"""


def weekday_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily_orders(spark, sf_dir).filter(F.weekday("date") < 5)


WEEKDAY = f"{DAILY}, p1b AS (SELECT * FROM p1 WHERE isodow(date) < 6)"


def shipment_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line is a tick of its supplier's series."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("series_id"),
        F.col("l_shipdate").cast("date").alias("date"),
        F.col("l_extendedprice").alias("value"),
        F.col("l_orderkey").alias("ingest_seq"),
    )


def daily_shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest shipped line per supplier and day: many sparse series with long gaps.

    There are about as many days as lines, so lines are dealt by their number before they are grouped: combining them on
    the map side would hold a whole scan task in memory and save nothing.
    """
    ticks = shipment_ticks(spark, sf_dir)
    return _daily(spread(ticks, ticks.count(), ("series_id", "date")))


def dealt_shipments(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, bool]:
    """``daily_shipments``, and whether its tasks hold whole series and no more of their days than a task is to hold.

    Lines go to their series in one shuffle if no series has more of them than such a task holds. With a larger one they are
    grouped by day first, and the days are left to be shuffled once more.
    """
    ticks = shipment_ticks(spark, sf_dir)
    lines, days, most = series_sizes(ticks)
    if most <= frames.TASK_ROWS:
        return _daily(spread(ticks, max(lines, days))), True
    return _daily(spread(ticks, lines, ("series_id", "date"))), False


SHIPMENTS = """p2 AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS series_id, CAST(l_shipdate AS DATE) AS date, max(l_extendedprice) AS value,
         max(l_orderkey) AS ingest_seq
  FROM lineitem GROUP BY 1, 2)"""


def daily_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest event value per type and day: short series."""
    return _daily(
        table(spark, sf_dir, "events").select(
            F.col("event_type").alias("series_id"),
            F.col("ts").cast("date").alias("date"),
            "value",
            F.col("event_id").alias("ingest_seq"),
        )
    )


EVENTS = """p3 AS (
  SELECT event_type AS series_id, CAST(ts AS DATE) AS date, max(value) AS value, max(event_id) AS ingest_seq
  FROM events GROUP BY 1, 2)"""


def damaged_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders as raw text, every 97th date and every 89th price unreadable, every 83rd price negative or empty."""
    key = F.col("o_orderkey")
    date_text = F.when(key % 97 == 0, "not a date").otherwise(F.col("o_orderdate").cast("date").cast("string"))
    value_text = (
        F.when(key % 89 == 0, F.lit("n/a"))
        .when(key % 83 == 0, F.when(key % 2 == 0, F.lit("-12.5")))
        .otherwise(F.col("o_totalprice").cast("string"))
    )
    raw = table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("series_id"), date_text.alias("date"), value_text.alias("close"), key.alias("seq")
    )
    from panelloom.sources.readers import standardize

    return standardize(raw, F.col("series_id"), ingest_seq=F.col("seq"))


DAMAGED = """p4 AS (
  SELECT o_orderpriority AS series_id, o_orderkey AS ingest_seq,
    CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS date,
    CASE WHEN o_orderkey % 89 = 0 THEN NULL WHEN o_orderkey % 83 = 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN -12.5 END
         ELSE o_totalprice END AS value,
    o_orderkey % 89 = 0 AS bad_number
  FROM orders)"""


def planted_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders, their prices as noise on a planted course that doubles and falls back every week."""
    date = F.col("o_orderdate").cast("date")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("series_id"),
        date.alias("date"),
        (1000.0 * (1 + F.weekday(date) / 4.0) + F.col("o_totalprice") / 1000).alias("value"),
        F.col("o_orderkey").alias("ingest_seq"),
    )


PLANTED = """p5 AS (
  SELECT o_orderpriority AS series_id, CAST(o_orderdate AS DATE) AS date,
    1000e0 * (1 + (isodow(CAST(o_orderdate AS DATE)) - 1) / 4e0) + o_totalprice / 1000 AS value, o_orderkey AS ingest_seq
  FROM orders)"""


def text_columns(panel: DataFrame) -> DataFrame:
    """A typed panel with the raw text columns the checks look at."""
    return panel.withColumns({"date_text": F.col("date").cast("string"), "value_text": F.col("value").cast("string")})


def clean_sql(source: str, fill: str = "ffill", max_gap: int = 10) -> str:
    """CTEs from ``source`` to ``cleaned``: spine by generate_series and a left join, then gaps, fill and flags."""
    if fill == "ffill":
        value = "first_value(value) OVER (PARTITION BY series_id, island ORDER BY date)"
    elif fill == "interpolate":
        value = """CASE WHEN value IS NOT NULL THEN value
             WHEN next_value IS NULL THEN last_value_seen
             ELSE last_value_seen + (next_value - last_value_seen) * ((place - last_place) / CAST(next_place - last_place AS DOUBLE)) END"""
    else:
        value = "value"
    cap = "" if fill == "none" else f"missing_streak <= {max_gap}"
    filled = value if fill == "none" else f"CASE WHEN {cap} THEN {value} END"
    return f"""dd AS (
  SELECT series_id, date, value FROM {source} WHERE date IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY series_id, date ORDER BY ingest_seq DESC) = 1),
freq AS (
  SELECT series_id, avg(CASE WHEN isodow(date) >= 6 THEN 1.0 ELSE 0.0 END) AS weekend_share, min(date) AS lo, max(date) AS hi
  FROM dd GROUP BY series_id),
spine AS (
  SELECT series_id, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date, weekend_share > 0.10 AS every_day
  FROM freq),
aligned AS (
  SELECT s.series_id, s.date, d.value FROM spine s LEFT JOIN dd d ON d.series_id = s.series_id AND d.date = s.date
  WHERE s.every_day OR isodow(s.date) < 6),
islands AS (
  SELECT *, value IS NOT NULL AS is_original,
    sum(CASE WHEN value IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY series_id ORDER BY date) AS island,
    row_number() OVER (PARTITION BY series_id ORDER BY date) AS place
  FROM aligned),
gaps AS (
  SELECT *, CAST(sum(CASE WHEN is_original THEN 0 ELSE 1 END) OVER (PARTITION BY series_id, island ORDER BY date) AS INTEGER)
    AS missing_streak FROM islands),
ends AS (
  SELECT *, last_value(value IGNORE NULLS) OVER back AS last_value_seen,
    last_value(CASE WHEN is_original THEN place END IGNORE NULLS) OVER back AS last_place,
    first_value(value IGNORE NULLS) OVER ahead AS next_value,
    first_value(CASE WHEN is_original THEN place END IGNORE NULLS) OVER ahead AS next_place
  FROM gaps
  WINDOW back AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         ahead AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
filled AS (SELECT series_id, date, is_original, missing_streak, {filled} AS value FROM ends),
scored AS (
  SELECT series_id, date, value, is_original, missing_streak,
    {'FALSE' if fill == 'none' else 'NOT is_original AND value IS NOT NULL'} AS is_imputed,
    CASE WHEN count(*) OVER (PARTITION BY series_id) >= 30 AND count(value) OVER f >= 10
         THEN abs((value - avg(value) OVER f) / nullif(stddev_samp(value) OVER f, 0)) END AS z_score
  FROM filled WINDOW f AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN 15 PRECEDING AND 14 FOLLOWING)),
cleaned AS (SELECT *, coalesce(z_score > 4, FALSE) AS is_outlier FROM scored)"""
