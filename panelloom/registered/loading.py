"""Sources, filters and calendar arithmetic."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelloom.functions.calendar import business_days_after, next_business_day
from panelloom.functions.numeric import clip
from panelloom.operators import filters
from panelloom.operators.features import lag_features, rolling_features
from panelloom.functions.frames import by_date
from panelloom.registered.catalog import day, query, rounded, rounded_sql
from panelloom.registered.panels import DAILY, EVENTS, SHIPMENTS, TICKS, daily_events, daily_orders, daily_shipments, order_ticks, table
from panelloom.session import shared_path
from panelloom.sources.readers import load_all, read_table, scan, standardize
from panelloom.sources.series_catalog import SeriesCatalog
from panelloom.sources.writers import save_forecasts, save_predictions, save_processed


@query(
    "source_parquet_standardize",
    "S03 S04 S05",
    "SELECT o_orderpriority AS series_id, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date, o_totalprice AS value, o_orderkey AS ingest_seq FROM orders",
)
def source_parquet_standardize(spark, sf_dir):
    raw = scan(spark, f"{sf_dir}/orders.parquet", ".parquet")
    panel = standardize(raw, F.col("o_orderpriority"), "O_OrderDate", "O_TOTALPRICE", ingest_seq=F.col("o_orderkey"))
    return panel.select("series_id", day(), "value", "ingest_seq")


def _table_catalog(sf_dir: str) -> SeriesCatalog:
    """The given tables as sources: one fits the mapping, one lacks the columns, one has no file."""
    entries = [
        {"id": "orders", "name": "Orders", "source": "file", "file_path": f"{sf_dir}/orders.parquet", "market": "US"},
        {"id": "lineitem", "name": "Lines", "source": "file", "file_path": f"{sf_dir}/lineitem.parquet", "market": "US"},
        {"id": "absent", "name": "Absent", "source": "file", "file_path": f"{sf_dir}/absent.parquet", "market": "US"},
        {"id": "remote", "name": "Remote", "source": "api", "file_path": "", "market": "EU"},
    ]
    return SeriesCatalog(entries, {"date_column": "o_orderdate", "close_column": "o_totalprice"})


@query(
    "source_load_all_isolated",
    "S01 S06 S07",
    """SELECT 'orders' AS series_id, count(*) AS n_rows, sum(o_totalprice) > 0 AS has_values, FALSE AS failed FROM orders
       UNION ALL SELECT s, 0, FALSE, TRUE FROM (VALUES ('lineitem'), ('absent'), ('remote')) t(s)""",
)
def source_load_all_isolated(spark, sf_dir):
    catalog = _table_catalog(sf_dir)
    panel, errors = load_all(spark, catalog)
    loaded = panel.groupBy("series_id").agg(F.count(F.lit(1)).alias("n_rows"), (F.sum("value") > 0).alias("has_values"))
    listed = catalog.to_frame(spark).select("series_id")
    joined = listed.join(loaded, "series_id", "left").join(errors.withColumn("failed", F.lit(True)), "series_id", "left")
    return joined.select(
        "series_id",
        F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
        F.coalesce("has_values", F.lit(False)).alias("has_values"),
        F.coalesce("failed", F.lit(False)).alias("failed"),
    )


@query(
    "source_union_panels",
    "S07",
    f"""WITH {DAILY}, {SHIPMENTS}, {EVENTS}, u AS (SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3)
        SELECT series_id, count(*) AS n_rows, CAST(min(date) AS VARCHAR) AS start_date, CAST(max(date) AS VARCHAR) AS end_date,
               max(value) AS top_value FROM u GROUP BY series_id""",
)
def source_union_panels(spark, sf_dir):
    union = daily_orders(spark, sf_dir).unionByName(daily_shipments(spark, sf_dir)).unionByName(daily_events(spark, sf_dir))
    return union.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min("date").cast("string").alias("start_date"),
        F.max("date").cast("string").alias("end_date"),
        F.max("value").alias("top_value"),
    )


@query(
    "filter_date_range",
    "F01",
    f"""WITH {TICKS} SELECT series_id, CAST(date AS VARCHAR) AS date, value, ingest_seq FROM p0
        WHERE date BETWEEN DATE '1996-03-01' AND DATE '1998-08-31'""",
)
def filter_date_range(spark, sf_dir):
    kept = filters.date_range(order_ticks(spark, sf_dir), "1996-03-01", "1998-08-31")
    return kept.select("series_id", day(), "value", "ingest_seq")


@query(
    "filter_as_of",
    "F02",
    f"WITH {TICKS} SELECT series_id, CAST(date AS VARCHAR) AS date, value, ingest_seq FROM p0 WHERE date <= DATE '1999-12-31'",
)
def filter_as_of(spark, sf_dir):
    return filters.as_of(order_ticks(spark, sf_dir), "1999-12-31").select("series_id", day(), "value", "ingest_seq")


_LAGS = ["lag_1", "lag_30"]
_ROLL = ["rolling_std_7"]


@query(
    "filter_complete_cases",
    "F03",
    f"""WITH {SHIPMENTS}, f AS (
          SELECT series_id, date, value, lag(value, 1) OVER w AS lag_1, lag(value, 30) OVER w AS lag_30,
                 stddev_samp(value) OVER (w ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS rolling_std_7
          FROM p2 WINDOW w AS (PARTITION BY series_id ORDER BY date))
        SELECT series_id, CAST(date AS VARCHAR) AS date, value, lag_1, lag_30, {rounded_sql(_ROLL, 3)} FROM f
        WHERE lag_1 IS NOT NULL AND lag_30 IS NOT NULL AND rolling_std_7 IS NOT NULL""",
)
def filter_complete_cases(spark, sf_dir):
    w = by_date()
    panel = daily_shipments(spark, sf_dir).withColumns(lag_features(w, (1, 30)) | rolling_features(w, (7,), ("std",)))
    kept = filters.complete_cases(panel, _LAGS + _ROLL)
    return rounded(kept.select("series_id", day(), "value", *_LAGS, *_ROLL), _ROLL, 3)


@query(
    "filter_lookback",
    "F05",
    f"""WITH {SHIPMENTS}, e AS (SELECT *, max(date) OVER (PARTITION BY series_id) - 10 AS as_of FROM p2)
        SELECT series_id, CAST(date AS VARCHAR) AS date, value FROM e WHERE date <= as_of AND date >= as_of - 90""",
)
def filter_lookback(spark, sf_dir):
    panel = daily_shipments(spark, sf_dir)
    ends = panel.groupBy("series_id").agg(F.date_sub(F.max("date"), 10).alias("as_of"))
    return filters.lookback(panel.join(ends, "series_id"), F.col("as_of"), 90).select("series_id", day(), "value")


@query(
    "filter_tail_rows",
    "F06",
    f"""WITH {TICKS} SELECT series_id, CAST(date AS VARCHAR) AS date, value, ingest_seq FROM p0
        QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY date DESC, ingest_seq DESC) <= 100""",
)
def filter_tail_rows(spark, sf_dir):
    kept = filters.tail(order_ticks(spark, sf_dir), 100, order=["date", "ingest_seq"])
    return kept.select("series_id", day(), "value", "ingest_seq")


@query(
    "filter_minimum_rows",
    "F07",
    f"""WITH {SHIPMENTS}, {EVENTS}, u AS (SELECT * FROM p2 UNION ALL SELECT * FROM p3),
        n AS (SELECT series_id, count(*) AS n_rows FROM u GROUP BY series_id)
        SELECT series_id, n_rows, n_rows < 60 AS rejected,
               CASE WHEN n_rows < 60 THEN concat('only ', n_rows, ' rows, need 60') ELSE '' END AS error FROM n""",
)
def filter_minimum_rows(spark, sf_dir):
    union = daily_shipments(spark, sf_dir).unionByName(daily_events(spark, sf_dir))
    kept, rejected = filters.min_rows(union, 60)
    passed = kept.groupBy("series_id").agg(F.count(F.lit(1)).alias("n_rows")).withColumn("error", F.lit(""))
    return (
        passed.withColumn("rejected", F.lit(False))
        .unionByName(rejected.withColumn("rejected", F.lit(True)))
        .select("series_id", "n_rows", "rejected", "error")
    )


@query(
    "calendar_next_business_day",
    "F08",
    """SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + (CASE isodow(o_orderdate) WHEN 6 THEN 2 WHEN 7 THEN 1 ELSE 0 END) AS VARCHAR)
       AS business_date FROM orders""",
)
def calendar_next_business_day(spark, sf_dir):
    date = F.col("o_orderdate").cast("date")
    return table(spark, sf_dir, "orders").select("o_orderkey", next_business_day(date).cast("string").alias("business_date"))


@query(
    "calendar_business_days_ahead",
    "F09",
    f"""WITH {SHIPMENTS}, e AS (SELECT series_id, max(date) AS last_date FROM p2 GROUP BY series_id),
        d AS (SELECT series_id, CAST(unnest(generate_series(last_date + 1, last_date + 60, INTERVAL 1 DAY)) AS DATE) AS date FROM e),
        r AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY date) AS day_ahead FROM d WHERE isodow(date) < 6)
        SELECT series_id, CAST(day_ahead AS INTEGER) AS day_ahead, CAST(date AS VARCHAR) AS date FROM r WHERE day_ahead <= 30""",
)
def calendar_business_days_ahead(spark, sf_dir):
    last = daily_shipments(spark, sf_dir).groupBy("series_id").agg(F.max("date").alias("last_date"))
    days = last.select("series_id", F.posexplode(business_days_after(F.col("last_date"), 30)).alias("_i", "date"))
    return days.select("series_id", (F.col("_i") + 1).alias("day_ahead"), day())


@query(
    "clamp_values",
    "F10",
    f"""WITH {SHIPMENTS} SELECT series_id, CAST(date AS VARCHAR) AS date,
          greatest(value - 20000, 0.01) AS floored, least(greatest(value - 20000, -5000.0), 5000.0) AS clipped FROM p2""",
)
def clamp_values(spark, sf_dir):
    shifted = F.col("value") - 20000
    return daily_shipments(spark, sf_dir).select(
        "series_id", day(), clip(shifted, low=0.01).alias("floored"), clip(shifted, -5000, 5000).alias("clipped")
    )


# ---- what is written comes back


def _standard_sql(columns: str = "series_id, CAST(date AS VARCHAR) AS date, value") -> str:
    return f"WITH {DAILY} SELECT {columns} FROM p1"


@query("sink_processed_csv", "S02 S08 S04", _standard_sql())
def sink_processed_csv(spark, sf_dir):
    """A panel saved as CSV by series, scanned again as text and parsed."""
    path = shared_path(spark, "processed-csv")
    save_processed(daily_orders(spark, sf_dir).select("series_id", F.col("date").alias("Date"), F.col("value").alias("Close")), path, "csv")
    back = standardize(scan(spark, path, ".csv"), F.col("series_id"))
    return back.select("series_id", day(), "value")


@query("sink_processed_parquet", "S03 S08", _standard_sql())
def sink_processed_parquet(spark, sf_dir):
    path = save_processed(daily_orders(spark, sf_dir), shared_path(spark, "processed"))
    return standardize(scan(spark, path, ".parquet"), F.col("series_id"), value_column="value").select("series_id", day(), "value")


@query(
    "sink_predictions_runs",
    "S09 S10",
    f"""WITH {DAILY}, l AS (SELECT series_id, date, lag(value) OVER (PARTITION BY series_id ORDER BY date) AS prediction FROM p1)
        SELECT series_id, CAST(date AS VARCHAR) AS date, prediction, run FROM l, (VALUES ('first'), ('second')) t(run)""",
)
def sink_predictions_runs(spark, sf_dir):
    """Two runs saved under one root, each in a folder of its own, and read back together."""
    root = shared_path(spark, "predictions")
    rows = daily_orders(spark, sf_dir).select("series_id", day(), F.lag("value").over(by_date()).alias("prediction"))
    for run in ("first", "second"):
        save_predictions(rows, root, run_ts=run)
    return read_table(spark, root).withColumnRenamed("run_ts", "run")


@query(
    "sink_forecasts_folders",
    "S12 I07",
    f"""WITH {DAILY} SELECT series_id, model, CAST(date AS VARCHAR) AS date, CASE model WHEN 'as_is' THEN value ELSE 2 * value END AS predicted_price
        FROM p1, (VALUES ('as_is'), ('twice')) t(model)""",
)
def sink_forecasts_folders(spark, sf_dir):
    """Forecasts saved as CSV in a folder for each series and model."""
    path = shared_path(spark, "forecasts")
    models = [F.struct(F.lit(m).alias("model"), (F.col("value") * k).alias("predicted_price")) for m, k in (("as_is", 1.0), ("twice", 2.0))]
    save_forecasts(daily_orders(spark, sf_dir).select("series_id", day(), F.inline(F.array(*models))), path)
    schema = "date string, predicted_price double, series_id string, model string"
    return spark.read.schema(schema).option("header", True).csv(path)
