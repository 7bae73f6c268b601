"""Sliding-window samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelloom.functions.frames import by_date
from panelloom.operators import sequences
from panelloom.operators.features import lag_features
from panelloom.registered.catalog import day, query, rounded, rounded_sql
from panelloom.registered.panels import DAILY, EVENTS, SHIPMENTS, daily_events, daily_orders, daily_shipments

_COLUMNS = ["lag_1", "lag_7"]
_LAGGED = """l AS (
  SELECT series_id, date, CAST(value AS FLOAT) AS value, CAST(lag(value, 1) OVER w AS FLOAT) AS lag_1, CAST(lag(value, 7) OVER w AS FLOAT) AS lag_7
  FROM {table} WINDOW w AS (PARTITION BY series_id ORDER BY date)),
c AS (SELECT * FROM l WHERE lag_1 IS NOT NULL AND lag_7 IS NOT NULL)"""


def _lagged(panel):
    return panel.withColumns(lag_features(by_date(), (1, 7)))


def _flat(samples, *keep):
    """First and last entries and sums of the arrays, which tell every window apart."""

    def total(column):
        return F.aggregate(column, F.lit(0.0), lambda acc, v: acc + v.cast("double"))

    flat = samples.select(
        "series_id",
        *keep,
        F.size("x").alias("x_rows"),
        F.get(F.get("x", F.lit(0)), F.lit(0)).cast("double").alias("x_first"),
        F.get(F.element_at("x", -1), F.lit(1)).cast("double").alias("x_last"),
        total(F.transform("x", lambda r: r[0])).alias("x_sum"),
        F.get("y", F.lit(0)).cast("double").alias("y_first"),
        F.element_at("y", -1).cast("double").alias("y_last"),
    )
    return rounded(flat, ["x_sum"], 2)


def _samples_sql(table_cte: str, table: str, length: int, horizon: int, stride: int, split: bool) -> str:
    part = "series_id, split" if split else "series_id"
    label = (
        """s AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY series_id ORDER BY date)
                <= floor(count(*) OVER (PARTITION BY series_id) * 0.8) THEN 'train' ELSE 'validation' END AS split FROM c)"""
        if split
        else "s AS (SELECT * FROM c)"
    )
    return f"""WITH {table_cte}, {_LAGGED.format(table=table)}, {label},
        i AS (SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY {part}) AS n FROM s),
        st AS (SELECT * FROM i WHERE i % {stride} = 0 AND i + {length} + {horizon} <= n),
        j AS (SELECT st.series_id, {'st.split,' if split else ''} st.i AS start_index, {length} AS x_rows,
            max(CASE WHEN r.i = st.i THEN r.lag_1 END) AS x_first, max(CASE WHEN r.i = st.i + {length - 1} THEN r.lag_7 END) AS x_last,
            sum(CASE WHEN r.i < st.i + {length} THEN CAST(r.lag_1 AS DOUBLE) END) AS x_sum,
            max(CASE WHEN r.i = st.i + {length} THEN r.value END) AS y_first, max(CASE WHEN r.i = st.i + {length + horizon - 1} THEN r.value END) AS y_last
          FROM st JOIN i r ON r.series_id = st.series_id {'AND r.split = st.split' if split else ''} AND r.i BETWEEN st.i AND st.i + {length + horizon - 1}
          GROUP BY ALL)
        SELECT series_id, {'split,' if split else ''} CAST(start_index AS INTEGER) AS start_index, CAST(x_rows AS INTEGER) AS x_rows,
          CAST(x_first AS DOUBLE) AS x_first, CAST(x_last AS DOUBLE) AS x_last, {rounded_sql(['x_sum'], 2)},
          CAST(y_first AS DOUBLE) AS y_first, CAST(y_last AS DOUBLE) AS y_last FROM j"""


@query("sequence_windows", "W01", _samples_sql(SHIPMENTS, "p2", 60, 5, 3, False))
def sequence_windows(spark, sf_dir):
    known = _lagged(daily_shipments(spark, sf_dir)).dropna(subset=_COLUMNS)
    return _flat(sequences.sliding_windows(known, _COLUMNS, length=60, horizon=5, stride=3), "start_index")


@query("sequence_split_windows", "W02", _samples_sql(DAILY, "p1", 60, 1, 1, True))
def sequence_split_windows(spark, sf_dir):
    samples = sequences.split_windows(_lagged(daily_orders(spark, sf_dir)), _COLUMNS, length=60, horizon=1)
    return _flat(samples, "split", "start_index")


@query(
    "sequence_latest_window",
    "W03",
    f"""WITH {SHIPMENTS}, {EVENTS}, u AS (SELECT * FROM p2 UNION ALL SELECT * FROM p3), {_LAGGED.format(table='u')},
        t AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY date DESC) AS k, count(*) OVER (PARTITION BY series_id) AS n FROM c),
        a AS (SELECT series_id, CAST(max(date) AS VARCHAR) AS end_date, max(CASE WHEN k = 60 THEN CAST(lag_1 AS DOUBLE) END) AS x_first,
                max(CASE WHEN k = 1 THEN CAST(lag_7 AS DOUBLE) END) AS x_last, sum(CAST(lag_1 AS DOUBLE)) AS x_sum
              FROM t WHERE k <= 60 AND n >= 60 GROUP BY 1)
        SELECT s.series_id, a.series_id IS NULL AS too_short, end_date, x_first, x_last, {rounded_sql(['x_sum'], 2)}
        FROM (SELECT DISTINCT series_id FROM u) s LEFT JOIN a ON a.series_id = s.series_id""",
)
def sequence_latest_window(spark, sf_dir):
    union = daily_shipments(spark, sf_dir).unionByName(daily_events(spark, sf_dir))
    latest, short = sequences.latest_window(_lagged(union), _COLUMNS, 60)
    flat = latest.select(
        "series_id",
        F.lit(False).alias("too_short"),
        F.col("end_date").cast("string").alias("end_date"),
        F.get(F.get("x", F.lit(0)), F.lit(0)).cast("double").alias("x_first"),
        F.get(F.element_at("x", -1), F.lit(1)).cast("double").alias("x_last"),
        F.aggregate("x", F.lit(0.0), lambda acc, r: acc + r[0].cast("double")).alias("x_sum"),
    )
    missing = short.select("series_id", F.lit(True).alias("too_short"))
    return rounded(flat, ["x_sum"], 2).unionByName(missing, allowMissingColumns=True)


@query(
    "sequence_context_target",
    "W04",
    f"""WITH {DAILY}, i AS (SELECT series_id, CAST(value AS FLOAT) AS v, row_number() OVER (PARTITION BY series_id ORDER BY date) - 1 AS i,
            count(*) OVER (PARTITION BY series_id) AS n FROM p1),
        st AS (SELECT series_id, i FROM i WHERE i % 30 = 0 AND i < n - 512 - 30),
        j AS (SELECT st.series_id, st.i AS start_index, sum(CASE WHEN r.i < st.i + 512 THEN CAST(r.v AS DOUBLE) END) AS context_sum,
            max(CASE WHEN r.i = st.i THEN r.v END) AS context_first, sum(CASE WHEN r.i >= st.i + 512 THEN CAST(r.v AS DOUBLE) END) AS target_sum,
            max(CASE WHEN r.i = st.i + 541 THEN r.v END) AS target_last
          FROM st JOIN i r ON r.series_id = st.series_id AND r.i BETWEEN st.i AND st.i + 541 GROUP BY 1, 2)
        SELECT series_id, CAST(start_index AS INTEGER) AS start_index, CAST(context_first AS DOUBLE) AS context_first,
          CAST(target_last AS DOUBLE) AS target_last, {rounded_sql(['context_sum', 'target_sum'], 2)} FROM j""",
)
def sequence_context_target(spark, sf_dir):
    def total(column):
        return F.aggregate(column, F.lit(0.0), lambda acc, v: acc + v.cast("double"))

    samples = sequences.context_target_samples(daily_orders(spark, sf_dir))
    flat = samples.select(
        "series_id",
        "start_index",
        F.get("context", F.lit(0)).cast("double").alias("context_first"),
        F.element_at("target", -1).cast("double").alias("target_last"),
        total("context").alias("context_sum"),
        total("target").alias("target_sum"),
    )
    return rounded(flat, ["context_sum", "target_sum"], 2)


@query(
    "sequence_aligned_truth",
    "W05",
    f"""WITH {SHIPMENTS}, i AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY date) AS i FROM p2)
        SELECT series_id, CAST(date AS VARCHAR) AS date, value, CAST(i - 59 AS INTEGER) AS step FROM i WHERE i >= 60""",
)
def sequence_aligned_truth(spark, sf_dir):
    return sequences.aligned_truth(daily_shipments(spark, sf_dir), 60).select("series_id", day(), "value", "step")
