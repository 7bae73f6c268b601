"""Target transforms and their inverses."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelloom.operators import targets
from panelloom.operators.cleaning import align_calendar
from panelloom.registered.catalog import day, query, rounded, rounded_sql, stable_sql
from panelloom.registered.panels import DAILY, SHIPMENTS, clean_sql, daily_orders, daily_shipments, shipment_ticks

_W = "(PARTITION BY series_id ORDER BY date)"
_RETURN = f"value / nullif(lag(value) OVER {_W}, 0) - 1"
_SIMPLE = f"(value - lag(value) OVER {_W}) / nullif(lag(value) OVER {_W}, 0)"


def _aligned(spark, sf_dir):
    """Supplier panel on its calendar, gaps left open."""
    return align_calendar(daily_shipments(spark, sf_dir), ticks=shipment_ticks(spark, sf_dir))


def _target_sql(expression: str, source: str = "aligned") -> str:
    return f"""WITH {SHIPMENTS}, {clean_sql('p2')}, t AS (SELECT series_id, date, {expression} AS target FROM {source})
        SELECT series_id, CAST(date AS VARCHAR) AS date, {rounded_sql(['target'], 8)} FROM t"""


def _clip_sql(x: str) -> str:
    return f"CASE WHEN ({x}) IS NOT NULL THEN least(greatest({x}, -0.5), 0.5) END"


def _target(df, method, **options):
    return rounded(targets.add_target(df, method, **options).select("series_id", day(), "target"), ["target"], 8)


@query("target_none", "T01", _target_sql("value"))
def target_none(spark, sf_dir):
    return _target(_aligned(spark, sf_dir), "none")


@query("target_log", "T02", _target_sql("CASE WHEN value IS NOT NULL THEN ln(greatest(value, 1e-8)) END"))
def target_log(spark, sf_dir):
    return _target(_aligned(spark, sf_dir), "log")


@query("target_return", "T03", _target_sql(_clip_sql(_SIMPLE)))
def target_return(spark, sf_dir):
    return _target(_aligned(spark, sf_dir), "return")


_PADDED = f"(SELECT series_id, date, last_value(value IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY date ROWS UNBOUNDED PRECEDING) AS value FROM aligned)"


@query("target_return_padded", "T03", _target_sql(_clip_sql(_SIMPLE), _PADDED))
def target_return_padded(spark, sf_dir):
    return _target(_aligned(spark, sf_dir), "return", pad=True)


@query("target_return_unclipped", "T03", _target_sql(_SIMPLE))
def target_return_unclipped(spark, sf_dir):
    return _target(_aligned(spark, sf_dir), "return", clip_at=None)


@query("target_log_return", "T04", _target_sql(_clip_sql(f"ln(value / lag(value) OVER {_W})")))
def target_log_return(spark, sf_dir):
    return _target(_aligned(spark, sf_dir), "log_return")


@query(
    "target_reference_price",
    "T05",
    f"""WITH {SHIPMENTS} SELECT series_id, value AS reference_price FROM p2
        QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY date DESC) = 1""",
)
def target_reference_price(spark, sf_dir):
    return targets.reference_prices(daily_shipments(spark, sf_dir))


@query(
    "target_inverse_level",
    "T06",
    f"WITH {SHIPMENTS} SELECT series_id, CAST(date AS VARCHAR) AS date, value AS plain, {stable_sql('exp(ln(greatest(value, 1e-8)))')} AS from_log FROM p2",
)
def target_inverse_level(spark, sf_dir):
    logged = targets.add_target(daily_shipments(spark, sf_dir), "log")
    plain = targets.invert_path(logged.withColumn("target", F.col("value")), "none").select("series_id", "date", F.col("price").alias("plain"))
    from_log = targets.invert_path(logged, "log").select("series_id", "date", F.col("price").alias("from_log"))
    return rounded(plain.join(from_log, ["series_id", "date"]), ["from_log"]).withColumn("date", F.col("date").cast("string"))


def _path_sql(step: str) -> str:
    """Prices rebuilt from unclipped returns and the first value are the values themselves."""
    return f"""WITH {DAILY}, t AS (SELECT series_id, date, value, {step} AS r FROM p1)
        SELECT series_id, CAST(date AS VARCHAR) AS date, {stable_sql('value', 2)} AS price FROM t WHERE r IS NOT NULL"""


def _path(spark, sf_dir, method):
    panel = daily_orders(spark, sf_dir)
    first = panel.groupBy("series_id").agg(F.min_by("value", "date").alias("reference_price"))
    returns = targets.add_target(panel, method, clip_at=None).filter(F.col("target").isNotNull()).join(first, "series_id")
    return rounded(targets.invert_path(returns, method).select("series_id", day(), "price"), ["price"], 2)


@query("target_inverse_return_path", "T07", _path_sql(_RETURN))
def target_inverse_return_path(spark, sf_dir):
    return _path(spark, sf_dir, "return")


@query("target_inverse_log_return_path", "T08", _path_sql(f"ln(value / lag(value) OVER {_W})"))
def target_inverse_log_return_path(spark, sf_dir):
    return _path(spark, sf_dir, "log_return")


@query(
    "target_inverse_one_step",
    "T09",
    f"""WITH {SHIPMENTS}, t AS (SELECT series_id, date, value, value / 1e6 AS p FROM p2)
        SELECT series_id, CAST(date AS VARCHAR) AS date, p AS from_none, {stable_sql('exp(p)', 8)} AS from_log,
          {stable_sql('value * (1 + p)')} AS from_return, {stable_sql('value * exp(p)')} AS from_log_return FROM t""",
)
def target_inverse_one_step(spark, sf_dir):
    p = F.col("value") / 1e6
    one = {f"from_{m}": targets.invert_one(p, F.col("value"), m) for m in targets.METHODS}
    df = daily_shipments(spark, sf_dir).select("series_id", day(), *[c.alias(n) for n, c in one.items()])
    return rounded(rounded(df, ["from_return", "from_log_return"]), ["from_log"], 8)


_STATS = ["mean", "std", "min", "max", "median", "skewness", "kurtosis"]


@query(
    "target_statistics",
    "T10",
    f"""WITH {SHIPMENTS}, t AS (SELECT series_id, date, {_clip_sql(_SIMPLE)} AS target FROM p2),
        s AS (SELECT series_id, count(target) AS n, avg(target) AS mean, stddev_samp(target) AS std, min(target) AS min, max(target) AS max,
                median(target) AS median, skewness(target) AS skewness, kurtosis(target) AS kurtosis FROM t GROUP BY 1)
        SELECT series_id, n, {rounded_sql(_STATS, 6)} FROM s""",
)
def target_statistics(spark, sf_dir):
    return rounded(targets.target_stats(targets.add_target(daily_shipments(spark, sf_dir), "return")), _STATS, 6)
