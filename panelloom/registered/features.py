"""Window features."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelloom.functions.calendar import calendar_columns
from panelloom.functions.frames import by_date
from panelloom.functions.lookback import add_lookbacks
from panelloom.operators import features
from panelloom.operators.cleaning import align_calendar, clean
from panelloom.operators.filters import feature_columns
from panelloom.registered.catalog import day, query, rounded, rounded_sql
from panelloom.registered.panels import DAILY, EVENTS, SHIPMENTS, TICKS, clean_sql, daily_events, daily_orders, daily_shipments, dealt_shipments, order_ticks, shipment_ticks

_W = "w AS (PARTITION BY series_id ORDER BY date)"


def _open(spark, sf_dir):
    """Supplier panel on its calendar with its gaps left open, so windows meet missing values."""
    return align_calendar(daily_shipments(spark, sf_dir), ticks=shipment_ticks(spark, sf_dir))


def _feature_sql(columns: dict[str, str], round_to: dict[str, int], source: str = SHIPMENTS, table: str = "p2", stage: str = "aligned") -> str:
    inner = ", ".join(f"{e} AS {n}" for n, e in columns.items())
    outer = ", ".join(rounded_sql([n], round_to[n]) if n in round_to else n for n in columns)
    return f"""WITH {source}, {clean_sql(table)}, f AS (SELECT series_id, date, value, {inner} FROM {stage} WINDOW {_W})
        SELECT series_id, CAST(date AS VARCHAR) AS date, {outer} FROM f"""


_LAG = {f"lag_{k}": f"lag(value, {k}) OVER w" for k in features.LAGS}


@query("feature_lags", "G01", _feature_sql(_LAG, {}))
def feature_lags(spark, sf_dir):
    return _open(spark, sf_dir).withColumns(features.lag_features(by_date())).select("series_id", day(), *_LAG)


_AGG = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max", "median": "median"}


def _rolling_sql(stats):
    return {
        f"rolling_{s}_{n}": f"{_AGG[s]}(value) OVER (w ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)" for n in features.WINDOWS for s in stats
    }


_ROLL = _rolling_sql(features.STATS)
_ROLL_ROUND = {n: 3 for n in _ROLL if "mean" in n} | {n: 2 for n in _ROLL if "std" in n}


@query("feature_rolling", "G02 G03 G04 G05", _feature_sql(_ROLL, _ROLL_ROUND))
def feature_rolling(spark, sf_dir):
    df = features.add_rolling(_open(spark, sf_dir)).select("series_id", day(), *_ROLL)
    means, spreads = ([n for n in _ROLL if k in n] for k in ("mean", "std"))
    return rounded(rounded(df, means, 3), spreads, 2)


_MEDIAN = _rolling_sql(("median",))


@query("feature_rolling_median", "G06", _feature_sql(_MEDIAN, {n: 3 for n in _MEDIAN}, DAILY, "p1"))
def feature_rolling_median(spark, sf_dir):
    df = align_calendar(daily_orders(spark, sf_dir))
    return rounded(df.withColumns(features.rolling_features(by_date(), stats=("median",))).select("series_id", day(), *_MEDIAN), list(_MEDIAN), 3)


_CALENDAR = {
    "day_of_week": "CAST(isodow(date) - 1 AS INTEGER)",
    **{f"is_dow_{i}": f"CAST(isodow(date) = {i + 1} AS INTEGER)" for i in range(5)},
    "month": "CAST(month(date) AS INTEGER)",
    "week_of_year": "CAST(weekofyear(date) AS INTEGER)",
    "day_of_month": "CAST(day(date) AS INTEGER)",
    "is_month_start": "CAST(day(date) = 1 AS INTEGER)",
    "is_month_end": "CAST(date = last_day(date) AS INTEGER)",
    "is_quarter_start": "CAST(day(date) = 1 AND month(date) IN (1, 4, 7, 10) AS INTEGER)",
    "is_quarter_end": "CAST(date = last_day(date) AND month(date) IN (3, 6, 9, 12) AS INTEGER)",
    "year": "CAST(year(date) AS INTEGER)",
}


@query("feature_calendar", "G07 G08 G09 G10 G11 G12", _feature_sql(_CALENDAR, {}))
def feature_calendar(spark, sf_dir):
    return _open(spark, sf_dir).select("series_id", day(), *[c.alias(n) for n, c in calendar_columns(F.col("date")).items()])


def _change_sql(k: int) -> str:
    return f"(value - lag(value, {k}) OVER w) / nullif(lag(value, {k}) OVER w, 0)"


_RETURNS_CTE = f"""r AS (
  SELECT series_id, date, value, {_change_sql(1)} AS return_1d, {_change_sql(5)} AS return_5d, {_change_sql(20)} AS return_20d
  FROM {{stage}} WINDOW {_W})"""
_RETURNS = ["return_1d", "return_5d", "return_20d"]


def _on_returns_sql(columns: dict[str, str], round_to: int | None, source=SHIPMENTS, table="p2", stage="aligned") -> str:
    inner = ", ".join(f"{e} AS {n}" for n, e in columns.items())
    outer = rounded_sql(list(columns), round_to) if round_to else ", ".join(columns)
    return f"""WITH {source}, {clean_sql(table)}, {_RETURNS_CTE.format(stage=stage)},
        f AS (SELECT series_id, date, {inner} FROM r WINDOW {_W})
        SELECT series_id, CAST(date AS VARCHAR) AS date, {outer} FROM f"""


def _with_returns(df):
    return df.withColumns(features.return_features(by_date()))


_VOL = {f"volatility_{n}": f"stddev_samp(return_1d) OVER (w ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)" for n in features.VOLATILITY_WINDOWS}


@query("feature_volatility", "G13", _on_returns_sql(_VOL, 6))
def feature_volatility(spark, sf_dir):
    df = add_lookbacks(_with_returns(_open(spark, sf_dir)), features.lookback_volatility())
    return rounded(df.select("series_id", day(), *_VOL), list(_VOL), 6)


# half the weighted mean of squared differences over all pairs, weights (13/15)^age on the scale of a middle row;
# a missing return ages the weights but has none itself
_EWM = """n AS (
  SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY date) - 1200 AS p FROM r),
o AS (SELECT * FROM n WHERE return_1d IS NOT NULL),
pairs AS (
  SELECT j.series_id, j.p, sum(pow(15.0 / 13.0, i.p + j.p)) AS a, sum(pow(15.0 / 13.0, i.p + j.p) * (i.return_1d - j.return_1d) ** 2) AS b
  FROM o i JOIN o j ON i.series_id = j.series_id AND i.p < j.p GROUP BY 1, 2),
v AS (
  SELECT n.series_id, n.date, count(n.return_1d) OVER w AS k, sum(a) OVER w AS a, sum(b) OVER w AS b
  FROM n LEFT JOIN pairs ON pairs.series_id = n.series_id AND pairs.p = n.p
  WINDOW w AS (PARTITION BY n.series_id ORDER BY n.p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT series_id, date, CASE WHEN k >= 7 THEN sqrt(b / nullif(2 * a, 0)) END AS volatility_ewm_14 FROM v)"""


def _ewm_sql(source, table):
    return f"""WITH {source}, {clean_sql(table)}, {_RETURNS_CTE.format(stage='aligned')}, {_EWM}
        SELECT series_id, CAST(date AS VARCHAR) AS date, {rounded_sql(['volatility_ewm_14'], 6)} FROM f"""


def _ewm(panel, ticks=None):
    df = features.add_ewm_volatility(_with_returns(align_calendar(panel, ticks=ticks)))
    return rounded(df.select("series_id", day(), "volatility_ewm_14"), ["volatility_ewm_14"], 6)


@query("feature_ewm_volatility", "G14", _ewm_sql(DAILY, "p1"))
def feature_ewm_volatility(spark, sf_dir):
    return _ewm(daily_orders(spark, sf_dir))


@query("feature_ewm_volatility_gaps", "G14", _ewm_sql(SHIPMENTS, "p2"))
def feature_ewm_volatility_gaps(spark, sf_dir):
    return _ewm(daily_shipments(spark, sf_dir), shipment_ticks(spark, sf_dir))


_RANGE = {
    f"range_pct_{n}": f"(max(value) OVER f{n} - min(value) OVER f{n}) / nullif(min(value) OVER f{n}, 0)".replace(
        f"OVER f{n}", f"OVER (w ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    )
    for n in features.RANGE_WINDOWS
}


@query("feature_range", "G15", _feature_sql(_RANGE, {n: 6 for n in _RANGE}))
def feature_range(spark, sf_dir):
    df = _open(spark, sf_dir).withColumns(features.range_features(by_date()))
    return rounded(df.select("series_id", day(), *_RANGE), list(_RANGE), 6)


@query("feature_returns", "G16", _on_returns_sql({n: n for n in _RETURNS}, 6))
def feature_returns(spark, sf_dir):
    return rounded(_with_returns(_open(spark, sf_dir)).select("series_id", day(), *_RETURNS), _RETURNS, 6)


_LAGGED = {
    "return_1d_lag1": "lag(return_1d) OVER w",
    "return_5d_lag1": "lag(return_5d) OVER w",
    "momentum_5d": "CAST(sign(lag(return_5d) OVER w) AS DOUBLE)",
    "momentum_20d": "CAST(sign(lag(return_20d) OVER w) AS DOUBLE)",
}


@query("feature_lagged_returns_momentum", "G17 G18", _on_returns_sql(_LAGGED, 6))
def feature_lagged_returns_momentum(spark, sf_dir):
    df = _with_returns(_open(spark, sf_dir)).withColumns(features.lagged_return_features(by_date()))
    return rounded(df.select("series_id", day(), *_LAGGED), list(_LAGGED), 6)


def _runs_sql(source, table, stage):
    return f"""WITH {source}, {clean_sql(table)}, {_RETURNS_CTE.format(stage=stage)},
        g AS (SELECT *, sign(return_1d) AS s FROM r),
        b AS (SELECT *, CASE WHEN s = lag(s) OVER w THEN 0 ELSE 1 END AS starts FROM g WINDOW {_W}),
        i AS (SELECT *, sum(starts) OVER w AS run FROM b WINDOW {_W}),
        c AS (SELECT series_id, date, CAST(row_number() OVER (PARTITION BY series_id, run ORDER BY date) * s AS DOUBLE) AS consecutive_direction FROM i)
        SELECT series_id, CAST(date AS VARCHAR) AS date, consecutive_direction,
          lag(consecutive_direction) OVER (PARTITION BY series_id ORDER BY date) AS consecutive_direction_lag1 FROM c"""


@query("feature_direction_runs", "G19 G20", _runs_sql(SHIPMENTS, "p2", "cleaned"))
def feature_direction_runs(spark, sf_dir):
    df = features.add_direction_run(_with_returns(clean(daily_shipments(spark, sf_dir), ticks=shipment_ticks(spark, sf_dir))))
    return df.select("series_id", day(), "consecutive_direction", "consecutive_direction_lag1")


@query(
    "feature_short_series",
    "G21",
    f"""WITH {EVENTS}, s AS (SELECT series_id, date, value FROM p3 QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY date) = 1)
        SELECT series_id, CAST(date AS VARCHAR) AS date, value, CAST(0 AS INTEGER) AS known_features, CAST(39 AS INTEGER) AS empty_features FROM s""",
)
def feature_short_series(spark, sf_dir):
    """Each series cut down to its first row: all window columns are there and empty."""
    firsts = daily_events(spark, sf_dir).groupBy("series_id").agg(F.min_by("value", "date").alias("value"), F.min("date").alias("date"))
    df = features.generate(firsts, calendar=False)
    names = feature_columns(df, leak_safe=False)
    known = sum((F.col(n).isNotNull().cast("int") for n in names), F.lit(0))
    return df.select("series_id", day(), "value", known.alias("known_features"), (F.lit(len(names)) - known).alias("empty_features"))


_MATRIX = ["lag_1", "lag_30", "rolling_mean_7", "volatility_14", "return_5d_lag1"]


@query(
    "feature_matrix",
    "G22 F03 F04",
    f"""WITH {TICKS}, {clean_sql('p0')}, {_RETURNS_CTE.format(stage='cleaned')},
        f AS (SELECT series_id, date, value AS label, lag(value, 1) OVER w AS lag_1, lag(value, 30) OVER w AS lag_30,
          avg(value) OVER (w ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS rolling_mean_7,
          stddev_samp(return_1d) OVER (w ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING) AS volatility_14,
          lag(return_5d) OVER w AS return_5d_lag1 FROM r WINDOW {_W})
        SELECT series_id, CAST(date AS VARCHAR) AS date, label, {rounded_sql(_MATRIX)} FROM f
        WHERE label IS NOT NULL AND lag_1 IS NOT NULL AND lag_30 IS NOT NULL AND rolling_mean_7 IS NOT NULL AND volatility_14 IS NOT NULL
          AND return_5d_lag1 IS NOT NULL""",
)
def feature_matrix(spark, sf_dir):
    df = features.generate(clean(order_ticks(spark, sf_dir)))
    matrix = features.feature_matrix(df, [c for c in feature_columns(df) if c in _MATRIX])
    return rounded(matrix, _MATRIX).withColumn("date", F.col("date").cast("string"))


_ALL = {
    **_LAG,
    **{n: e for n, e in _ROLL.items()},
    **_VOL,
    **_RANGE,
    **_LAGGED,
}


_RUNS = ["consecutive_direction", "consecutive_direction_lag1"]
_FULL_ITEMS = "G01 G02 G03 G04 G05 G07 G08 G09 G10 G11 G12 G13 G14 G15 G16 G17 G18 G19 G20"


def _full_sql(source: str, table: str) -> str:
    """Every feature of the default set: one window each, weighted deviations by pairs and runs by islands beside them."""
    runs = f"""WITH g AS (SELECT *, sign(return_1d) AS s FROM r),
  b AS (SELECT *, CASE WHEN s = lag(s) OVER w THEN 0 ELSE 1 END AS starts FROM g WINDOW {_W}),
  i AS (SELECT *, sum(starts) OVER w AS run FROM b WINDOW {_W}),
  c AS (SELECT series_id, date, CAST(row_number() OVER (PARTITION BY series_id, run ORDER BY date) * s AS DOUBLE) AS consecutive_direction FROM i)
  SELECT *, lag(consecutive_direction) OVER (PARTITION BY series_id ORDER BY date) AS consecutive_direction_lag1 FROM c"""
    inner = ", ".join(f"{e} AS {n}" for n, e in {**_ALL, **_CALENDAR}.items())
    return f"""WITH {source}, {clean_sql(table)}, {_RETURNS_CTE.format(stage='cleaned')},
        al AS (SELECT series_id, date, return_1d, return_5d, return_20d, {inner} FROM r WINDOW {_W}), ew AS (WITH {_EWM} SELECT * FROM f), ru AS ({runs})
        SELECT al.series_id, CAST(al.date AS VARCHAR) AS date, {rounded_sql([*_ALL, *_RETURNS, 'volatility_ewm_14'], 2)}, {', '.join(_CALENDAR)}, {', '.join(_RUNS)}
        FROM al JOIN ew ON ew.series_id = al.series_id AND ew.date = al.date JOIN ru ON ru.series_id = al.series_id AND ru.date = al.date"""


def _full_set(panel, ticks=None, dealt=False):
    df = features.generate(clean(panel, ticks=ticks, dealt=dealt))
    numbers = [*_ALL, *_RETURNS, "volatility_ewm_14"]
    return rounded(df.select("series_id", day(), *numbers, *_CALENDAR, *_RUNS), numbers, 2)


@query("feature_full_set", _FULL_ITEMS, _full_sql(TICKS, "p0"))
def feature_full_set(spark, sf_dir):
    """The whole default feature set in one plan."""
    return _full_set(order_ticks(spark, sf_dir))


@query("feature_full_set_wide", _FULL_ITEMS, _full_sql(SHIPMENTS, "p2"))
def feature_full_set_wide(spark, sf_dir):
    """The whole default feature set of all supplier series."""
    panel, dealt = dealt_shipments(spark, sf_dir)
    return _full_set(panel, shipment_ticks(spark, sf_dir), dealt)
