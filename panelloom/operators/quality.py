"""Data-quality checks on raw ticks: one row per series and check.

The input has the raw panel schema (``series_id, date, value, ingest_seq, date_text, value_text``). Rows per
series have no bound here, so counts use map-side combining and the two order-dependent checks cut a series
into blocks or chunks (``plans.hot_series``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelloom.functions.calendar import is_weekend, weekdays_between
from panelloom.functions.frames import SERIES, with_min_periods
from panelloom.functions.numeric import ratio
from panelloom.plans.hot_series import BLOCK_ROWS, CHUNK_ROWS, sequence_block, with_halo, with_row_index

# Check names in the order they run.
CHECKS = (
    "required_columns",
    "date_parseable",
    "date_unique",
    "date_chronological",
    "close_numeric",
    "close_positive",
    "close_not_null",
    "missing_dates",
    "outliers",
    "min_history",
)
REQUIRED = ("date", "value")


class ValidationError(ValueError):
    """Raised on request when a series fails an error-severity check."""


#: One check of a series: its place in the order, verdict, severity and what was counted.
CHECK = "struct<check_index:int,check_name:string,passed:boolean,severity:string,message:string,details:map<string,string>>"


def _check(name: str, passed: Column, severity: str | Column, message: Column, details: dict[str, Column] | None = None) -> Column:
    pairs = [part for key, value in (details or {}).items() for part in (F.lit(key), value.cast("string"))]
    made = F.struct(
        F.lit(CHECKS.index(name)).alias("check_index"),
        F.lit(name).alias("check_name"),
        passed.alias("passed"),
        (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"),
        message.alias("message"),
        (F.create_map(*pairs) if pairs else F.create_map()).cast("map<string,string>").alias("details"),
    )
    return made.cast(CHECK)


def _listed(df: DataFrame, *checks: Column) -> DataFrame:
    """A row for each series and check."""
    return df.select("series_id", F.inline(F.array(*checks)))


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _required(df: DataFrame) -> Column:
    missing = [c for c in REQUIRED if c not in df.columns]
    message = F.lit(f"missing columns: {', '.join(missing)}" if missing else "all required columns are there")
    return _check("required_columns", F.lit(not missing), "error", message)


def required_columns(df: DataFrame) -> DataFrame:
    return _listed(df.select("series_id").distinct(), _required(df))


def day_counts(df: DataFrame) -> DataFrame:
    """Counts per series and day: all that the checks need that do not depend on the order of rows."""
    value = F.col("value")
    bad = F.col("value_text").isNotNull() & value.isNull() if "value_text" in df.columns else F.lit(False)
    return df.groupBy("series_id", "date").agg(
        F.count(F.lit(1)).alias("rows_on_day"),
        F.count_if(bad).alias("bad_numbers"),
        F.count_if(value < 0).alias("negative_values"),
        F.count_if(value.isNull()).alias("null_values"),
    )


def row_counts(days: DataFrame) -> DataFrame:
    """One row per series from its ``day_counts``: the numbers behind all checks but the two on order."""
    d, rows = F.col("date"), F.col("rows_on_day")
    return days.groupBy("series_id").agg(
        F.sum(rows).alias("n_rows"),
        F.sum(F.when(d.isNull(), rows).otherwise(0)).alias("bad_dates"),
        *[F.sum(c).alias(c) for c in ("bad_numbers", "negative_values", "null_values")],
        F.sum(rows - 1).alias("repeated"),
        # at most one entry per calendar day
        F.slice(F.array_sort(F.collect_list(F.when(rows > 1, d))), 1, 10).alias("repeated_days"),
        F.count_if(~is_weekend(d)).alias("weekdays_seen"),
        weekdays_between(F.min(d), F.max(d)).alias("weekdays_expected"),
        F.min(d).alias("start_date"),
        F.max(d).alias("end_date"),
    )


def _date_parseable() -> Column:
    n = F.col("bad_dates")
    return _check("date_parseable", n == 0, "error", _text(n, " dates cannot be parsed"), {"invalid_count": n})


def _date_unique() -> Column:
    n = F.col("repeated")
    listed = F.array_join(F.col("repeated_days").cast("array<string>"), ",")
    return _check("date_unique", n == 0, "error", _text(n, " rows repeat a date"), {"duplicate_count": n, "duplicate_dates": listed})


def _close_numeric() -> Column:
    n = F.col("bad_numbers")
    return _check("close_numeric", n == 0, "error", _text(n, " values are not numbers"), {"invalid_count": n})


def _close_positive() -> Column:
    n = F.col("negative_values")
    return _check("close_positive", n == 0, "error", _text(n, " values are negative"), {"negative_count": n})


def _close_not_null() -> Column:
    n = F.col("null_values")
    return _check("close_not_null", n == 0, "error", _text(n, " values are missing"), {"null_count": n, "null_pct": n / F.col("n_rows")})


def _missing_dates(max_missing_pct: float) -> Column:
    expected = F.col("weekdays_expected")
    missing = F.when(F.col("n_rows") >= 2, expected - F.col("weekdays_seen")).otherwise(0)
    share = F.coalesce(ratio(missing.cast("double"), expected), F.lit(0.0))
    details = {"missing_count": missing, "missing_pct": share, "threshold": F.lit(max_missing_pct)}
    return _check("missing_dates", share <= max_missing_pct, "warning", _text(missing, " weekdays are missing"), details)


def _min_history(minimum: int) -> Column:
    n = F.col("n_rows")
    return _check("min_history", n >= minimum, "warning", _text(n, f" rows, {minimum} wanted"), {"record_count": n, "required": F.lit(minimum)})


def date_parseable(counts: DataFrame) -> DataFrame:
    return _listed(counts, _date_parseable())


def date_unique(counts: DataFrame) -> DataFrame:
    """Rows beyond the first of each date; a missing date counts as one date."""
    return _listed(counts, _date_unique())


def close_numeric(counts: DataFrame) -> DataFrame:
    return _listed(counts, _close_numeric())


def close_positive(counts: DataFrame) -> DataFrame:
    """Zero passes."""
    return _listed(counts, _close_positive())


def close_not_null(counts: DataFrame) -> DataFrame:
    return _listed(counts, _close_not_null())


def missing_dates(counts: DataFrame, max_missing_pct: float = 0.05) -> DataFrame:
    """Weekdays between the first and last date that were not observed; weekend days do not count."""
    return _listed(counts, _missing_dates(max_missing_pct))


def min_history(counts: DataFrame, minimum: int = 252) -> DataFrame:
    return _listed(counts, _min_history(minimum))


def order_counts(df: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``series_id, unordered``: dates that fall in arrival order or are missing.

    Each block of arrivals is checked alone, then block against block.
    """
    blocks = df.select("series_id", "date", "ingest_seq", sequence_block("ingest_seq", block_rows).alias("block"))
    inside = Window.partitionBy("series_id", "block").orderBy("ingest_seq")
    along = Window.partitionBy("series_id").orderBy("block")
    summary = (
        blocks.withColumn("_earlier", F.lag("date").over(inside))
        .groupBy("series_id", "block")
        .agg(
            F.count_if((F.col("date") < F.col("_earlier")) | F.col("date").isNull()).alias("steps_back"),
            F.min_by("date", "ingest_seq").alias("first_date"),
            F.max_by("date", "ingest_seq").alias("last_date"),
            F.count(F.lit(1)).alias("rows"),
        )
        .withColumn("_before", F.lag("last_date").over(along))
    )
    falls = F.coalesce(F.col("first_date") < F.col("_before"), F.lit(False)).cast("int")
    return summary.groupBy("series_id").agg(F.sum(F.col("steps_back") + falls).alias("unordered"), F.sum("rows").alias("n_rows"))


def _date_chronological() -> Column:
    n = F.col("unordered")
    return _check("date_chronological", (n == 0) | (F.col("n_rows") < 2), "warning", _text(n, " rows are out of order"), {"out_of_order": n})


def date_chronological(df: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Dates never fall in arrival order."""
    return _listed(order_counts(df, block_rows), _date_chronological())


def outlier_rows(
    df: DataFrame, threshold: float = 4.0, window: int = 30, min_periods: int = 10, chunk_rows: int = CHUNK_ROWS, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Every row with a value, its trailing z-score (the row included) and the flag."""
    known = df.filter(F.col("value").isNotNull()).select("series_id", "date", "value", "ingest_seq")
    # rows without a date sort first, and equal dates keep arrival order
    numbered = with_row_index(known, SERIES, ["date", "ingest_seq"], block_rows=block_rows)
    frame = Window.partitionBy("series_id", "chunk").orderBy("row_index").rowsBetween(-(window - 1), 0)
    value = F.col("value")
    mean = with_min_periods(F.avg(value).over(frame), value, frame, min_periods)
    spread = with_min_periods(F.stddev_samp(value).over(frame), value, frame, min_periods)
    scored = with_halo(numbered, window - 1, chunk_rows=chunk_rows).withColumn("z_score", F.abs(ratio(value - mean, spread)))
    return (
        scored.filter("is_own")
        .withColumn("is_outlier", F.coalesce(F.col("z_score") > threshold, F.lit(False)))
        .drop("chunk", "is_own")
    )


def outlier_counts(df: DataFrame, threshold: float = 4.0, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``series_id, flagged, flagged_days`` (the first five in order) of the series with a flagged row."""
    flagged = outlier_rows(df, threshold, chunk_rows=chunk_rows).filter("is_outlier")
    first = Window.partitionBy("series_id").orderBy("row_index")
    placed = flagged.select("series_id", "row_index", "date", F.row_number().over(first).alias("_place"))
    day = F.when(F.col("_place") <= 5, F.struct("row_index", "date"))
    days = F.transform(F.array_sort(F.collect_list(day)), lambda s: s["date"])
    return placed.groupBy("series_id").agg(F.count(F.lit(1)).alias("flagged"), days.alias("flagged_days"))


def _outliers() -> Column:
    enough = F.col("n_rows") >= 30
    n = F.when(enough, F.coalesce(F.col("flagged"), F.lit(0))).otherwise(F.lit(0))
    listed = F.when(enough, F.array_join(F.col("flagged_days").cast("array<string>"), ","))
    severity = F.when(enough, "warning").otherwise("info")
    details = {"outlier_count": n, "outlier_dates": F.coalesce(listed, F.lit(""))}
    return _check("outliers", F.lit(True), severity, _text(n, " possible outliers"), details)


def outliers(df: DataFrame, threshold: float = 4.0, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Always passes; the count and the first five days are in the details."""
    sizes = df.groupBy("series_id").agg(F.count(F.lit(1)).alias("n_rows"))
    return _listed(sizes.join(outlier_counts(df, threshold, chunk_rows), "series_id", "left"), _outliers())


def check_table(
    df: DataFrame, max_missing_pct: float = 0.05, outlier_threshold: float = 4.0, minimum_rows: int = 252, fail_fast: bool = False
) -> DataFrame:
    """``series_id, n_rows, start_date, end_date, checks`` of every series, ``checks`` an array in the order of ``CHECKS``.

    One aggregate by day and series feeds the eight checks on counts, two plans by blocks and chunks the two on order;
    the three tables meet by series, where each already stands. With ``fail_fast`` a series keeps its checks up to the
    first failed one of error severity.
    """
    counts = row_counts(day_counts(df))
    found = counts.join(order_counts(df).drop("n_rows"), "series_id").join(outlier_counts(df, outlier_threshold), "series_id", "left")
    checks = F.array(
        _required(df),
        _date_parseable(),
        _date_unique(),
        _date_chronological(),
        _close_numeric(),
        _close_positive(),
        _close_not_null(),
        _missing_dates(max_missing_pct),
        _outliers(),
        _min_history(minimum_rows),
    )
    table = found.select("series_id", "n_rows", "start_date", "end_date", checks.alias("checks"))
    if not fail_fast:
        return table
    stops = F.array_position(F.transform("checks", lambda c: ~c["passed"] & (c["severity"] == "error")), True)
    return table.withColumn("checks", F.when(stops > 0, F.slice("checks", F.lit(1), stops.cast("int"))).otherwise(F.col("checks")))


def run_checks(df: DataFrame, **options) -> DataFrame:
    """A row for each series and check of ``check_table``. Without the required columns only that check is reported."""
    if any(c not in df.columns for c in REQUIRED):
        return required_columns(df)
    return check_table(df, **options).select("series_id", F.inline("checks"))


def _verdict() -> dict[str, Column]:
    """The report columns of an array of checks."""
    failed = F.filter("checks", lambda c: ~c["passed"])
    lines = F.transform(failed, lambda c: _text(c["severity"], ": ", c["check_name"], ", ", c["message"]))
    errors = F.size(F.filter(failed, lambda c: c["severity"] == "error")).cast("bigint")
    return {
        "passed": errors == 0,
        "n_checks": F.size("checks").cast("bigint"),
        "error_count": errors,
        "warning_count": F.size(F.filter(failed, lambda c: c["severity"] == "warning")).cast("bigint"),
        "summary": F.array_join(lines, "; "),
    }


def report(checks: DataFrame) -> DataFrame:
    """Per series: passed unless an error-severity check failed, counts of failures, and a summary text."""
    names = ["check_index", "check_name", "passed", "severity", "message"]
    gathered = checks.groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct(*names))).alias("checks"))
    return gathered.select("series_id", *[c.alias(n) for n, c in _verdict().items()])


def validate(df: DataFrame, raise_on_failure: bool = False, **options) -> DataFrame:
    """The report; with ``raise_on_failure`` this runs it and raises if any series fails.

    The error counts all failed series and names some; the report lists them all.
    """
    if any(c not in df.columns for c in REQUIRED):
        summary = report(required_columns(df))
    else:
        summary = check_table(df, **options).select("series_id", *[c.alias(n) for n, c in _verdict().items()])
    if raise_on_failure:
        failed = summary.filter(~F.col("passed"))
        if total := failed.count():
            names = "; ".join(f"{r['series_id']} ({r['summary']})" for r in failed.orderBy("series_id").limit(20).collect())
            more = f"; the first 20 of {total} failed series by id, see the report for all" if total > 20 else ""
            raise ValidationError(names + more)
    return summary


def validity_table(df: DataFrame, catalog: DataFrame, **options) -> DataFrame:
    """Every catalog series with rows, date span and verdict; a series without data is there and not valid."""
    found = check_table(df, **options).select("series_id", "n_rows", "start_date", "end_date", _verdict()["passed"].alias("valid"))
    joined = catalog.join(found, "series_id", "left")
    return joined.withColumns({"n_rows": F.coalesce("n_rows", F.lit(0)), "valid": F.coalesce("valid", F.lit(False))})
