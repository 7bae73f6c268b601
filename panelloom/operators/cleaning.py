"""Clean a panel: one row per day, no holes in the calendar, capped gap filling, outlier flags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.functions.calendar import is_weekend
from panelloom.functions.frames import SERIES, by_date, last_seen, newest_first, spanned_days, spread, whole, with_min_periods
from panelloom.functions.numeric import ratio

WEEKEND_SHARE_LIMIT = 0.10
FREQUENCIES = ("auto", "business", "calendar")
FILLS = ("ffill", "interpolate", "none")


def dedupe_keep_last(df: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """The last arrived row of each series and day; rows without a date go.

    A grouped ``max_by`` combines on the map side, so a series with a third of all ticks shuffles only one
    row per day and task.
    """
    rest = [c for c in df.columns if c not in (*keys, "date", "ingest_seq")]
    return (
        df.filter(F.col("date").isNotNull())
        .groupBy(*keys, "date")
        .agg(*[F.max_by(c, "ingest_seq").alias(c) for c in rest], F.max("ingest_seq").alias("ingest_seq"))
    )


def detect_frequency(panel: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """``calendar`` when more than a tenth of the days are weekend days, else ``business``."""
    share = F.avg(is_weekend(F.col("date")).cast("double"))
    return panel.groupBy(*keys).agg(
        share.alias("weekend_share"),
        F.when(share > WEEKEND_SHARE_LIMIT, "calendar").otherwise("business").alias("frequency"),
    )


def align_calendar(
    panel: DataFrame, frequency: str = "auto", keys: Sequence[str] = SERIES, ticks: DataFrame | None = None, dealt: bool = False
) -> DataFrame:
    """One row for every day (or every weekday) between the first and the last date; new rows have no value.

    Each row unfolds into the days up to the next one, so no calendar table and no join is needed. On a
    business calendar weekend observations are dropped. The days are counted first, so that the series are dealt over as
    many tasks as they need; ``ticks`` are the rows behind the panel, if the count is quicker there. A panel that is
    ``dealt`` by series over such tasks already is left there, and nothing is counted.
    """
    if frequency not in FREQUENCIES:
        raise ValueError(f"frequency must be one of {FREQUENCIES}")
    if not dealt:
        panel = spread(panel, spanned_days(panel if ticks is None else ticks, keys), keys)
    w = by_date(keys)
    date = F.col("date")
    share = F.avg(is_weekend(date).cast("double")).over(whole(w))
    business = {
        "auto": share <= WEEKEND_SHARE_LIMIT,
        "business": F.lit(True),
        "calendar": F.lit(False),
    }[frequency]
    until = F.coalesce(F.date_sub(F.lead("date").over(w), 1), date)
    unfolded = panel.select(*keys, "value", date.alias("_seen"), until.alias("_until"), business.alias("_business")).select(
        *keys, "value", "_seen", "_business", F.explode(F.sequence("_seen", "_until")).alias("date")
    )
    return unfolded.filter(~F.col("_business") | ~is_weekend(F.col("date"))).select(
        *keys, "date", F.when(F.col("date") == F.col("_seen"), F.col("value")).alias("value")
    )


def add_gap_columns(panel: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """``is_original`` and ``missing_streak``: how many missing rows in a row end here, 0 on originals."""
    w = by_date(keys)
    seen = F.col("value").isNotNull()
    place = F.row_number().over(w)
    numbered = panel.withColumns({"is_original": seen, "_place": place})
    last_original = last_seen(F.when(F.col("is_original"), F.col("_place")), w)
    return numbered.withColumn("missing_streak", F.col("_place") - F.coalesce(last_original, F.lit(0))).drop("_place")


def fill_gaps(panel: DataFrame, method: str = "ffill", max_gap: int = 10, keys: Sequence[str] = SERIES) -> DataFrame:
    """Fill missing values, at most ``max_gap`` rows into a gap, and flag them ``is_imputed``.

    ``interpolate`` is linear in row position; after the last value it repeats it.
    """
    if method not in FILLS:
        raise ValueError(f"fill method must be one of {FILLS}")
    value = F.col("value")
    if method == "none":
        return panel.withColumn("is_imputed", F.lit(False))
    w = by_date(keys)
    if method == "ffill":
        filled = panel.withColumn("_filled", last_seen(value, w))
    else:
        placed = panel.withColumn("_place", F.row_number().over(w))
        known = F.when(value.isNotNull(), F.struct(F.col("_place").alias("p"), value.alias("v")))
        # the next known value comes from a backward sort: a frame that ends at the last row would rescan it
        ends = placed.withColumn("_known", known).withColumns({"_left": last_seen(F.col("_known"), w)})
        ends = ends.withColumn("_right", last_seen(F.col("_known"), newest_first(keys)))
        share = ratio(F.col("_place") - F.col("_left.p"), (F.col("_right.p") - F.col("_left.p")).cast("double"))
        between = F.col("_left.v") + (F.col("_right.v") - F.col("_left.v")) * share
        filled = ends.withColumn(
            "_filled",
            F.when(value.isNotNull(), value).when(F.col("_right").isNull(), F.col("_left.v")).otherwise(between),
        ).drop("_place", "_known", "_left", "_right")
    capped = F.when(F.col("missing_streak") <= max_gap, F.col("_filled"))
    return (
        filled.withColumn("value", capped)
        .withColumn("is_imputed", ~F.col("is_original") & F.col("value").isNotNull())
        .drop("_filled")
    )


def flag_outliers(
    panel: DataFrame, window: int = 30, threshold: float = 4.0, min_periods: int = 10, keys: Sequence[str] = SERIES
) -> DataFrame:
    """Distance from the mean of a centred window in sample standard deviations; short series get no score."""
    w = by_date(keys)
    frame = w.rowsBetween(-(window // 2), window - window // 2 - 1)
    value = F.col("value")
    mean = with_min_periods(F.avg(value).over(frame), value, frame, min_periods)
    spread = with_min_periods(F.stddev_samp(value).over(frame), value, frame, min_periods)
    long_enough = F.count(F.lit(1)).over(whole(w)) >= window
    scored = panel.withColumn("z_score", F.when(long_enough, F.abs(ratio(value - mean, spread))))
    return scored.withColumn("is_outlier", F.coalesce(F.col("z_score") > threshold, F.lit(False)))


def clean(
    df: DataFrame,
    frequency: str = "auto",
    fill_method: str = "ffill",
    max_gap: int = 10,
    window: int = 30,
    threshold: float = 4.0,
    keys: Sequence[str] = SERIES,
    ticks: DataFrame | None = None,
    dealt: bool = False,
) -> DataFrame:
    """Dedupe, align, mark gaps, fill and flag. After the dedupe everything runs in one shuffle by series.

    ``ticks`` are the rows behind ``df``, if their days are counted quicker there; rows that are ``dealt`` by series over as
    many tasks as their days need are not shuffled again.
    """
    deduped = dedupe_keep_last(df.select(*keys, "date", "value", "ingest_seq"), keys)
    panel = align_calendar(deduped, frequency, keys, ticks=df if ticks is None else ticks, dealt=dealt)
    return flag_outliers(fill_gaps(add_gap_columns(panel, keys), fill_method, max_gap, keys), window, threshold, keys=keys)


def quality_summary(cleaned: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    total = F.count(F.lit(1))
    original, imputed = F.count_if("is_original"), F.count_if("is_imputed")
    return cleaned.groupBy(*keys).agg(
        total.alias("total_rows"),
        original.alias("original_rows"),
        imputed.alias("imputed_rows"),
        F.count_if(F.col("value").isNull()).alias("missing_rows"),
        F.count_if("is_outlier").alias("outlier_rows"),
        (original / total).alias("original_pct"),
        (imputed / total).alias("imputed_pct"),
        F.min("date").alias("start_date"),
        F.max("date").alias("end_date"),
    )
