"""Window frames over a panel.

A panel holds at most one row per series and day (``cleaning.dedupe_keep_last`` makes it so), hence a
window partition is bounded by the calendar, about 365 rows per year, no matter how many raw records a
series has. Logs and raw ticks have no such bound: see ``plans.hot_series``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

SERIES = ("series_id",)
#: Rows of a panel for one task; windows sort them after they unfold, which adaptive execution does not foresee.
TASK_ROWS = 1 << 19


def spread(df: DataFrame, rows: int, keys: Sequence[str] = SERIES, task_rows: int | None = None) -> DataFrame:
    """Partitions by key that hold about ``task_rows`` of the ``rows`` that ``df`` unfolds into, however many those are."""
    parts = -(-rows // (task_rows or TASK_ROWS))
    return df.repartition(max(parts, df.sparkSession.sparkContext.defaultParallelism), *keys) if parts > 1 else df


def spanned_days(df: DataFrame, keys: Sequence[str] = SERIES) -> int:
    """Days between the first and the last date of each series, summed up."""
    days = df.groupBy(*keys).agg((F.datediff(F.max("date"), F.min("date")) + 1).cast("bigint").alias("_days"))
    return days.agg(F.sum("_days")).first()[0] or 0


def series_sizes(df: DataFrame, keys: Sequence[str] = SERIES) -> tuple[int, int, int]:
    """Rows, ``spanned_days`` and the rows of the largest series, in one job."""
    days = F.datediff(F.max("date"), F.min("date")) + 1
    sizes = df.groupBy(*keys).agg(days.cast("bigint").alias("_days"), F.count(F.lit(1)).alias("_rows"))
    found = sizes.agg(F.sum("_rows"), F.sum("_days"), F.max("_rows")).first()
    return tuple(n or 0 for n in found)


def by_date(keys: Sequence[str] = SERIES, order: str | Sequence[str] = "date") -> WindowSpec:
    names = [order] if isinstance(order, str) else list(order)
    return Window.partitionBy(*keys).orderBy(*names)


def newest_first(keys: Sequence[str] = SERIES, order: str | Sequence[str] = "date") -> WindowSpec:
    names = [order] if isinstance(order, str) else list(order)
    return Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in names])


def running(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, 0)


def whole(w: WindowSpec) -> WindowSpec:
    """All rows of the partition, through the same sort as ``w`` so no second one is planned."""
    return w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def with_min_periods(value: Column, x: Column, frame: WindowSpec, minimum: int) -> Column:
    return F.when(F.count(x).over(frame) >= minimum, value)


def last_seen(x: Column, w: WindowSpec) -> Column:
    """Last non-null x up to and including the row."""
    return F.last(x, ignorenulls=True).over(running(w))
