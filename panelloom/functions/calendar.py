"""Calendar arithmetic on date columns, all closed form (no day-by-day loops, no calendar join)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SATURDAY = 5  # F.weekday counts from Monday = 0


def is_weekend(d: Column) -> Column:
    return F.weekday(d) >= SATURDAY


def next_business_day(d: Column) -> Column:
    """The date itself on Monday to Friday, the following Monday on a weekend."""
    return F.date_add(d, F.greatest(F.lit(7) - F.weekday(d), F.lit(0)) * is_weekend(d).cast("int"))


def business_day_after(d: Column, k: Column) -> Column:
    """The k-th Monday-to-Friday date strictly after d (k >= 1)."""
    slot = F.least(F.weekday(d), F.lit(4)) + k
    weeks = F.floor(slot / 5).cast("int")
    return F.date_add(F.trunc(d, "week").cast("date"), weeks * 7 + slot % 5)


def business_days_after(d: Column, count: int) -> Column:
    """Array of the next ``count`` Monday-to-Friday dates after d."""
    return F.transform(F.sequence(F.lit(1), F.lit(count)), lambda k: business_day_after(d, k))


def weekdays_between(start: Column, end: Column) -> Column:
    """How many Monday-to-Friday dates lie in [start, end]."""

    def up_to(d: Column) -> Column:
        days = F.datediff(d, F.lit("1900-01-01").cast("date"))  # a Monday
        return F.floor(days / 7) * 5 + F.least(F.pmod(days, F.lit(7)) + 1, F.lit(5))

    return (up_to(end) - up_to(F.date_sub(start, 1))).cast("bigint")


def calendar_columns(d: Column) -> dict[str, Column]:
    """The fourteen calendar features of a date."""
    quarter = F.trunc(d, "quarter")
    columns = {"day_of_week": F.weekday(d)}
    columns |= {f"is_dow_{i}": (F.weekday(d) == i).cast("int") for i in range(5)}
    columns |= {
        "month": F.month(d),
        "week_of_year": F.weekofyear(d),
        "day_of_month": F.dayofmonth(d),
        "is_month_start": (F.dayofmonth(d) == 1).cast("int"),
        "is_month_end": (d == F.last_day(d)).cast("int"),
        "is_quarter_start": (d == quarter).cast("int"),
        "is_quarter_end": (d == F.last_day(F.add_months(quarter, 2))).cast("int"),
        "year": F.year(d),
    }
    return columns
