"""The registered queries: a Spark callable, the same question in SQL, and the survey items it answers."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Registered:
    name: str
    items: tuple[str, ...]
    run: QueryFn
    sql: str | None


REGISTERED: dict[str, Registered] = {}


def query(name: str, items: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    """Register a query under ``name``; ``items`` are the survey ids it covers, separated by blanks."""

    def add(fn: QueryFn) -> QueryFn:
        if name in REGISTERED:
            raise ValueError(f"query {name} is registered twice")
        REGISTERED[name] = Registered(name, tuple(items.split()), fn, sql)
        return fn

    return add


def _nudge(digits: int) -> float:
    # the two engines round exact halves differently; a shift far above float noise decides them the same way
    return 3.1 * 10.0 ** -(digits + 2)


def stable(x: Column, digits: int = 4) -> Column:
    """Round for comparison across engines."""
    return F.round(x + _nudge(digits), digits)


def stable_sql(x: str, digits: int = 4) -> str:
    return f"(round(({x}) + {_nudge(digits):.12f}, {digits}) + 0.0)"


def rounded(df: DataFrame, columns: list[str], digits: int = 4) -> DataFrame:
    return df.withColumns({c: stable(F.col(c), digits) for c in columns})


def rounded_sql(columns: list[str], digits: int = 4) -> str:
    return ", ".join(f"{stable_sql(c, digits)} AS {c}" for c in columns)


def day(name: str = "date") -> Column:
    """A date as text, so both engines hand over the same type."""
    return F.col(name).cast("string").alias(name)
