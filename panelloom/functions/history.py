"""Features of the next row from an array of the latest values, as column expressions.

They agree with the window features of ``operators.features``: a missing value keeps its place, and statistics leave
it out. The array is oldest first and bounded, so a step of a recursive forecast is a projection without any shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelloom.functions.calendar import calendar_columns
from panelloom.functions.numeric import ratio
from panelloom.operators.features import EWM_MIN_PERIODS


def last_n(values: Column, n: int | Column) -> Column:
    return F.slice(values, F.greatest(F.size(values) - n + 1, F.lit(1)), F.lit(n) if isinstance(n, int) else n)


def from_end(values: Column, k: int) -> Column:
    """The k-th value from the end (1 is the last), NULL when there is none."""
    return F.get(values, F.size(values) - k)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def mean(values: Column) -> Column:
    known = F.array_compact(values)
    return ratio(total(known), F.size(known).cast("double"))


def _state(**values: Column | float) -> Column:
    return F.struct(*[(F.lit(v) if isinstance(v, float) else v).alias(n) for n, v in values.items()])


def sample_std(values: Column) -> Column:
    """One pass over the array: a lambda that looked up the mean would work it out again for every element."""

    def add(acc: Column, x: Column) -> Column:
        n, apart = acc["n"] + 1, x - acc["mean"]
        centre = acc["mean"] + apart / n
        return F.when(x.isNull(), acc).otherwise(_state(n=n, mean=centre, squares=acc["squares"] + apart * (x - centre)))

    return F.aggregate(
        values, _state(n=0.0, mean=0.0, squares=0.0), add, lambda acc: F.when(acc["n"] > 1, F.sqrt(ratio(acc["squares"], acc["n"] - 1)))
    )


def median(values: Column) -> Column:
    known = F.array_compact(values)
    ordered, n = F.array_sort(known), F.size(known)
    low = F.get(ordered, F.floor((n - 1) / 2).cast("int"))
    return (low + F.get(ordered, F.floor(n / 2).cast("int"))) / 2


def changes(values: Column) -> Column:
    """Relative changes between neighbours."""
    n = F.greatest(F.size(values) - 1, F.lit(0))
    return F.zip_with(F.slice(values, F.lit(2), n), F.slice(values, F.lit(1), n), lambda now, before: ratio(now - before, before))


def change_over(values: Column, k: int) -> Column:
    before = from_end(values, k + 1)
    return ratio(from_end(values, 1) - before, before)


def direction_run(values: Column) -> Column:
    def extend(run: Column, change: Column) -> Column:
        sign = F.signum(change)
        return F.when(sign == F.signum(run), run + sign).otherwise(sign)

    return F.aggregate(changes(values), F.lit(None).cast("double"), extend)


def ewm_std(returns: Column, span: int) -> Column:
    """Bias-corrected weighted deviation in one pass: older sums fade, and pairs are summed as they arrive."""
    decay = 1 - 2 / (span + 1)

    def add(acc: Column, x: Column) -> Column:
        w, wx, wxx = (acc[c] * decay for c in ("w", "wx", "wxx"))
        pairs, spread = (acc[c] * decay**2 for c in ("pairs", "spread"))
        apart = wxx - 2 * x * wx + x * x * w
        faded = _state(n=acc["n"], w=w, wx=wx, wxx=wxx, pairs=pairs, spread=spread)
        joined = _state(n=acc["n"] + 1, w=w + 1, wx=wx + x, wxx=wxx + x * x, pairs=pairs + w, spread=spread + F.greatest(apart, F.lit(0.0)))
        return F.when(x.isNull(), faded).otherwise(joined)

    def finish(acc: Column) -> Column:
        return F.when(acc["n"] >= EWM_MIN_PERIODS, F.sqrt(ratio(acc["spread"], 2 * acc["pairs"])))

    return F.aggregate(returns, _state(n=0.0, w=0.0, wx=0.0, wxx=0.0, pairs=0.0, spread=0.0), add, finish)


STATISTICS = {"mean": mean, "std": sample_std, "min": F.array_min, "max": F.array_max, "median": median}


def needed_history(columns: Sequence[str]) -> int | None:
    """How many latest values the features of the next row and their partial update look at; None means all.

    Run lengths and weighted deviations reach back to the start of a series. A feature of unknown reach is an error: with
    one, tell ``forecast_state`` and ``forecast_recursive`` how many values to keep.
    """
    need, calendar = 1, calendar_columns(F.current_date())
    for name in columns:
        number = int(found[-1]) if (found := re.findall(r"\d+", name)) else None
        if name in calendar:
            continue
        if name.startswith(("volatility_ewm_", "consecutive_direction")):
            return None
        if number is None or not name.startswith(("lag_", "rolling_", "range_pct_", "volatility_", "return_", "momentum_")):
            raise ValueError(f"no rule for the values that feature {name!r} looks back on")
        if name.endswith("d_lag1"):
            number = int(name.split("_")[1][:-1])
        need = max(need, number + 1)
    return need + 1


def next_features(history: Column, date: Column, columns: Sequence[str]) -> dict[str, Column]:
    """Features of the row dated ``date`` whose value is not known yet. What needs that value is NULL."""
    calendar = calendar_columns(date)
    built = {}
    for name in columns:
        number = int(found[-1]) if (found := re.findall(r"\d+", name)) else None
        if name in calendar:
            built[name] = calendar[name]
        elif name.startswith("lag_"):
            built[name] = from_end(history, number)
        elif name.startswith("rolling_"):
            built[name] = STATISTICS[name.split("_")[1]](last_n(history, number))
        elif name.startswith("range_pct_"):
            low = F.array_min(last_n(history, number))
            built[name] = ratio(F.array_max(last_n(history, number)) - low, low)
        elif name.startswith("volatility_ewm_"):
            built[name] = ewm_std(changes(history), number)
        elif name.startswith("volatility_"):
            built[name] = sample_std(changes(last_n(history, number + 1)))
        elif name in ("return_1d_lag1", "return_5d_lag1"):
            built[name] = change_over(history, int(name.split("_")[1][:-1]))
        elif name.startswith("momentum_"):
            built[name] = F.signum(change_over(history, number))
        elif name == "consecutive_direction_lag1":
            built[name] = direction_run(history)
        else:
            built[name] = F.lit(None).cast("double")
    return built


def refreshed_features(history: Column, columns: Sequence[str]) -> dict[str, Column]:
    """The partial update after a value was appended: lags, rolling statistics, plain returns and volatility.

    All other columns are left as they were, and a column keeps its value where the history is too short.
    """
    past = last_n(F.slice(history, F.lit(1), F.greatest(F.size(history) - 1, F.lit(0))), F.size(history))
    built = {}
    for name in columns:
        number = int(found[-1]) if (found := re.findall(r"\d+", name)) else None
        old = F.col(name)
        if name.startswith("lag_"):
            built[name] = F.coalesce(from_end(past, number), old)
        elif name.startswith("rolling_"):
            kind = name.split("_")[1]
            if kind == "median":
                continue
            fresh = STATISTICS[kind](last_n(past, number))
            built[name] = F.coalesce(fresh, F.lit(0.0)) if kind == "std" else F.coalesce(fresh, old)
        elif name == "return_1d_lag1":
            built[name] = F.coalesce(change_over(past, 1), old)
        elif name.startswith("return_") and not name.endswith("_lag1"):
            built[name] = F.coalesce(change_over(history, number), old)
        elif name.startswith("volatility_") and not name.startswith("volatility_ewm"):
            built[name] = F.coalesce(sample_std(changes(last_n(past, number + 1))), old)
    return built
