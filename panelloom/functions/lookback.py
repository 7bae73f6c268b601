"""Statistics of the rows before a row, all of them in one pass over the sorted panel.

A sliding window frame adds up its rows anew for every row, one at a time. Here numpy shifts whole Arrow batches of rows
instead; sums still run from the oldest row to the newest, as those of a frame do. Missing values are left out, and a
weighted deviation keeps constant state per series, so nothing but the last rows of a batch is carried to the next.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelloom.functions.frames import SERIES, by_date

STATS = ("mean", "std", "min", "max")


@dataclass(frozen=True)
class Lookback:
    """``stat`` of ``source`` in the ``rows`` rows before; for ``ewm`` that is the span, and ``least`` the values it takes."""

    source: str
    stat: str
    rows: int
    least: int = 1


class _Frames:
    """Shifted rows of one source column; rows of another series count as missing."""

    def __init__(self, reach: int):
        self.reach = reach
        self.values, self.known = np.zeros(reach), np.zeros(reach, dtype=bool)

    def statistics(self, place: np.ndarray, values: np.ndarray, known: np.ndarray, wanted: set[tuple[str, int]]):
        values, known = np.concatenate([self.values, values]), np.concatenate([self.known, known])
        shifted = {}
        for k in range(1, self.reach + 1):
            here = slice(self.reach - k, len(values) - k)
            there = known[here] & (place > k)
            shifted[k] = there, np.where(there, values[here], 0.0)
        counts, found = np.zeros(len(place)), {}
        low, high = np.full(len(place), np.nan), np.full(len(place), -np.inf)
        lows, highs = (any(s == kind for s, _ in wanted) for kind in ("min", "max"))
        sizes = {n for _, n in wanted}
        for k in range(1, self.reach + 1):
            there, x = shifted[k]
            counts = counts + there
            if lows:
                low = np.fmin(low, np.where(there, x, np.nan))  # NaN is the greatest number, as in Spark
            if highs:
                high = np.maximum(high, np.where(there, x, -np.inf))
            if k in sizes:
                found |= {("min", k): (low, counts > 0), ("max", k): (high, counts > 0)}
                if ("mean", k) in wanted:
                    found["mean", k] = self._mean(shifted, k, counts)
                if ("std", k) in wanted:
                    found["std", k] = self._deviation(shifted, k, counts)
        self.values, self.known = values[len(values) - self.reach :], known[len(known) - self.reach :]
        return {w: pa.array(found[w][0], mask=~found[w][1]) for w in wanted}

    @staticmethod
    def _mean(shifted, rows: int, counts: np.ndarray):
        total = np.zeros(len(counts))
        for k in range(rows, 0, -1):
            total += shifted[k][1]
        return total / np.maximum(counts, 1.0), counts > 0

    @staticmethod
    def _deviation(shifted, rows: int, counts: np.ndarray):
        n, centre, squares = (np.zeros(len(counts)) for _ in range(3))
        for k in range(rows, 0, -1):
            there, x = shifted[k]
            n += there
            apart = (x - centre) * there
            step = apart / np.maximum(n, 1.0)
            centre += step
            squares += apart * (apart - step)
        return np.sqrt(squares / np.maximum(counts - 1, 1.0)), counts > 1


class _Weighted:
    """Bias-corrected weighted deviation of one source column.

    The variance is half the weighted mean of squared differences over all pairs of values. Pairs are summed as they
    arrive, from the faded sums of the values before, so no difference of nearly equal sums is taken when one value
    outweighs all others. Gaps age the weights.
    """

    def __init__(self, span: int, least: int):
        self.decay, self.least = 1 - 2 / (span + 1), least
        self.state = (0, 0, 0.0, 0.0, 0.0, 0.0, 0.0, None)

    def before(self, place: np.ndarray, values: np.ndarray, known: np.ndarray) -> pa.Array:
        decay, least, found = self.decay, self.least, []
        n, age, w, wx, wxx, pairs, spread, last = self.state
        for p, x, there in zip(place.tolist(), values.tolist(), known.tolist()):
            if p == 1:
                n, age, w, wx, wxx, pairs, spread, last = 0, 0, 0.0, 0.0, 0.0, 0.0, 0.0, None
            found.append(last)
            age += 1
            if there:
                fade = decay if age == 1 else decay**age
                w, wx, wxx = w * fade, wx * fade, wxx * fade
                apart = wxx - 2 * x * wx + x * x * w
                pairs = pairs * fade * fade + w
                spread = spread * fade * fade + (0.0 if apart < 0 else apart)
                n, age, w, wx, wxx = n + 1, 0, w + 1, wx + x, wxx + x * x
                last = math.sqrt(spread / (2 * pairs)) if n >= least and pairs else None
        self.state = n, age, w, wx, wxx, pairs, spread, last
        return pa.array(found, pa.float64())


def _pass(batches: Iterator, wanted: dict[str, Lookback], sources: list[str]) -> Iterator[pa.Array]:
    by_source = {s: {(b.stat, b.rows) for b in wanted.values() if b.source == s and b.stat != "ewm"} for s in sources}
    frames = {s: _Frames(max(n for _, n in found)) for s, found in by_source.items() if found}
    weighted = {name: _Weighted(b.rows, b.least) for name, b in wanted.items() if b.stat == "ewm"}
    last = 0
    for place, *columns in batches:
        place = place.to_numpy(zero_copy_only=False)
        follows = np.concatenate([[last], place[:-1]]) + 1
        if not ((place == 1) | (place == follows)).all():
            raise ValueError("the rows of a series must come in order and without holes")
        last = place[-1] if len(place) else last
        known = {s: c.is_valid().to_numpy(zero_copy_only=False) for s, c in zip(sources, columns)}
        values = {s: c.fill_null(0.0).to_numpy(zero_copy_only=False) for s, c in zip(sources, columns)}
        with np.errstate(all="ignore"):
            found = {s: f.statistics(place, values[s], known[s], by_source[s]) for s, f in frames.items()}
        yield pa.StructArray.from_arrays(
            [
                weighted[name].before(place, values[b.source], known[b.source]) if b.stat == "ewm" else found[b.source][b.stat, b.rows]
                for name, b in wanted.items()
            ],
            names=list(wanted),
        )


def add_lookbacks(df: DataFrame, wanted: dict[str, Lookback], keys: Sequence[str] = SERIES) -> DataFrame:
    """Append the statistics ``wanted`` of DOUBLE columns.

    The pass reads its rows in the order the window of ``_place`` leaves them in, and fails where they are not. It is
    declared nondeterministic, so that no filter is moved below it.
    """
    if not wanted:
        return df
    sources = list(dict.fromkeys(b.source for b in wanted.values()))

    def rows_before(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        return _pass(batches, wanted, sources)

    schema = T.StructType([T.StructField(name, T.DoubleType()) for name in wanted])
    run = F.arrow_udf(rows_before, schema, F.ArrowUDFType.SCALAR_ITER).asNondeterministic()
    placed = df.withColumn("_place", F.row_number().over(by_date(keys)))
    looked = placed.withColumn("_looked", run("_place", *sources))
    return looked.withColumns({name: F.col("_looked")[name] for name in wanted}).drop("_place", "_looked")
