"""Periodic runs in the words of texts, found through a dictionary of basic factors.

A run is a longest stretch of words in which words ``q`` apart are equal, ``q`` being the smallest such number, that is
at least ``MIN_PERIODS * q`` and ``MIN_LENGTH`` words long. The dictionary names the factors of length 1, 2, 4, ...:
equal factors of one text get equal names, and the names of a length come from pairs of names of half that length.
Factors that stand only once have no repetition and are left out of the next length, so most texts end after a few.

Two occurrences of a factor within twice its length overlap or touch. Where a factor's successor lies ``q`` further and
the successor's successor ``q`` further again, the occurrences form an arithmetic progression and propose the period
``q``; neighbouring places with one ``q`` are one proposal. Every period ``q`` of a run is proposed at the lengths
from ``q`` to below ``2 q`` at least, and no multiple of it is. Proposals are extended word by word at both ends, and
those of several lengths that become the same run count once.

Texts are handled whole, several small ones together, up to ``WINDOW`` bytes or one text at a time; memory grows with
the longest text. Nothing is shuffled. Null text has no words and, like empty and blank text, no runs and an empty
collapsed text. Overlapping runs of different periods are all returned. Equal rows get equal results, an empty table
gives no rows, and the row's own columns stay together in the struct ``row``, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelloom.llm.common import arrow_schema

MIN_PERIODS = 4
MIN_LENGTH = 6
WINDOW = 1 << 22


def word_runs(words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Rows ``start, length, period`` by start and period: all runs of sequences of word numbers put end to end.

    ``sizes`` are the lengths of the sequences; starts count from the beginning of the first one.
    """
    total = len(words)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    stop = np.cumsum(sizes)[owner] if total else np.zeros(0, np.int64)
    begin = stop - sizes[owner] if total else stop
    at = np.flatnonzero(sizes[owner] >= MIN_LENGTH)
    name, length, proposed = owner[at] * (words.max(initial=0) + 1) + words[at], 1, []
    while len(at):
        order = np.argsort(name, kind="stable")
        place, same = at[order], np.flatnonzero(np.diff(name[order]) == 0)
        if not len(same):
            break
        gap = np.zeros(total, np.int64)
        gap[place[same]] = place[same + 1] - place[same]
        proposed.append(_progressions(gap, length))
        # names of twice the length, for factors whose halves both stand more than once
        rank = np.full(total + 1, -1)
        number = np.concatenate([[0], np.cumsum(np.diff(name[order]) != 0)])
        several = np.bincount(number)[number] > 1
        rank[place[several]] = number[several]
        at = place[several]
        at = np.sort(at[(at + 2 * length <= stop[at]) & (4 * length <= (stop - begin)[at])])
        at = at[rank[at + length] >= 0]
        name = rank[at] * (number[-1] + 1) + rank[at + length]
        length *= 2
    return _extended(words, begin, stop, np.concatenate(proposed) if proposed else np.zeros((0, 3), np.int64))


def _progressions(gap: np.ndarray, length: int) -> np.ndarray:
    """Proposals ``start, end, period`` of one factor length from the gaps to the next equal factor (0: none)."""
    near = np.flatnonzero((gap > 0) & (gap <= length))
    near = near[gap[near + gap[near]] == gap[near]]
    period = gap[near]
    first = np.flatnonzero(np.concatenate([[True], (np.diff(near) != 1) | (np.diff(period) != 0)])) if len(near) else near
    last = np.append(first[1:], len(near)) - 1 if len(near) else near
    return np.stack([near[first], near[last] + 2 * period[first] + length, period[first]], axis=1)


def _extended(words: np.ndarray, begin: np.ndarray, stop: np.ndarray, proposed: np.ndarray) -> np.ndarray:
    """The different runs that proposals grow to; short ones are dropped."""
    start, end, period = proposed.T.copy()
    low, high = (begin[start], stop[start]) if len(start) else (start, end)
    open_ = np.arange(len(start))
    while len(open_ := open_[start[open_] > low[open_]]):
        open_ = open_[words[start[open_] - 1] == words[start[open_] - 1 + period[open_]]]
        start[open_] -= 1
    open_ = np.arange(len(start))
    while len(open_ := open_[end[open_] < high[open_]]):
        open_ = open_[words[end[open_]] == words[end[open_] - period[open_]]]
        end[open_] += 1
    long = end - start >= np.maximum(MIN_LENGTH, MIN_PERIODS * period)
    found = np.unique(np.stack([start, period, end - start], axis=1)[long], axis=0)
    return found[:, [0, 2, 1]]


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """For each of ``n`` words, whether no run contains it after the run's first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edge[:n]) == 0


def _described(texts: list[bytes | None]) -> Iterator[tuple[int, np.ndarray, bytes]]:
    """Number of words, runs and collapsed text of each text."""
    split = [(t or b"").split() for t in texts]  # of bytes: at ASCII white space
    sizes = np.array([len(w) for w in split], np.int64)
    words = pd.factorize(np.array([w for s in split for w in s], dtype=object))[0] if sizes.any() else np.zeros(0, np.int64)
    runs = word_runs(words.astype(np.int64), sizes)
    ends = np.cumsum(sizes)
    bounds = np.searchsorted(runs[:, 0], np.concatenate([[0], ends]))
    for i, found in enumerate(split):
        own = runs[bounds[i] : bounds[i + 1]] - [ends[i] - sizes[i], 0, 0]
        if len(own):
            found = [found[j] for j in np.flatnonzero(kept_words(len(found), own)).tolist()]
        yield int(sizes[i]), own, b" ".join(found)


def _windows(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``WINDOW`` bytes of text, or of one row."""
    start, held = 0, 0
    for i, size in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        if i > start and held + size > WINDOW:
            yield start, i
            start, held = i, 0
        held += size
    if len(texts):
        yield start, len(texts)


def periodic_runs(docs: DataFrame) -> DataFrame:
    """``row`` (all columns but ``text``, as a struct), ``n_words``, ``runs`` and ``collapsed`` for every row.

    ``runs`` is an array of ``start, length, period`` in words, by start and then period; ``collapsed`` is the text
    without the words that repeat a period, the rest joined by one space.
    """
    others = [c for c in docs.columns if c != "text"]
    row = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.struct(F.lit(None).cast("int").alias("none"))
    rows = docs.select(row.alias("row"), F.col("text").cast("binary").alias("text"))
    fields = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    spark_schema, schema = arrow_schema(rows.select("row"), fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in _windows(batch.column(1)):
                counts, found, texts = zip(*_described(batch.column(1)[low:high].to_pylist()), strict=True)
                flat = np.concatenate(found)
                struct = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], ["start", "length", "period"])
                offsets = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
                columns = [batch.column(0)[low:high], pa.array(counts, pa.int64()), pa.ListArray.from_arrays(offsets, struct), pa.array(texts, pa.binary())]
                yield pa.record_batch([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return rows.mapInArrow(run, spark_schema)


def strongest(runs: Column) -> Column:
    """The run of greatest ``length / period``, compared exactly; the first of equals. Null without runs."""

    def better(a: Column, b: Column) -> Column:
        return F.when(a.isNull() | (b["length"] * a["period"] > a["length"] * b["period"]), b).otherwise(a)

    return F.aggregate(runs, F.lit(None).cast("struct<start:long,length:long,period:long>"), better)


def runs_text(runs: Column) -> Column:
    """``start,length,period`` and a line feed for every run."""
    return F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
