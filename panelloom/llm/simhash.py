"""SimHash near-duplicates by bit-sliced comparison.

Two fingerprints link when they differ in at most ``radius`` of 64 bits. The bits are cut into ``radius + 2``
bands, so two bands at least agree between linked fingerprints, and each pair of bands gives a table of buckets.
Inside a bucket the fingerprints stand vertically: plane ``b`` holds bit ``b`` of 64 rows per machine word. The
distances from one fingerprint to 64 others are counted at once, three planes at a time through carry-save adders
into counter planes, and a word is abandoned as soon as all its rows exceed the radius.

Equal fingerprints are merged before the tables are made, and a bucket above ``BUCKET`` rows is dealt out in
pieces that meet each other two by two, so a task holds two pieces at most. A bucket returns a spanning forest
of its links, not the links, and components are found over these. Nothing is left out.

Null and empty texts have fingerprint zero and link with each other. A component's id is its smallest doc_id; null
doc_ids are ignored unless there is no other. Equal rows are kept, and an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.llm.common import join_small, row_struct
from panelloom.llm.components import connected_components
from panelloom.session import checkpointed

SHINGLE = 4
RADIUS = 4
SEED = 42
BUCKET = 4096
#: Pairs of a fingerprint and a word of 64 others that are compared at a time.
_SLICE = 1 << 15
_HASHES = 1 << 16
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned SimHash of a text over its word shingles, repeats included; zero without words."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "replace").lower().split()  # of bytes: lowers A-Z, splits at ASCII white space
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths) - 1
    n = max(1, len(words) - shingle + 1)
    spans = zip((ends - lengths + 1)[:n].tolist(), ends[-n:].tolist(), strict=True)
    hashes = np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in spans), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, _HASHES):
        part = hashes[at : at + _HASHES].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, text_hash, fp`` of every row; ``fp`` is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(2)], np.uint64).view(np.int64)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(fps)], names=["doc_id", "text_hash", "fp"])

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(run, "doc_id long, text_hash long, fp long")


def _ones(k: np.ndarray) -> np.ndarray:
    """Words whose lowest ``k`` bits are set."""
    k = np.clip(k, 0, 64).astype(np.uint64)
    return np.where(k == 64, _ALL, (np.uint64(1) << (k & np.uint64(63))) - np.uint64(1))


def _over(ones: np.ndarray, twos: np.ndarray, fours: np.ndarray, radius: int) -> np.ndarray:
    """Rows whose three-bit count is above the radius."""
    above, equal = np.zeros_like(ones), np.full_like(ones, _ALL)
    for plane, bit in ((fours, radius & 4), (twos, radius & 2), (ones, radius & 1)):
        if not bit:
            above |= equal & plane
            equal &= ~plane
        else:
            equal &= plane
    return above


def sliced_links(fps: np.ndarray, ends: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked pairs ``(i, j)`` with ``i < j < ends[i]``, in portions; ``ends`` is where the row's bucket ends."""
    n = len(fps)
    planes_bits = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    padded = np.zeros((64, -(-n // 64) * 64), np.uint8)
    padded[:, :n] = planes_bits.T
    planes = np.packbits(padded, axis=1, bitorder="little").view("<u8")
    rows = np.flatnonzero(ends > np.arange(n) + 1)
    words = (ends[rows] - 1) // 64 - (rows + 1) // 64 + 1
    stops = np.cumsum(words)
    at = 0
    while at < len(rows):
        to = max(at + 1, int(np.searchsorted(stops, (stops[at - 1] if at else 0) + _SLICE, "right")))
        q = np.repeat(rows[at:to], words[at:to])
        inside = np.arange(len(q)) - np.repeat(stops[at:to] - words[at:to] - (stops[at - 1] if at else 0), words[at:to])
        w = (q + 1) // 64 + inside
        yield _compare(fps, planes, ends, q, w, radius)
        at = to


def _compare(fps, planes, ends, q, w, radius) -> tuple[np.ndarray, np.ndarray]:
    over = ~(_ones(ends[q] - 64 * w) & ~_ones(q + 1 - 64 * w))
    ones, twos, fours = (np.zeros(len(q), np.uint64) for _ in range(3))
    own = fps[q]
    for b in range(0, 64, 3):
        x = [planes[i, w] ^ (np.uint64(0) - (own >> np.uint64(i) & np.uint64(1))) for i in range(b, min(b + 3, 64))]
        x += [np.zeros_like(ones)] * (3 - len(x))
        # three planes become a sum and a carry, which ripple into the counters
        half = x[0] ^ x[1]
        total, carry = half ^ x[2], (x[0] & x[1]) | (x[2] & half)
        more = ones & total
        ones ^= total
        half = twos ^ carry
        up = (twos & carry) | (more & half)
        twos = half ^ more
        over |= fours & up
        fours ^= up
        over |= _over(ones, twos, fours, radius)
        if b % 6 == 3 or b > 57:
            alive = over != _ALL
            if alive.sum() < 0.8 * len(alive):
                q, w, own, over, ones, twos, fours = (v[alive] for v in (q, w, own, over, ones, twos, fours))
                if not len(q):
                    break
    row, lane = np.nonzero(np.unpackbits((~over).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    return q[row], w[row] * 64 + lane


def _merge(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give linked rows the smallest row of their component as label, in place."""
    while True:
        a, b = labels[a], labels[b]
        apart = a != b
        if not apart.any():
            return
        a, b = a[apart], b[apart]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(jumped := labels[labels], labels):
            labels[:] = jumped


def bucket_forest(fps: np.ndarray, ends: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges from rows to the first row of their component inside the bucket."""
    labels = np.arange(len(fps))
    for a, b in sliced_links(fps, ends, radius):
        _merge(labels, a, b)
    moved = np.flatnonzero(labels != np.arange(len(fps)))
    return fps[moved], fps[labels[moved]]


def _table_keys(radius: int):
    """One long per table: the table's number above the bits of its two bands."""
    bands = radius + 2
    starts = [64 * i // bands for i in range(bands + 1)]
    keys = []
    for number, (i, j) in enumerate(combinations(range(bands), 2)):
        parts = [(F.shiftrightunsigned("fp", starts[k]).bitwiseAND((1 << (starts[k + 1] - starts[k])) - 1)) for k in (i, j)]
        keys.append(F.lit(number << 40).bitwiseOR(F.shiftleft(parts[0], 20)).bitwiseOR(parts[1]))
    return keys


def near_links(distinct: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Edges ``a, b`` over the distinct ``fp`` whose components are those of all links within the radius."""
    if not 0 <= radius <= 7:
        raise ValueError("the radius must be 0 to 7")
    tables = distinct.select("fp", F.explode(F.array(*_table_keys(radius))).alias("key"))
    sizes = tables.groupBy("key").agg(F.count(F.lit(1)).alias("_n"))
    large = checkpointed(sizes.filter(F.col("_n") > bucket).select("key", F.ceil(F.col("_n") / bucket).alias("_pieces")))
    dealt = join_small(tables, large, ["key"], "left")
    own = F.pmod(F.xxhash64("fp"), F.col("_pieces"))
    met = F.transform(F.sequence(F.lit(0).cast("long"), F.col("_pieces") - 1), lambda c: F.struct(F.least(c, own).alias("p"), F.greatest(c, own).alias("o")))
    alone = F.array(F.struct(F.lit(0).cast("long").alias("p"), F.lit(0).cast("long").alias("o")))
    dealt = dealt.select("key", "fp", F.explode(F.when(F.col("_pieces").isNull(), alone).otherwise(met)).alias("_two")).select("key", "_two.p", "_two.o", "fp")
    ordered = dealt.repartition("key", "p", "o").sortWithinPartitions("key", "p", "o", "fp")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            held.append(batch)
            rows = pd.concat(held) if len(held) > 1 else batch
            group = rows[["key", "p", "o"]].to_numpy()
            # the last bucket may go on in the next batch
            last = int(np.flatnonzero((group != group[-1]).any(axis=1))[-1]) + 1 if (group[0] != group[-1]).any() else 0
            if last:
                yield _forest(rows[:last], radius)
            held = [rows[last:]]
        if held and len(held[0]):
            yield _forest(held[0], radius)

    return ordered.mapInPandas(run, "a long, b long")


def _forest(rows: pd.DataFrame, radius: int) -> pd.DataFrame:
    group = rows[["key", "p", "o"]].to_numpy()
    starts = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]).any(axis=1)]))
    sizes = np.diff(np.append(starts, len(rows)))
    ends = np.repeat(starts + sizes, sizes)
    a, b = bucket_forest(rows["fp"].to_numpy(np.int64).view(np.uint64), ends, radius)
    return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``doc_id, text_hash, fp, root, component_id`` of every row of ``doc_id, text``."""
    rows = checkpointed(fingerprints(docs, shingle))
    firsts = checkpointed(rows.groupBy("fp").agg(F.min("doc_id").alias("_first")))
    roots = connected_components(near_links(firsts.select("fp"), radius)).withColumnRenamed("node", "fp")
    rooted = firsts.join(roots, "fp", "left").select("fp", "_first", F.coalesce("root", "fp").alias("root"))
    rooted = checkpointed(rooted)
    ids = rooted.groupBy("root").agg(F.min("_first").alias("component_id"))
    named = checkpointed(rooted.join(ids, "root").select("fp", "root", "component_id"))
    return rows.join(named, "fp").select("doc_id", "text_hash", "fp", "root", "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs``, one of each component: smallest doc_id, then smallest text hash; all columns stay."""
    rows = docs.select(row_struct(docs).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = near_duplicates(rows, shingle, radius)
    no = F.coalesce(F.col("doc_id"), F.lit(2**63 - 1))
    kept = found.groupBy("root").agg(F.min(F.struct(no.alias("no"), "text_hash", "doc_id")).alias("k")).select(F.col("k.doc_id").alias("kept_id"), F.col("k.text_hash").alias("kept_hash"))
    hashed = rows.select("row", "doc_id", F.xxhash64("text").alias("text_hash"))
    joined = hashed.join(kept, F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("text_hash") == F.col("kept_hash")), "left_semi")
    return joined.dropDuplicates(["doc_id", "text_hash"]).select("row.*")
