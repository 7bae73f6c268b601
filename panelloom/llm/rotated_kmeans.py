"""Centroid clustering (Lloyd's rounds) in exact integers, with a filter in rotated coordinates.

Components become ``floor(scale * x)``. The vectors' second moments, summed over all of them, give a rotation whose
leading coordinates hold most of the spread. A vector is stored once with its integers, its ``LEADING`` first rotated
coordinates and the norm of the rest. For a centroid treated the same way, squared projected distance plus the squared
difference of the two norms of the rest never exceeds their squared distance. So the centroid of least bound is
measured in integers first, and of the others only those whose bound, less a margin for rounding, does not exceed
that distance. All comparisons that decide are between integers; the rotation only saves work.

A round is one pass over the stored vectors. Every task sends the sums of its clusters, in limbs of 32 bits so that
they add up exactly whatever their size, and the driver gets ``clusters x components`` sums. Integers beyond
``2 ** 27`` in size are handled as Python integers.

Vectors that are null, of another length, or hold null, NaN or infinite components are left out. Repeated rows count
each for itself. Ties between centroids go to the smaller number; the starting vectors with equal hashes are taken in
the order of their components, null ids last. With fewer vectors than clusters there are fewer clusters, and an empty
table gives no rows. Distances beyond a long are reported, and summed, as the largest long. Only ``id`` and the vector are read, so
other columns cannot clash.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelloom.llm.common import shared_folder

LEADING = 16
#: Integers up to this size leave room for 64 squared differences in 63 bits.
NARROW = 1 << 27
LONGEST = 2**63 - 1
_LIMB = 32
_ROWS = 1 << 15


@dataclass
class Clustering:
    """``rows`` (``id, cluster, distance``), the centroids as integers and their exact inertia and sizes."""

    rows: DataFrame
    centroids: list[list[int]]
    inertia: list[int]
    sizes: list[int]


def usable(vectors: DataFrame, id_column: str, vector_column: str, components: int) -> DataFrame:
    """``id, vector`` (doubles) of the vectors with so many components, all finite."""
    value = F.col(f"`{vector_column}`").cast("array<double>")
    finite = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.select(F.col(f"`{id_column}`").cast("long").alias("id"), value.alias("vector")).filter((F.size("vector") == components) & finite)


def _integers(vectors: pa.Array, scale: int, components: int) -> np.ndarray:
    """``floor(scale * x)`` of all components, as int64 or, where one is too large, as Python integers."""
    scaled = vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, components)
    with np.errstate(over="ignore"):
        floors = np.floor(scaled * scale)
    if np.abs(floors).max(initial=0) <= NARROW:
        return floors.astype(np.int64)
    return np.array([_integer(x, scale) for x in scaled.ravel().tolist()], dtype=object).reshape(scaled.shape)


def _integer(x: float, scale: int) -> int:
    if math.isfinite(x * scale):
        return math.floor(x * scale)
    top, bottom = x.as_integer_ratio()
    return top * scale // bottom


def _stored(ids: pa.Array, whole: np.ndarray, rotation: np.ndarray) -> pa.RecordBatch:
    """Integers as bytes (or text, if large), leading rotated coordinates and the norm of the rest."""
    lead, rest = _rotated(whole, rotation)
    narrow = whole.dtype != object
    small = pa.array([r.tobytes() for r in whole.astype("<i4")] if narrow else [None] * len(whole), pa.binary())
    large = pa.array([None] * len(whole) if narrow else [",".join(map(str, r)) for r in whole], pa.string())
    return pa.record_batch([ids, small, large, pa.array([r.tobytes() for r in lead], pa.binary()), pa.array(rest)], names=_STORED)


_STORED = ["id", "small", "large", "lead", "rest"]


def _rotated(whole: np.ndarray, rotation: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(all="ignore"):
        turned = _floats(whole) @ rotation
        return np.ascontiguousarray(turned[:, :LEADING]), np.sqrt((turned[:, LEADING:] ** 2).sum(axis=1))


def _floats(whole: np.ndarray) -> np.ndarray:
    """Integers as doubles; what is too large for one becomes infinite."""
    if whole.dtype != object:
        return whole.astype(np.float64)
    return np.array([[float(v) if abs(v) < 2**1023 else np.inf for v in row] for row in whole])


def rotation_of(spark, moments: DataFrame, components: int) -> np.ndarray:
    """Columns are the principal directions of all vectors, from their summed moments; the identity if these overflow."""
    sums = np.zeros((components + 1, components + 1))
    for r in moments.groupBy("i").agg(F.array(*[F.sum(F.get("products", F.lit(j))) for j in range(components + 1)]).alias("products")).collect():
        sums[r.i] = r.products
    n = sums[components, components]
    with np.errstate(all="ignore"):
        mean = sums[components, :components] / n if n else sums[components, :components]
        spread = sums[:components, :components] / max(n, 1) - np.outer(mean, mean)
    if not np.isfinite(spread).all():
        return np.eye(components)
    return np.linalg.eigh((spread + spread.T) / 2)[1][:, ::-1].copy()


def _moments(vectors: DataFrame, scale: int, components: int) -> DataFrame:
    """A row for each task and component: its products with all components and with one, summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((components + 1, components + 1))
        for batch in batches:
            whole = _floats(_integers(batch.column(0), scale, components))
            ones = np.column_stack([whole, np.ones(len(whole))])
            with np.errstate(all="ignore"):
                sums += ones.T @ ones
        yield pa.record_batch([pa.array(range(components + 1), pa.int32()), pa.array(sums.tolist())], names=["i", "products"])

    return vectors.select("vector").mapInArrow(run, "i int, products array<double>")


def nearest(whole: np.ndarray, lead: np.ndarray, rest: np.ndarray, centroids: np.ndarray, rotation: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid and the squared distance, for every vector; exact."""
    to, tail = _rotated(centroids, rotation)
    with np.errstate(all="ignore"):
        size = (lead**2).sum(axis=1) + rest**2
        reach = (to**2).sum(axis=1) + tail**2
        bound = size[:, None] - rest[:, None] ** 2 + (to**2).sum(axis=1) - 2 * lead @ to.T + (rest[:, None] - tail) ** 2
        margin = 1e-9 * (size[:, None] + reach) + 1.0
        low = np.where(np.isfinite(bound), bound - margin, -np.inf)
    best = low.argmin(axis=1)
    distance = np.zeros(len(whole), dtype=object if object in (whole.dtype, centroids.dtype) else np.int64)
    every = np.arange(len(centroids))
    for c in every:
        own = np.flatnonzero(best == c)
        distance[own] = _squared(whole[own], centroids[c])
    first, so_far = best.copy(), _floats(distance[:, None])[:, 0]
    for c in every:
        # a double rounds the distance by far less than the margin takes off the bound
        open_ = np.flatnonzero((low[:, c] <= so_far) & (first != c))
        if len(open_):
            new = _squared(whole[open_], centroids[c])
            better = (new < distance[open_]) | ((new == distance[open_]) & (c < best[open_]))
            closer = open_[better]
            best[closer], distance[closer] = c, new[better]
    return best, distance


def _squared(whole: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    if len(whole) and whole.dtype != object and centroid.dtype == object and max(map(abs, centroid)) <= NARROW:
        centroid = centroid.astype(np.int64)
    return ((whole - centroid) ** 2).sum(axis=1)


def _batches(batches: Iterator[pa.RecordBatch], components: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """Id, integers, leading coordinates and rest, a slice of rows of one kind at a time."""
    for batch in batches:
        large = batch.column(2).is_valid().to_numpy(zero_copy_only=False)
        for kind in (False, True):
            for some in np.array_split(np.flatnonzero(large == kind), -(-int((large == kind).sum()) // _ROWS) or 1):
                if not len(some):
                    continue
                part = batch.take(pa.array(some))
                lead = np.frombuffer(b"".join(part.column(3).to_pylist()), np.float64).reshape(len(some), -1)
                if kind:
                    whole = np.array([list(map(int, t.split(","))) for t in part.column(2).to_pylist()], dtype=object).reshape(-1, components)
                else:
                    whole = np.frombuffer(b"".join(part.column(1).to_pylist()), "<i4").reshape(-1, components).astype(np.int64)
                yield part.column(0), whole, lead, part.column(4).to_numpy()


def _as_array(centroids: list[list[int]]) -> np.ndarray:
    wide = any(abs(v) > NARROW for c in centroids for v in c)
    return np.array(centroids, dtype=object if wide else np.int64)


def _summed(stored: DataFrame, centroids: list[list[int]], rotation: np.ndarray) -> tuple[dict[int, int], dict[int, list[int]]]:
    """Size and exact component sums of every cluster that is not empty."""
    components, to = len(centroids[0]), _as_array(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [[0] * (components + 1) for _ in centroids]
        for _, whole, lead, rest in _batches(batches, components):
            best, _ = nearest(whole, lead, rest, to, rotation)
            for c in np.unique(best).tolist():
                own = whole[best == c]
                sums[c] = [a + int(b) for a, b in zip(sums[c], [*own.sum(axis=0), len(own)], strict=True)]
        rows = [(c, i, limb, part) for c, row in enumerate(sums) if row[-1] for i, value in enumerate(row) for limb, part in enumerate(_limbs(value))]
        if rows:
            yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=["cluster", "i", "limb", "part"]), preserve_index=False)

    parts = stored.mapInArrow(run, "cluster long, i long, limb long, part long")
    counts: dict[int, int] = {}
    sums: dict[int, list[int]] = {}
    for r in parts.groupBy("cluster", "i", "limb").agg(F.sum("part").alias("part")).collect():  # clusters x components x limbs
        row = sums.setdefault(r.cluster, [0] * (components + 1))
        row[r.i] += r.part << (_LIMB * r.limb)
    for c, row in sums.items():
        counts[c] = row.pop()
    return counts, sums


def _limbs(value: int) -> list[int]:
    """Base-2^32 digits of an integer, all with its sign."""
    sign, value, out = (-1 if value < 0 else 1), abs(value), []
    while value or not out:
        out.append(sign * (value & (2**_LIMB - 1)))
        value >>= _LIMB
    return out


def _saturated(values: np.ndarray) -> np.ndarray:
    return np.array([min(int(v), LONGEST) for v in values.tolist()], np.int64) if values.dtype == object else values


def cluster(vectors: DataFrame, order: Column, clusters: int, rounds: int, scale: int, components: int) -> Clustering:
    """Lloyd's rounds over ``id, vector`` from the first ``clusters`` vectors in the ascending ``order``, then one more assignment.

    A centroid moves to the componentwise floor of its vectors' mean; one without vectors stays.
    """
    spark = vectors.sparkSession
    first = vectors.orderBy(order.asc_nulls_last(), F.col("id").asc_nulls_last(), "vector").limit(clusters).collect()
    centroids = [[_integer(x, scale) for x in r.vector] for r in first]
    if not centroids:
        return Clustering(spark.createDataFrame([], "id long, cluster int, distance long"), [], [], [])
    rotation = rotation_of(spark, _moments(vectors, scale, components), components)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _stored(batch.column(0), _integers(batch.column(1), scale, components), rotation)

    folder = shared_folder(spark, "rotated-vectors")
    vectors.mapInArrow(keep, "id long, small binary, large string, lead binary, rest double").write.parquet(f"{folder}/stored")
    stored = spark.read.parquet(f"{folder}/stored")
    for _ in range(rounds):
        counts, sums = _summed(stored, centroids, rotation)
        moved = [[s // counts[c] for s in sums[c]] if c in counts else old for c, old in enumerate(centroids)]
        if moved == centroids:  # every further round would give the same
            break
        centroids = moved
    to = _as_array(centroids)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, whole, lead, rest in _batches(batches, components):
            best, distance = nearest(whole, lead, rest, to, rotation)
            yield pa.record_batch([ids, pa.array(best.astype(np.int32)), pa.array(_saturated(distance))], names=["id", "cluster", "distance"])

    stored.mapInArrow(label, "id long, cluster int, distance long").write.parquet(f"{folder}/labelled")
    labelled = spark.read.parquet(f"{folder}/labelled")
    return Clustering(labelled, centroids, *_inertia(labelled, len(centroids)))


def _inertia(labelled: DataFrame, clusters: int) -> tuple[list[int], list[int]]:
    """Exact sums of the distances and sizes of the clusters; the two halves of the bits are summed apart."""
    low, high = F.col("distance").bitwiseAND(2**_LIMB - 1), F.shiftright("distance", _LIMB)
    sums = labelled.groupBy("cluster").agg(F.sum(low).alias("low"), F.sum(high).alias("high"), F.count(F.lit(1)).alias("n"))
    inertia, sizes = [0] * clusters, [0] * clusters
    for r in sums.collect():
        inertia[r.cluster], sizes[r.cluster] = (r.high << _LIMB) + r.low, r.n
    return inertia, sizes


def centroid_sha256(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()
