"""Clustering against plain Lloyd's rounds in Python integers, and the bounds that save work."""

import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelloom.llm import rotated_kmeans
from panelloom.llm.queries import ORACLES, QUERIES
from panelloom.llm.rotated_kmeans import LONGEST


def plain(rows, scale, components, k, rounds):
    """``(id, cluster, distance)`` of every usable row and the centroids."""
    good = [(i, v) for i, v in rows if v is not None and len(v) == components and all(x is not None and math.isfinite(x) for x in v)]
    whole = [(i, [math.floor(scale * Fraction(x)) for x in v]) for i, v in good]
    key = lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1])
    centroids = [v for _, v in sorted(whole, key=key)[:k]]
    for n in range(rounds + 1):
        best = [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids)) for _, v in whole]
        if n == rounds:
            return [(i, j, min(d, LONGEST)) for (i, _), (d, j) in zip(whole, best, strict=True)], centroids
        for j in range(len(centroids)):
            own = [v for (_, v), (_, b) in zip(whole, best, strict=True) if b == j]
            if own:
                centroids[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]


def run(sp, rows, components, k=4, rounds=5, kind="double"):
    df = sp.createDataFrame([(i, v, 1, "x") for i, v in rows], f"vec_id bigint, embedding array<{kind}>, cluster int, small string")
    vectors = rotated_kmeans.usable(df, "vec_id", "embedding", components)
    return rotated_kmeans.cluster(vectors, F.sha2(F.concat(F.lit("3:"), F.col("id").cast("string")), 256), k, rounds, 1024, components)


def compare(sp, rows, components, **options):
    got = run(sp, rows, components, **options)
    want, centroids = plain(rows, 1024, components, options.get("k", 4), options.get("rounds", 5))
    assert got.centroids == centroids
    found = sorted(map(tuple, got.rows.collect()), key=str)
    assert found == sorted(want, key=str)
    assert got.inertia == [sum(d for _, c, d in want if c == j) for j in range(len(centroids))]
    assert got.sizes == [sum(c == j for _, c, _ in want) for j in range(len(centroids))]


def test_matches_plain_rounds(sp):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=20) + 3 * (i % 5)).tolist()) for i in range(400)]
    rows += [(1, rows[1][1]), (1, rows[2][1]), (None, rows[3][1]), (7, None), (8, [1.0]), (9, [None] * 20), (10, [float("nan")] * 20), (11, [float("inf")] * 20)]
    compare(sp, rows, 20)
    compare(sp, rows, 20, rounds=0, k=500)


def test_ties_and_few_vectors(sp):
    rows = [(i, [float(i % 3), 0.0, 0.0]) for i in range(40)]
    compare(sp, rows, 3, k=6)
    compare(sp, rows[:2], 3, k=6)
    assert run(sp, [(1, None)], 3).rows.count() == 0 and run(sp, [(1, None)], 3).centroids == []


@pytest.mark.parametrize("size", [1e6, 1e30, 1e306])
def test_large_components(sp, size):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=4) * (size if i % 4 == 0 else 1)).tolist()) for i in range(60)]
    compare(sp, rows, 4, rounds=3)


def test_bounds_hold_and_save_work(monkeypatch):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(8, 64)) * 3
    whole = np.floor(1024 * (centres[rng.integers(0, 8, 4000)] + rng.normal(size=(4000, 64)) * 0.3)).astype(np.int64)
    rotation = np.linalg.eigh(np.cov(whole.T))[1][:, ::-1]
    lead, rest = rotated_kmeans._rotated(whole, rotation)
    to = np.floor(1024 * centres).astype(np.int64)
    near, tail = rotated_kmeans._rotated(to, rotation)
    exact = ((whole[:, None] - to) ** 2).sum(axis=2)
    bound = ((lead[:, None] - near) ** 2).sum(axis=2) + (rest[:, None] - tail) ** 2
    assert (bound <= exact * (1 + 1e-9) + 1).all()
    measured = []
    squared = rotated_kmeans._squared
    monkeypatch.setattr(rotated_kmeans, "_squared", lambda w, c: measured.append(len(w)) or squared(w, c))
    best, distance = rotated_kmeans.nearest(whole, lead, rest, to, rotation)
    assert (best == exact.argmin(axis=1)).all() and (distance == exact.min(axis=1)).all()
    assert sum(measured) < 1.2 * len(whole)


def test_query_matches_sql(sp):
    import duckdb

    folder = "/root/testdata/sf0.001"
    got = sorted(map(tuple, QUERIES["op12_rotated_kmeans"](sp, folder).collect()))
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
        assert got == sorted(con.execute(ORACLES["op12_rotated_kmeans"]).fetchall())
