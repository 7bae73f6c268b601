"""Uniform shuffle into shards of exact size, by a hypergeometric communication matrix.

A uniformly random permutation sends to shard ``s`` a number of rows of input partition ``p`` that follows the
multivariate hypergeometric law. So the matrix of these counts is drawn first, from the row count of each
partition alone; then each partition puts its rows in random order and deals them out by its row of the matrix,
the rows are exchanged, and each shard puts what it got in random order. Shard sizes differ by one row at most.

The rows of a partition are written with their partition and place before any count is taken, so a lost
executor cannot change what the counts were taken of. Ranks inside a partition or shard come from counts of
random-key buckets, so no window holds more than a bucket. Equal rows, null and empty texts are rows like any
other. An empty table gives no rows. The draw is a function of the seed and of the partition sizes: where the files of
the input are split differently, rows come to other shards, by the same law and with the same sizes.
"""

from __future__ import annotations

from math import lgamma, log

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelloom.llm.common import join_small
from panelloom.session import checkpointed

#: Rows that a random-key bucket holds on average.
BUCKET_ROWS = 50_000


def shard_sizes(rows: int, shards: int) -> np.ndarray:
    return np.full(shards, rows // shards, np.int64) + (np.arange(shards) < rows % shards)


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """Good ones among ``n`` drawn without replacement; numpy's own sampler stops at 10 ** 9 of a kind.

    Larger populations are drawn by rejection from the binomial law, whose ratio to the wanted law has one peak.
    """
    if max(good, bad) < 10**9:
        return int(rng.hypergeometric(good, bad, n))
    both = good + bad
    if 2 * n > both:
        return good - _hypergeometric(rng, good, bad, both - n)

    def log_ratio(k: int) -> float:
        free = lgamma(good + 1) - lgamma(good - k + 1) + lgamma(bad + 1) - lgamma(bad - n + k + 1)
        return free - k * log(good / both) - (n - k) * log(bad / both)

    peak = log_ratio(min(n, good * (n - 1) // both + 1))
    while True:
        k = int(rng.binomial(n, good / both))
        if k <= good and n - k <= bad and log(1 - rng.random()) <= log_ratio(k) - peak:
            return k


def draw_matrix(counts: list[int], shards: int, seed: int) -> np.ndarray:
    """Rows per partition and shard: row sums are ``counts``, column sums the shard sizes.

    One partition after the other draws from what is left of the shards, which gives the joint law.
    """
    rng = np.random.Generator(np.random.PCG64(seed))
    left = shard_sizes(sum(counts), shards)
    out = np.zeros((len(counts), shards), np.int64)
    for p, n in enumerate(counts):
        for s in range(shards - 1):  # one binomial-like draw per shard; the last shard gets the rest
            rest = int(left[s + 1 :].sum())
            take = _hypergeometric(rng, int(left[s]), rest, n) if n and left[s] and rest else min(n, int(left[s]))
            out[p, s], n = take, n - take
        out[p, shards - 1] = n
        left -= out[p]
    return out


def _ranked(df: DataFrame, group: str, key: Column, buckets: Column, name: str) -> DataFrame:
    """Rank from 0 within a group by a random key, from bucket counts and ranks within a bucket."""
    df = df.withColumn("_key", key)
    # the top bits of the key choose the bucket, so bucket order is key order
    df = df.withColumn("_bucket", F.floor((F.shiftrightunsigned("_key", 32) * buckets) / F.lit(float(1 << 32))).cast("long"))
    counts = checkpointed(df.groupBy(group, "_bucket").agg(F.count(F.lit(1)).alias("_n")))
    before = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = checkpointed(counts.select(group, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))
    inside = Window.partitionBy(group, "_bucket").orderBy("_key", "_partition", "_place")
    ranked = join_small(df.withColumn("_inside", F.row_number().over(inside) - 1), offsets, [group, "_bucket"])
    return ranked.withColumn(name, F.col("_before") + F.col("_inside")).drop("_key", "_bucket", "_inside", "_before")


def shuffle_into_shards(df: DataFrame, shards: int = 16, seed: int = 42, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Add ``shard`` and ``slot`` (its place in the shard, gapless from 0) to every row.

    Carry narrow rows: what is passed in is written once and exchanged. Names starting with ``_`` are reserved.
    """
    placed = df.withColumns({"_partition": F.spark_partition_id(), "_place": F.monotonically_increasing_id()})
    placed = checkpointed(placed)
    sizes = {r["_partition"]: r["n"] for r in placed.groupBy("_partition").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(sizes.values())
    order = sorted(sizes)
    matrix = draw_matrix([sizes[p] for p in order], shards, seed)
    ends = np.cumsum(matrix, axis=1)
    dealt = df.sparkSession.createDataFrame(
        [(p, [int(x) for x in ends[i]], float(-(-sizes[p] // bucket_rows))) for i, p in enumerate(order)],
        "_partition int, _ends array<long>, _buckets double",
    )
    placed = join_small(placed, dealt, ["_partition"])
    local = _ranked(placed, "_partition", F.xxhash64(F.lit(seed), "_partition", "_place"), F.col("_buckets"), "_rank")
    # the shard is the number of shards that end at or before the local rank
    sent = local.withColumn("shard", F.size(F.filter("_ends", lambda e: e <= F.col("_rank"))))
    sent = checkpointed(sent.drop("_ends", "_buckets", "_rank"))
    per_shard = F.lit(float(max(1, -(-total // (shards * bucket_rows)))))
    out = _ranked(sent, "shard", F.xxhash64(F.lit(seed + 1), "_partition", "_place"), per_shard, "slot")
    return out.drop("_partition", "_place")
