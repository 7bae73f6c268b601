"""Exact quantiles of groups with no size bound, of which only a few values are shuffled.

``F.percentile`` gathers the distinct values of a group in one task. Here a bounded sketch per group gives bucket
edges; rows are counted per bucket on the map side, which tells the buckets that hold a wanted rank; and only the
values of those buckets are shuffled, equal ones merged before, and ranked, each bucket in a task of its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelloom.session import checkpointed

BUCKETS = 256
#: Groups whose edges (at most ``buckets`` numbers each) may be broadcast; more are joined by one shuffle of the values.
BROADCAST_GROUPS = 1000


def _edges_below(edges: str, value: str, most: int) -> Column:
    """How many of the sorted edges lie below the value, by halving."""

    def halve(span: Column, _: Column) -> Column:
        middle = F.floor((span["low"] + span["high"]) / 2).cast("int")
        below = F.get(edges, middle) < F.col(value)
        open_span = span["low"] < span["high"]
        return F.struct(
            F.when(open_span & below, middle + 1).otherwise(span["low"]).alias("low"),
            F.when(open_span & ~below, middle).otherwise(span["high"]).alias("high"),
        )

    start = F.struct(F.lit(0).alias("low"), F.size(edges).alias("high"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(most.bit_length())), start, halve, lambda span: span["low"])


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probabilities: Sequence[float], buckets: int = BUCKETS
) -> DataFrame:
    """``keys, n, quantiles``: linear-interpolation quantiles in the order asked.

    The edges are checkpointed, so both passes and any retry see the same ones. They only steer the split: any edges
    give exact results.
    """
    probabilities = [float(p) for p in probabilities]
    cuts = [(i + 1) / buckets for i in range(buckets - 1)]
    values = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    edges = values.groupBy(*keys).agg(F.percentile_approx("_v", cuts, buckets * 10).alias("_edges"))
    edges = checkpointed(edges.withColumn("_edges", F.array_sort(F.array_distinct("_edges"))))
    few = edges.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    small = F.broadcast if few else lambda table: table
    bucketed = values.join(small(edges), list(keys)).withColumn("_b", _edges_below("_edges", "_v", buckets)).drop("_edges")
    along = Window.partitionBy(*keys).orderBy("_b")  # at most one row a bucket
    sizes = bucketed.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_size"))
    sizes = sizes.withColumns(
        {
            "_after": F.sum("_size").over(along.rowsBetween(Window.unboundedPreceding, 0)),
            "n": F.sum("_size").over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
        }
    ).withColumn("_before", F.col("_after") - F.col("_size"))
    places = [(F.col("n") - 1) * p for p in probabilities]
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(x), F.ceil(x)) for x in places])))
    wanted = sizes.withColumn("_ranks", F.filter(ranks, lambda r: (r >= F.col("_before")) & (r < F.col("_after"))))
    # written before the values are read again, so that they meet a small table of known size
    wanted = checkpointed(wanted.filter(F.size("_ranks") > 0).select(*keys, "_b", "n", "_before", "_ranks"))
    inside = Window.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    chosen = bucketed.join(small(wanted.select(*keys, "_b")), [*keys, "_b"], "left_semi")
    # a value that fills a third of the rows becomes one row of each task
    merged = chosen.groupBy(*keys, "_b", "_v").agg(F.count(F.lit(1)).alias("_c"))
    ranked = merged.join(small(wanted), [*keys, "_b"]).withColumn("_end", F.col("_before") + F.sum("_c").over(inside))
    hits = ranked.withColumn(
        "_rank", F.explode(F.filter("_ranks", lambda r: (r >= F.col("_end") - F.col("_c")) & (r < F.col("_end"))))
    )
    found = hits.groupBy(*keys).agg(
        F.max("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_at")
    )

    def quantile(p: float):
        x = (F.col("n") - 1) * p
        low, high = F.element_at("_at", F.floor(x)), F.element_at("_at", F.ceil(x))
        return low + (high - low) * (x - F.floor(x))

    return found.select(*keys, "n", F.array(*[quantile(p) for p in probabilities]).alias("quantiles"))
