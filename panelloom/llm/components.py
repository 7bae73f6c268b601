"""Connected components of a large edge list by contraction to random local minima.

Every round gives each node a pseudo-random rank and points it at the node of least rank within two hops, then once
more along the pointers, and replaces the ends of every edge by what they point at. On a path, in whatever order its
ids stand, about one node in four is left; a star is one node after a round. So the rounds grow with the logarithm of
the largest component, not with its diameter. Nodes and edges left over shrink with them, and the first round costs most.

Every step is an aggregate that combines before its shuffle or a join on nodes, whose hot side (a hub's edges) adaptive
execution splits. What a round leaves is written to the shared folder and read again, so the next plan starts from the
sizes of files: lost executors cost a task, and plans and size estimates do not grow from round to round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelloom.llm.common import shared_folder


def _ranked(node: Column, number: int) -> Column:
    return F.struct(F.xxhash64(node, F.lit(number)).alias("rank"), node.alias("node"))


def contractions(edges: DataFrame) -> list[DataFrame]:
    """``node, root`` of every round: the roots of a round are the nodes of the next. Edges are ``a, b`` (longs)."""
    spark = edges.sparkSession
    folder = shared_folder(spark, "components")

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    def simple(a: str, b: str) -> list[Column]:
        return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]

    edges = kept(edges.select(*simple("a", "b")).filter("a < b").distinct(), "edges")
    rounds: list[DataFrame] = []
    while not edges.isEmpty():
        n = len(rounds)
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hop = both.groupBy("a").agg(F.min(_ranked(F.col("b"), n)).alias("_least"))
        hop = kept(hop.select(F.col("a").alias("node"), F.least("_least", _ranked(F.col("a"), n))["node"].alias("near")), f"near-{n}")
        second = both.join(hop.select(F.col("node").alias("b"), "near"), "b").groupBy(F.col("a").alias("node")).agg(F.min(_ranked(F.col("near"), n)).alias("_least"))
        up = hop.join(second, "node").select("node", F.least("_least", _ranked(F.col("near"), n))["node"].alias("root"))
        up = kept(up, f"up-{n}")
        further = up.select(F.col("node").alias("root"), F.col("root").alias("_next"))
        up = kept(up.join(further, "root").select("node", F.col("_next").alias("root")), f"root-{n}")
        rounds.append(up)
        moved = edges.join(up.select(F.col("node").alias("a"), F.col("root").alias("_a")), "a")
        moved = moved.join(up.select(F.col("node").alias("b"), F.col("root").alias("_b")), "b")
        edges = kept(moved.select(*simple("_a", "_b")).filter("a < b").distinct(), f"edges-{n}")
    for n in range(len(rounds) - 2, -1, -1):  # a root that the next round points on
        last = rounds[n + 1].select(F.col("node").alias("root"), F.col("root").alias("_last"))
        rounds[n] = kept(rounds[n].join(last, "root", "left").select("node", F.coalesce("_last", "root").alias("root")), f"last-{n}")
    return rounds


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of the edges ``a, b`` (longs): the root is one node of its component."""
    rounds = contractions(edges)
    return rounds[0] if rounds else edges.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0)
