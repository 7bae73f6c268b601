"""Exact top-k search by inner product, with KD-trees over shards that are themselves the leaves of a KD-tree.

The top of the tree is cut from a bounded sample of the rows (``SAMPLE_ROWS``): median splits of the widest dimension,
one leaf for about ``SHARD_ROWS`` rows. Every row is dealt to its leaf, and the tight box around the rows of each leaf
is worked out over all of them, so the sample steers sizes only. A leaf that came out large, as when a third of all
vectors are equal, is dealt out in pieces that share its box.

In a shard the tree goes on: it halves its rows at the median of the widest dimension down to leaves of ``LEAF`` rows
with a tight box each. For a query, a box bounds the inner product by taking the upper or lower side of each dimension
by the sign of the query's component. A query first searches the shard of best bound; the k-th score found there travels
with it, and it is sent to the other shards only if their box can reach that score. Within a shard nodes are opened best
bound first until no bound reaches the k-th score so far.

Vectors are turned into integers ``floor(SCALE * x)``, so scores are exact integers; ties go to the smaller id.
Rows with a null id, a null vector, or null or non-finite components take no part. Only vectors of the same length
are compared. A query leaves out rows of its own id; equal candidate rows all count. A query with fewer candidates
than k gets all of them. No rows give no rows. Where sums pass 2 ** 53, scores are whole numbers of Python and bounds
are widened by what doubles may round away; scores stop at the limits of a long.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelloom.session import checkpointed

SCALE = 256
LEAF = 256
#: Rows of a shard on average; rows, numbers and leaves of the sampled top of the tree; the shards of a small table.
SHARD_ROWS = 1 << 16
SAMPLE_ROWS = 1 << 15
SAMPLE_VALUES = 1 << 22
MAX_LEAVES = 1 << 11
LEAST_SHARDS = 24
LEAST_ROWS = 1 << 9
_LIMIT = 2.0**53


class KDTree:
    """Rows of ``vectors`` (float64 with whole values) in median-split order, with a box per node."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF):
        order = np.arange(len(ids))
        self.spans: list[tuple[int, int]] = []
        self.children: list[tuple[int, int] | None] = []
        low, high = [], []

        def build(a: int, b: int) -> int:
            node = len(self.spans)
            part = vectors[order[a:b]]
            self.spans.append((a, b))
            self.children.append(None)
            low.append(part.min(axis=0))
            high.append(part.max(axis=0))
            if b - a > leaf:
                # halves by place, so equal values cannot stop the splitting
                widest = int(np.argmax(high[node] - low[node])) if part.shape[1] else 0
                middle = (b - a) // 2
                if part.shape[1]:
                    order[a:b] = order[a:b][np.argpartition(part[:, widest], middle)]
                self.children[node] = (build(a, a + middle), build(a + middle, b))
            return node

        build(0, len(ids))
        self.ids, self.vectors = ids[order], vectors[order]
        self.low, self.high = np.array(low), np.array(high)
        self.largest = float(np.abs(vectors).max(initial=0.0))

    def search(self, queries: np.ndarray, own: np.ndarray, known: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids and scores of the best rows for each query; none that is below the ``known`` k-th score."""
        exact = self.largest * float(np.abs(queries).max(initial=0.0)) * max(1, queries.shape[1]) < _LIMIT
        bounds = box_bounds(queries, self.low, self.high)
        for q, mine, floor, bound in zip(queries, own, known, bounds, strict=True):
            yield self._best_first(q, mine, floor, bound, k, exact)

    def _best_first(self, q, mine, floor, bound, k, exact) -> tuple[np.ndarray, np.ndarray]:
        open_nodes = [(-bound[0], 0)]
        whole = q if exact else np.array([int(x) for x in q], object)
        ids, scores = np.empty(0, np.int64), np.empty(0, float if exact else object)
        while open_nodes:
            reach, node = heapq.heappop(open_nodes)
            if -reach < floor:
                break
            if self.children[node] is not None:
                for child in self.children[node]:
                    if bound[child] >= floor:
                        heapq.heappush(open_nodes, (-bound[child], child))
                continue
            a, b = self.spans[node]
            part = self.vectors[a:b]
            got = part @ whole if exact else np.array([[int(x) for x in v] for v in part], object).reshape(part.shape) @ whole
            fits = (got >= floor) & (self.ids[a:b] != mine) if exact else self.ids[a:b] != mine
            if not fits.any():
                continue
            ids, scores = np.concatenate([ids, self.ids[a:b][fits]]), np.concatenate([scores, got[fits]])
            if len(ids) > k:
                best = np.lexsort((ids, -scores))[:k] if exact else sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k]
                ids, scores = ids[best], scores[best]
            if len(ids) == k:
                floor = max(floor, float(min(scores)))
        return ids, scores


def box_bounds(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Upper bounds of the inner products of queries with anything inside each box; never below the exact ones."""
    with np.errstate(all="ignore"):
        bounds = np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T
        size = np.abs(queries) @ np.maximum(np.abs(low), np.abs(high)).T
        # whole numbers below 2 ** 53 are exact; beyond, a sum of d products is off by d roundings of its size at most
        bounds = np.where(size < _LIMIT, bounds, bounds + size * (queries.shape[1] + 2) * 2.0**-51)
    return np.where(np.isnan(bounds), np.inf, bounds)


class TopSplits:
    """The upper part of a KD-tree, cut from sampled vectors; rows are dealt to its leaves."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.nodes: list[tuple[int, float, int, int]] = []  # axis, value, and where smaller and other values go; ~leaf ends
        self.leaves = 0
        self.root = self._cut(sample, leaves)

    def _cut(self, rows: np.ndarray, leaves: int) -> int:
        spread = rows.max(axis=0) - rows.min(axis=0) if rows.size else np.zeros(1)
        if leaves <= 1 or len(rows) < 2 or not spread.max() > 0:
            self.leaves += 1
            return ~(self.leaves - 1)
        axis = int(np.argmax(spread))
        column = np.sort(rows[:, axis])
        value = column[len(column) // 2]
        if value == column[0]:  # something must stay below
            value = column[np.searchsorted(column, value, "right")]
        below = rows[:, axis] < value
        node = len(self.nodes)
        self.nodes.append((axis, float(value), 0, 0))
        left = self._cut(rows[below], leaves // 2)
        right = self._cut(rows[~below], leaves - leaves // 2)
        self.nodes[node] = (axis, float(value), left, right)
        return node

    def leaf_of(self, vectors: np.ndarray) -> np.ndarray:
        at = np.full(len(vectors), self.root)
        if not self.nodes:
            return ~at
        axis, value, left, right = (np.array(column) for column in zip(*self.nodes, strict=True))
        while len(open_ := np.flatnonzero(at >= 0)):
            node = at[open_]
            at[open_] = np.where(vectors[open_, axis[node]] < value[node], left[node], right[node])
        return ~at


def usable(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = SCALE) -> DataFrame:
    """``_row, id, dim, vector`` of the rows that take part; vectors in whole doubles."""
    bad = F.exists(vector_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).filter(~bad)
    scaled = F.transform(vector_col, lambda x: x.cast("double") * float(scale))
    return rows.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).cast("long").alias("id"), F.size(vector_col).alias("dim"), scaled.alias("vector"))


_HITS = "query_row long, query_id long, id long, score long"


def _search_shards(candidates: DataFrame, queries: DataFrame, k: int, shards: int) -> DataFrame:
    """Hits of queries in the shards they were sent to; both tables hold ``_shard``, queries also ``_floor``."""
    both = candidates.withColumns({"_floor": F.lit(None).cast("double"), "_kind": F.lit(0)}).unionByName(queries.withColumn("_kind", F.lit(1)))
    ordered = both.repartition(shards, "_shard").sortWithinPartitions("_shard", "dim", "_kind")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, rows, tree = None, [], None
        for batch in batches:
            for key, part in batch.groupby(["_shard", "dim", "_kind"]):
                vectors = np.floor(np.stack(part["vector"].to_numpy())).reshape(len(part), key[1])
                if key[:2] != at:
                    at, rows, tree = key[:2], [], None
                if key[2] == 0:
                    rows.append((part["id"].to_numpy(np.int64), vectors))
                    continue
                if not rows and tree is None:
                    continue
                if tree is None:
                    tree = KDTree(np.concatenate([i for i, _ in rows]), np.concatenate([v for _, v in rows]))
                    rows = []
                found = list(tree.search(vectors, part["id"].to_numpy(np.int64), part["_floor"].fillna(-np.inf).to_numpy(float), k))
                sizes = [len(i) for i, _ in found]
                yield pd.DataFrame({
                    "query_row": np.repeat(part["_row"].to_numpy(np.int64), sizes),
                    "query_id": np.repeat(part["id"].to_numpy(np.int64), sizes),
                    "id": np.concatenate([i for i, _ in found]).astype(np.int64),
                    "score": np.array([min(max(int(s), -(2**63)), 2**63 - 1) for _, v in found for s in v], np.int64),
                })

    return ordered.mapInPandas(run, _HITS)


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_row").orderBy(F.col("score").desc(), "id")
    return hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


class ShardPlan:
    """Where rows lie and where queries go: the top of the tree for each vector length, boxes and pieces of its leaves."""

    def __init__(self, rows: DataFrame, shard_rows: int = SHARD_ROWS):
        counts = {r["dim"]: r["n"] for r in rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
        drawn = min(SAMPLE_ROWS, SAMPLE_VALUES // max(1, max(counts, default=1)))
        sample = rows.orderBy(F.xxhash64("id", "vector")).limit(drawn).select("dim", "vector").toPandas()
        self.tops: dict[int, tuple[int, TopSplits]] = {}
        first = 0
        for dim, part in sample.groupby("dim"):
            n = counts[dim]
            leaves = min(MAX_LEAVES, max(-(-n // shard_rows), min(LEAST_SHARDS, -(-n // LEAST_ROWS))))
            top = TopSplits(_matrix(part["vector"], dim), leaves)
            self.tops[dim] = (first, top)
            first += top.leaves
        for dim in set(counts) - set(self.tops):  # a length that the sample does not hold
            self.tops[dim] = (first, TopSplits(np.zeros((0, dim)), 1))
            first += 1
        self.leaves = first

    def dealt(self, rows: DataFrame) -> DataFrame:
        """Rows with the ``_leaf`` they lie in."""
        tops = self.tops

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                leaf = np.zeros(len(batch), np.int64)
                for dim, at in batch.groupby("dim").indices.items():
                    offset, top = tops[dim]
                    leaf[at] = offset + top.leaf_of(_matrix(batch["vector"].iloc[at], dim))
                yield batch.assign(_leaf=leaf)

        return rows.mapInPandas(run, "_row long, id long, dim int, vector array<double>, _leaf long")

    def measure(self, dealt: DataFrame, shard_rows: int = SHARD_ROWS) -> None:
        """Sizes and tight boxes of all leaves, over all rows: ``leaves x dimensions`` numbers come to the driver."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for (leaf, dim), at in batch.groupby(["_leaf", "dim"]).indices.items():
                    part = _matrix(batch["vector"].iloc[at], dim)
                    yield pd.DataFrame({"leaf": leaf, "i": np.arange(-1, dim), "low": np.append(len(part), part.min(axis=0)), "high": np.append(0.0, part.max(axis=0))})

        parts = dealt.select("_leaf", "dim", "vector").mapInPandas(run, "leaf long, i int, low double, high double")
        found = parts.groupBy("leaf", "i").agg(F.sum(F.when(F.col("i") < 0, F.col("low"))).alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).toPandas()
        sizes = np.zeros(self.leaves, np.int64)
        heads = found[found["i"] < 0]
        sizes[heads["leaf"].to_numpy()] = heads["n"].to_numpy()
        self.pieces = np.where(sizes > 2 * shard_rows, -(-sizes // shard_rows), 1)
        self.first_shard = np.cumsum(self.pieces) - self.pieces
        self.shards = int(self.pieces.sum())
        self.boxes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        body = found[found["i"] >= 0].sort_values(["leaf", "i"])
        for dim, (offset, top) in self.tops.items():
            leaves = np.array([leaf for leaf in range(offset, offset + top.leaves) if sizes[leaf]], np.int64)
            own = body[body["leaf"].isin(leaves)]
            self.boxes[dim] = (leaves, *(own[side].to_numpy().reshape(len(leaves), dim) for side in ("low", "high")))

    def shard(self, leaf: Column, row: Column) -> Column:
        """The shard of a row: its leaf, or one piece of a large leaf."""
        pieces = F.get(F.lit(self.pieces.tolist()), leaf.cast("int"))
        return F.get(F.lit(self.first_shard.tolist()), leaf.cast("int")) + F.pmod(F.xxhash64(row), pieces)

    def sent(self, queries: DataFrame, known: bool) -> DataFrame:
        """A row for each query and shard to search: the shard of best bound, or (``known``) all others that can reach ``_floor``."""
        shared = queries.sparkSession.sparkContext.broadcast((self.boxes, self.pieces, self.first_shard))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            boxes, pieces, first_shard = shared.value
            for batch in batches:
                for dim, at in batch.groupby("dim").indices.items():
                    leaves, low, high = boxes[dim]
                    part = batch.iloc[at]
                    for some in np.array_split(np.arange(len(part)), -(-len(part) * len(leaves) // _PAIRS)):
                        few = part.iloc[some]
                        bounds = box_bounds(np.floor(_matrix(few["vector"], dim)), np.floor(low), np.floor(high))
                        home = bounds.argmax(axis=1)
                        home_piece = few["_row"].to_numpy() % pieces[leaves[home]]
                        if not known:
                            yield few.assign(_shard=first_shard[leaves[home]] + home_piece)
                            continue
                        reached = bounds >= few["_floor"].fillna(-np.inf).to_numpy(float)[:, None]
                        q, box = np.nonzero(reached)
                        n = pieces[leaves[box]]
                        q, box, piece = np.repeat(q, n), np.repeat(box, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                        other = (box != home[q]) | (piece != home_piece[q])
                        yield few.iloc[q[other]].assign(_shard=first_shard[leaves[box[other]]] + piece[other])

        return queries.mapInPandas(run, "_row long, id long, dim int, vector array<double>, _floor double, _shard long")


#: Bounds of queries and boxes that are worked out at a time.
_PAIRS = 1 << 20


def _matrix(vectors: pd.Series, dim: int) -> np.ndarray:
    return np.concatenate(vectors.to_numpy()).reshape(len(vectors), dim) if len(vectors) and dim else np.zeros((len(vectors), dim))


def top_k(rows: DataFrame, is_query: Column, k: int = 5, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``query_id, rank, id, score``: the best ``k`` rows of ``usable`` for each of its rows that is a query."""
    plan = ShardPlan(rows, shard_rows)
    dealt = checkpointed(plan.dealt(rows))
    plan.measure(dealt, shard_rows)
    if not plan.shards:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, id long, score long")
    candidates = dealt.withColumn("_shard", plan.shard(F.col("_leaf"), F.col("_row"))).drop("_leaf")
    queries = dealt.filter(is_query).drop("_leaf").withColumn("_floor", F.lit(None).cast("double"))
    first = checkpointed(_search_shards(candidates, plan.sent(queries, False), k, plan.shards))
    kth = first.groupBy("query_row").agg(F.when(F.count(F.lit(1)) >= k, F.min("score").cast("double")).alias("_floor"))
    floored = queries.drop("_floor").join(kth, queries["_row"] == kth["query_row"], "left").drop("query_row")
    rest = _search_shards(candidates, plan.sent(floored, True), k, plan.shards)
    return _ranked(first.unionByName(rest), k).select("query_id", "rank", "id", "score")
