"""Order-dependent work on groups with no size bound: split one group over many tasks.

Raw ticks and logs may put a third of all rows under one key. A plain window would sort that key in one
task. Here the group is cut into blocks along its own order:

* ``with_row_index`` numbers the rows of every group. A group above ``BLOCK_ROWS`` rows is cut at edges sampled from
  its own order, at most ``EDGES`` of them, and a piece of more than twice that once more; rows are counted per block
  with a map-side combine, and the counts are summed up in two levels, so no task holds more than ``EDGES`` counts or
  about twice ``BLOCK_ROWS`` rows of a group of up to ``EDGES ** 2 * BLOCK_ROWS``. Rows of a table with such a group are
  stored once, as they are then read several times.
* ``with_halo`` cuts the numbered rows into chunks of equal size and copies the last few rows of each chunk
  into the next one, so a window that looks back a bounded number of rows can run per chunk.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelloom.session import checkpointed, stored

BLOCK_ROWS = 1 << 20
CHUNK_ROWS = 1 << 16
EDGES = 1 << 10
#: Sampled rows for each edge; the more, the more even the blocks.
SAMPLES = 32
#: Groups whose edges may be broadcast; more are joined by a shuffle, whose hot keys adaptive execution splits.
BROADCAST_GROUPS = 200


def sequence_block(seq: str, rows: int = BLOCK_ROWS) -> Column:
    """Block number of a sequence column that is unique in its group: at most ``rows`` rows per block."""
    return F.floor(F.col(seq) / rows).cast("bigint")


def _sizes_above(df: DataFrame, groups: Sequence[str], block_rows: int) -> DataFrame | None:
    """``groups, _rows, _blocks`` of the groups above ``block_rows`` rows; None without any."""
    sizes = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > block_rows)
    sizes = checkpointed(sizes.withColumn("_blocks", F.least(F.ceil(F.col("_rows") / block_rows), F.lit(EDGES))))
    return None if sizes.isEmpty() else sizes


def _edges_of(df: DataFrame, sizes: DataFrame, groups: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``groups, _edges`` of the groups in ``sizes``: sorted order values that cut them evenly.

    Rows are sampled by a hash of group and order, so a retry draws the same; any edges give the same numbers.
    """
    found = sizes.limit(BROADCAST_GROUPS + 1).count()
    place = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])
    draw = F.pmod(F.xxhash64(*groups, *order), F.lit(1 << 40)) / float(1 << 40)
    sized = df.select(*groups, *order).join(F.broadcast(sizes) if found <= BROADCAST_GROUPS else sizes, list(groups))
    sampled = sized.filter(draw < F.col("_blocks") * SAMPLES / F.col("_rows")).groupBy(*groups).agg(
        F.array_sort(F.collect_list(place)).alias("_sample"), F.first("_blocks").alias("_blocks")
    )
    count = F.size("_sample")
    cut = F.transform(F.sequence(F.lit(1), (F.col("_blocks") - 1).cast("int")), lambda i: F.get("_sample", F.floor(i * count / F.col("_blocks")).cast("int")))
    return checkpointed(sampled.select(*groups, F.array_distinct(cut).alias("_edges")))


def _add_block(df: DataFrame, edges: str, order: Sequence[str], most: int, name: str) -> DataFrame:
    """How many of the sorted edges, ``most`` at most, lie at or below the row; 0 without edges.

    Halving in plain steps, one column each: a lambda over the steps is interpreted, some 20 us a row.
    """
    place = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])
    df = df.withColumn(name, F.lit(0))
    for bit in reversed(range(most.bit_length())):
        # structs compare like the order: missing values come first; beyond the last edge there is none
        below = F.get(edges, F.col(name) + ((1 << bit) - 1)) <= place
        df = df.withColumn(name, F.when(below, F.col(name) + (1 << bit)).otherwise(F.col(name)))
    return df


def _cut(df: DataFrame, groups: Sequence[str], order: Sequence[str], block_rows: int, name: str, keep: bool = False) -> tuple[DataFrame, bool]:
    """Adds the block; with ``keep`` the rows are stored first when any group is cut, as they are read many times then."""
    sizes = _sizes_above(df, groups, block_rows)
    if sizes is None:
        return df.withColumn(name, F.lit(0)), False
    if keep:
        df = stored(df, "rows")
    edges = _edges_of(df, sizes, groups, order)
    found = edges.agg(F.count(F.lit(1)).alias("groups"), F.max(F.size("_edges")).alias("most")).first()
    joined = df.join(F.broadcast(edges) if found["groups"] <= BROADCAST_GROUPS else edges, list(groups), "left")
    return _add_block(joined, "_edges", order, found["most"] or 0, name).drop("_edges"), True


def with_row_index(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "row_index", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Number rows of each group from 0 along ``order``, missing values first. Keys must not be NULL."""
    levels = ["_block_piece", "_part"]
    tagged, large = _cut(df, keys, order, block_rows, levels[0], keep=True)
    # a draw leaves half of the pieces somewhat above the mean; only what is twice too large is worth a second cut
    tagged = _cut(tagged, [*keys, levels[0]], order, 2 * block_rows, levels[1])[0] if large else tagged.withColumn(levels[1], F.lit(0))
    inside = F.row_number().over(Window.partitionBy(*keys, *levels).orderBy(*order)) - 1
    if not large:
        return tagged.withColumn(name, inside.cast("bigint")).drop(*levels)

    def before(groups: list[str], by: str, out: str) -> Column:
        earlier = Window.partitionBy(*groups).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(out).over(earlier), F.lit(0))

    blocks = tagged.groupBy(*keys, *levels).agg(F.count(F.lit(1)).alias("_rows"))
    blocks = blocks.withColumn("_in_piece", before([*keys, levels[0]], levels[1], "_rows"))
    pieces = blocks.groupBy(*keys, levels[0]).agg(F.sum("_rows").alias("_size"))
    pieces = pieces.withColumn("_in_group", before(list(keys), levels[0], "_size"))
    offsets = blocks.join(pieces, [*keys, levels[0]]).select(*keys, *levels, (F.col("_in_piece") + F.col("_in_group")).alias("_before"))
    # plain equality keeps the rows where the window needs them, so there is no further shuffle
    numbered = tagged.join(offsets, [*keys, *levels]).withColumn(name, F.col("_before") + inside)
    return numbered.drop("_before", *levels)


def with_halo(
    df: DataFrame,
    before: int,
    index: str = "row_index",
    chunk_rows: int = CHUNK_ROWS,
    chunk: str = "chunk",
    own: str = "is_own",
) -> DataFrame:
    """Tag rows with a chunk number; the last ``before`` rows of a chunk also appear in the next one.

    Window by (keys, chunk), then keep rows with ``is_own``. Copies add ``before / chunk_rows`` to the rows.
    """
    if before >= chunk_rows:
        raise ValueError("a chunk must be longer than the rows a window looks back")
    home = F.floor(F.col(index) / chunk_rows).cast("bigint")
    lends = F.col(index) % chunk_rows >= chunk_rows - before
    homes = F.when(lends, F.array(home, home + 1)).otherwise(F.array(home))
    return df.withColumn(chunk, F.explode(homes)).withColumn(own, F.col(chunk) == home)
