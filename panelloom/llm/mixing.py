"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

A schedule of slots decides the mix. Slot ``n`` maps the van der Corput point of ``n`` (its binary digits
mirrored at the point) through the cumulative target shares to a source, so every prefix of the schedule comes
within a few slots of all shares. The rank of a slot among its source's slots chooses the block: each source's
documents stand in a shuffled order, their words form one stream, and the stream is cut into blocks of
``BLOCK_WORDS`` words. Ranks past the last block start over, twice at most; a slot past that is left empty.

A source may hold any share of the rows: stream positions and slot ranks are sums over bounded buckets plus a
rank inside a bucket, and blocks are joined on source and block number. Documents without words take no part
and count as taken 0. Equal rows are separate documents. The order depends on doc_id, size and seed only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelloom.llm.common import join_small, n_words, row_hash, row_struct
from panelloom.session import checkpointed

BLOCK_WORDS = 64
#: Documents in a bucket of a source's shuffled order, and slots in a stretch of the schedule, at most on average.
BUCKET_ROWS = 4_000
STRETCH = 1 << 16
#: Bits of a schedule point; also the limit of the number of slots.
POINT_BITS = 40
CELLS = 1 << 12
MAX_PASSES = 2


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, limit: float = MAX_PASSES
) -> DataFrame:
    """``source, source_size`` to ``source_no, weight, target``: shares of the total by weight, each capped.

    Sources stand in code point order, null last, and take the weights in turn. A target stops at ``limit`` times
    the source's size and what it cannot take is shared anew by weight. The fixed point is found at once: in order
    of capacity per weight the capped sources come first, and the rest divide what these leave. The rows of this
    table are the sources, so its windows hold one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_room = Window.orderBy("_room", "source_no")
    df = sizes.withColumn("source_no", F.row_number().over(by_name) - 1)
    turn = F.array(*[F.lit(float(w)) for w in weights])
    df = df.withColumn("weight", F.get(turn, F.pmod("source_no", F.lit(len(weights)))))
    df = df.withColumns({"_cap": F.col("source_size") * F.lit(float(limit)), "_total": F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share))})
    df = df.withColumn("_room", F.col("_cap") / F.col("weight"))
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    after = by_room.rowsBetween(0, Window.unboundedFollowing)
    left = F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    df = df.withColumn("_level", left / F.sum("weight").over(after))
    # the level at the first source that is not capped holds for all later ones
    level = F.first(F.when(F.col("_level") <= F.col("_room"), F.col("_level")), ignorenulls=True).over(by_room.rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumn("target", F.coalesce(F.least(F.col("_cap"), F.col("weight") * level), F.col("_cap")))
    return df.select("source", "source_no", "source_size", "weight", "target")


def _stream_starts(docs: DataFrame, total_rows: int, seed: int, bucket_rows: int) -> DataFrame:
    """First word of each document in the shuffled stream of its source."""
    buckets = max(1, -(-total_rows // bucket_rows))
    key = F.xxhash64(F.lit(seed), "doc_id", "size")
    docs = docs.withColumn("_key", key)
    docs = docs.withColumn("_bucket", F.floor(F.shiftrightunsigned("_key", 32) * F.lit(buckets) / F.lit(float(1 << 32))).cast("long"))
    sums = checkpointed(docs.groupBy("source_no", "_bucket").agg(F.sum("size").alias("_sum")))
    before = Window.partitionBy("source_no").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = checkpointed(sums.select("source_no", "_bucket", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before")))
    inside = Window.partitionBy("source_no", "_bucket").orderBy("_key", "doc_id", "size", "_row").rowsBetween(Window.unboundedPreceding, -1)
    placed = join_small(docs.withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0))), offsets, ["source_no", "_bucket"])
    return placed.withColumn("start", F.col("_before") + F.col("_inside")).drop("_key", "_bucket", "_before", "_inside")


def _point(n: Column) -> Column:
    """Van der Corput point of ``n`` in base 2, as an integer below 2 ** POINT_BITS."""
    mirrored = F.reverse(F.lpad(F.bin(n), POINT_BITS, "0"))
    return F.conv(mirrored, 2, 10).cast("long")


def schedule(spark, targets: DataFrame, slots: int, stretch: int = STRETCH) -> DataFrame:
    """``slot, source_no, rank``: the source of each slot and its rank among that source's slots."""
    scale = float(1 << POINT_BITS)
    by_no = Window.orderBy("source_no")
    share = F.sum("target").over(by_no.rowsBetween(Window.unboundedPreceding, 0)) / F.sum("target").over(Window.partitionBy())
    ends = targets.filter("target > 0").select("source_no", F.round(share * scale).cast("long").alias("_end"))
    ends = ends.withColumn("_from", F.coalesce(F.lag("_end").over(by_no), F.lit(0)))
    # a share covers some cells of the unit interval, so that points find their source by an equality join
    width = (1 << POINT_BITS) // CELLS
    cells = ends.filter("_from < _end").withColumn("_cell", F.explode(F.sequence(F.floor(F.col("_from") / width), F.floor((F.col("_end") - 1) / width))))
    cells = checkpointed(cells)
    points = spark.range(slots).select(F.col("id").alias("slot"), _point(F.col("id")).alias("_at"))
    points = points.withColumns({"_cell": F.floor(F.col("_at") / width), "_stretch": F.floor(F.col("slot") / stretch)})
    found = join_small(points, cells, ["_cell"]).filter("_at >= _from and _at < _end").select("slot", "source_no", "_stretch")
    counts = checkpointed(found.groupBy("source_no", "_stretch").agg(F.count(F.lit(1)).alias("_n")))
    before = Window.partitionBy("source_no").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    offsets = checkpointed(counts.select("source_no", "_stretch", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))
    inside = Window.partitionBy("source_no", "_stretch").orderBy("slot")
    ranked = join_small(found.withColumn("_inside", F.row_number().over(inside) - 1), offsets, ["source_no", "_stretch"])
    return ranked.select("slot", "source_no", (F.col("_before") + F.col("_inside")).alias("rank"))


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    block_words: int = BLOCK_WORDS,
    seed: int = 42,
    bucket_rows: int = BUCKET_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """Mix documents given as ``doc_id, source, size``; more columns are carried along in the struct ``row``.

    Returns the mix, one row per slot and document piece (``slot, source_no, pass, _row, first, length``: words
    ``first`` up to ``first + length`` of the document), and the documents with ``_row, source_size, target``.
    """
    spark = docs.sparkSession
    others = row_struct(docs, "doc_id", "source", "size").alias("row")
    docs = checkpointed(docs.select("doc_id", "source", F.col("size").cast("long").alias("size"), others, F.monotonically_increasing_id().alias("_row")))
    sums = docs.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_rows"))
    sums = checkpointed(sums)
    targets = checkpointed(source_targets(sums.drop("_rows"), weights, share))
    of_source = F.col("d.source").eqNullSafe(F.col("t.source"))
    known = join_small(docs.alias("d"), targets.alias("t"), of_source).select("d.*", "source_no", "source_size", "target")
    total = sums.agg(F.sum("_rows").alias("rows"), F.sum("source_size").alias("words")).first()
    slots = int(round((total["words"] or 0) * share / block_words))
    if slots > 1 << POINT_BITS:
        raise ValueError(f"{slots} slots need more than {POINT_BITS} bits; take longer blocks")
    starts = _stream_starts(known.filter("size > 0"), total["rows"] or 0, seed, bucket_rows)
    block = F.explode(F.sequence(F.floor(F.col("start") / block_words), F.floor((F.col("start") + F.col("size") - 1) / block_words)))
    pieces = starts.withColumn("_block", block)
    begin = F.greatest("start", F.col("_block") * block_words)
    end = F.least(F.col("start") + F.col("size"), (F.col("_block") + 1) * block_words)
    pieces = pieces.select("source_no", "_block", "_row", (begin - F.col("start")).alias("first"), (end - begin).alias("length"))
    blocks = targets.select("source_no", F.ceil(F.col("source_size") / block_words).alias("_blocks"))
    used = join_small(schedule(spark, targets, slots), checkpointed(blocks), ["source_no"])
    used = used.withColumns({"pass": F.floor(F.col("rank") / F.col("_blocks")), "_block": F.col("rank") % F.col("_blocks")})
    used = used.filter(F.col("pass") < MAX_PASSES).select("slot", "source_no", "pass", "_block")
    return used.join(pieces, ["source_no", "_block"]).drop("_block"), known


def taken_words(docs: DataFrame, **how) -> DataFrame:
    """One row per document: ``doc_id, source, size, row, source_size, target, taken`` (words in the mix, with repeats)."""
    pieces, known = mix(docs, **how)
    taken = pieces.groupBy("_row").agg(F.sum("length").alias("taken"))
    out = known.join(taken, "_row", "left")
    return out.withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long")).drop("_row", "source_no")


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, rounded to whole documents (0, 1 or 2 times).

    What the mix takes of the words of a document decides, so a source's words stay within a document of its
    target per pass. Documents without words are in no mix.
    """
    rows = docs.select(row_struct(docs).alias("row"), "doc_id", "source", n_words(F.col("text")).alias("size"), row_hash(docs).alias("key"))
    copies = F.floor(F.col("taken") / F.greatest("size", F.lit(1)) + 0.5).cast("int")
    taken = taken_words(rows.select("doc_id", "source", "size", "key"), **how)
    taken = taken.groupBy("doc_id", F.col("row.key").alias("key")).agg(F.sum(copies).alias("copies")).filter("copies > 0")
    taken = taken.select(F.col("doc_id").alias("taken_id"), F.col("key").alias("taken_key"), "copies")
    met = rows.join(taken, F.col("doc_id").eqNullSafe(F.col("taken_id")) & (F.col("key") == F.col("taken_key")))
    # equal rows share the sum of their copies
    once = met.dropDuplicates(["doc_id", "key"])
    return once.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
