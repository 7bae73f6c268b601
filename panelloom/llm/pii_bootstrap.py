"""Personal data by bootstrapped contextual extraction, in DataFrame operations alone.

Base patterns find e-mail and IP addresses, card and phone numbers, and a check drops false ones. These spans are
kept whatever follows. They also seed the discovery of identifiers that the base patterns miss: tokens with a
digit or ``@`` outside of base spans, of a shape that could be of a kind (``SHAPES``). A lexical pattern is the word
before or after an identifier. Patterns and distinct values form a graph, scored in ``ROUNDS`` rounds: the
confidence of a pattern for a kind is the weight of its values of that kind over the weight of all its values,
numbers of no kind included; the score of an unknown value is the chance that one of its confident patterns
is right. Patterns need ``MIN_SEEDS`` different seed values and ``MIN_CONFIDENCE``; values with ``MIN_SCORE`` become spans.

Places come from the lengths of the pieces between matches, summed per document in a window, so a document with very many matches
costs no more than its length. The regular expressions are possessive and start at token edges: they run in linear
time and without recursion. Hot words and values are summed before each shuffle, and joins broadcast counted small
tables only. Context words are compared by their ``CONTEXT_CHARS`` characters next to the identifier.

Null texts count as empty and give no spans. Positions are code points, the end exclusive. Equal rows get equal
spans. An empty table gives no rows. Ties between kinds go to the first of ``KINDS``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelloom.llm.common import SPACES, join_small, row_struct
from panelloom.session import checkpointed

# Kinds in the order of results, and their patterns (with possessive quantifiers, where nothing can be given back).
KINDS = ("email", "ip", "card", "phone")
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Tokens that may be identifiers, and what a token must look like to be taken for a kind.
CANDIDATE = rf"(?<![^{SPACES}])[^{SPACES}0-9@]*+[0-9@][^{SPACES}]*+"
CORE = r"(?s)[A-Za-z0-9+(].*[A-Za-z0-9]|[A-Za-z0-9]"
SHAPES = {
    "email": r"^[^@]+@[A-Za-z0-9-]+$",
    "ip": r"^(?=.*[0-9])[0-9A-Fa-f]*(?:[.:][0-9A-Fa-f]+){3,}$",
    "card": r"^[0-9](?:-?[0-9]){12,18}$",
    "phone": r"^\(?[0-9](?:[().-]{0,2}[0-9]){6,14}$",
}
CONTEXT_CHARS = 48
ROUNDS = 3
MIN_SEEDS = 3
MIN_CONFIDENCE = 0.6
MIN_SCORE = 0.75
_OTHER = len(KINDS)


def _valid(kind: Column, hit: Column) -> Column:
    """The check of a base match; candidates pass."""
    parts = F.transform(F.split(hit, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
    ip = F.forall(parts, lambda p: (F.length(p) <= 3) & (F.lpad(p, 3, "0") <= "255"))
    digits = F.regexp_replace(hit, "[^0-9]", "")
    card = F.length(digits).between(16, 19) & F.call_function("luhn_check", digits)
    return F.when(kind == 1, ip).when(kind == 2, card).when(kind == 3, F.length(digits).between(8, 15)).otherwise(True)


def _pieces(text: Column, number: int, pattern: str) -> dict[str, Column]:
    return {f"_gaps{number}": F.split(text, pattern, -1), f"_hits{number}": F.regexp_extract_all(text, F.lit(pattern), F.lit(0))}


def _matches(number: int) -> Column:
    """Matches of a pattern: number, place in order, length of the text before, the match, and the text on both sides."""
    gaps, hits = F.col(f"_gaps{number}"), F.col(f"_hits{number}")
    zipped = F.arrays_zip(gaps.alias("gap"), hits.alias("hit"), F.slice(gaps, F.lit(2), F.greatest(F.size(gaps), F.lit(1))).alias("after"))
    made = F.transform(
        zipped,
        lambda z, i: F.struct(
            F.lit(number).alias("kind"), i.alias("i"), F.length(z["gap"]).alias("gap"), z["hit"].alias("hit"),
            F.right(z["gap"], F.lit(CONTEXT_CHARS)).alias("before"), F.left(z["after"], F.lit(CONTEXT_CHARS)).alias("after"),
        ),
    )
    return F.filter(made, lambda m: m["hit"].isNotNull())


def _word(side: Column, pattern: str) -> Column:
    word = F.regexp_extract(side, pattern, 1)
    return F.lower(F.regexp_replace(word, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))


def occurrences(docs: DataFrame) -> DataFrame:
    """Base matches and candidates of every row of ``doc_id, text``, with one row of nulls for a text without any.

    ``_row, doc_id, text_hash, kind, start, stop, value, left, right``; only valid matches. Written once.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", F.xxhash64("text").alias("text_hash"), text.alias("_text"))
    named = [*[PATTERNS[k] for k in KINDS], CANDIDATE]
    needs = {0: "@", 4: "[0-9@]"}
    split: dict[str, Column] = {}
    for number, pattern in enumerate(named):
        # a text without what every match needs is not searched
        some = F.col("_text").rlike(needs.get(number, "[0-9]"))
        split |= {n: F.when(some, c) for n, c in _pieces(F.col("_text"), number, pattern).items()}
    rows = rows.withColumns(split)
    none = F.array().cast("array<struct<kind:int,i:int,gap:int,hit:string,before:string,after:string>>")
    every = F.concat(*[F.coalesce(_matches(n), none) for n in range(len(named))])
    rows = rows.select("_row", "doc_id", "text_hash", F.explode_outer(every).alias("m")).select("_row", "doc_id", "text_hash", "m.*")
    so_far = Window.partitionBy("_row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    stop = F.sum(F.col("gap") + F.length("hit")).over(so_far)
    placed = rows.withColumn("stop", stop).withColumn("start", F.col("stop") - F.length("hit"))
    placed = placed.withColumn("_ok", _valid(F.col("kind"), F.col("hit")))
    # a candidate that meets a base span is a seed already
    in_text = Window.partitionBy("_row").orderBy("start")
    base_stop = F.when((F.col("kind") < _OTHER) & F.col("_ok"), F.col("stop"))
    base_start = F.when((F.col("kind") < _OTHER) & F.col("_ok"), F.col("start"))
    placed = placed.withColumns({
        "_earlier": F.max(base_stop).over(in_text.rangeBetween(Window.unboundedPreceding, 0)),
        "_later": F.min(base_start).over(in_text.rangeBetween(0, Window.unboundedFollowing)),
    })
    met = (F.coalesce("_earlier", F.lit(0)) > F.col("start")) | (F.coalesce(F.col("_later") < F.col("stop"), F.lit(False)))
    kept = F.col("kind").isNotNull() & F.col("_ok") & ((F.col("kind") < _OTHER) | ~met)
    core = F.when(F.col("kind") == _OTHER, F.regexp_extract("hit", CORE, 0)).otherwise(F.col("hit"))
    start = F.col("start") + F.instr(F.col("hit"), core) - 1
    found = placed.select(
        "_row", "doc_id", "text_hash", F.when(kept, F.col("kind")).alias("kind"), start.cast("long").alias("start"), core.alias("value"),
        _word(F.col("before"), rf"(?:^|[{SPACES}])([^{SPACES}]++)[{SPACES}]*+$").alias("left"),
        _word(F.col("after"), rf"^[{SPACES}]*+([^{SPACES}]++)").alias("right"),
    )
    return checkpointed(found.withColumn("stop", F.col("start") + F.length("value")))


def pattern_graph(found: DataFrame) -> DataFrame:
    """Distinct edges ``pattern, value, kind, seed, score``; kind is null for values that could be of no kind."""
    shapes = F.array_compact(F.array(*[F.when(F.col("value").rlike(SHAPES[k]), F.lit(i)) for i, k in enumerate(KINDS)]))
    kinds = F.when(F.col("kind") < _OTHER, F.array("kind")).otherwise(shapes)
    sides = F.filter(F.array(F.struct(F.lit("before").alias("side"), F.col("left").alias("word")), F.struct(F.lit("after").alias("side"), F.col("right").alias("word"))), lambda s: s["word"] != "")
    edges = found.filter("value != ''").select(
        F.xxhash64("value").alias("value"), (F.col("kind") < _OTHER).alias("seed"), kinds.alias("kinds"), F.explode(sides).alias("pattern")
    )
    edges = edges.select("pattern", "value", "seed", F.explode_outer("kinds").alias("kind")).distinct()
    return edges.withColumn("score", F.when(F.col("seed"), F.lit(1.0)).otherwise(F.lit(0.0)))


def discovered(found: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``value_hash, kind, score`` of the unknown values that the graph is sure of."""
    edges = checkpointed(pattern_graph(found))
    unknown = edges.filter("not seed and kind is not null").select("pattern", "value", "kind")
    totals = checkpointed(edges.select("pattern", "value").distinct().groupBy("pattern").agg(F.count(F.lit(1)).alias("_all")))
    scores = None
    for _ in range(rounds):
        scored = edges.filter("kind is not null")
        if scores is not None:
            scored = join_small(scored.drop("score"), scores, ["value", "kind"], "left")
            scored = scored.withColumn("score", F.when(F.col("seed"), F.lit(1.0)).otherwise(F.coalesce("score", F.lit(0.0))))
        sums = scored.groupBy("pattern", "kind").agg(
            F.sum("score").alias("_for"), F.count_if("seed").alias("_seeds"), F.count(F.lit(1)).alias("_could"), F.sum(1 - F.col("score")).alias("_open")
        ).filter(F.col("_seeds") >= MIN_SEEDS)
        sums = join_small(checkpointed(sums), totals, ["pattern"])
        # values that could be of the kind but are not known to be weigh half against a pattern
        against = F.col("_all") - F.col("_could") + 0.5 * F.col("_open") + 1.0
        sure = sums.select("pattern", "kind", (F.col("_for") / (F.col("_for") + against)).alias("confidence")).filter(F.col("confidence") >= MIN_CONFIDENCE)
        voted = join_small(unknown, checkpointed(sure), ["pattern", "kind"])
        scores = checkpointed(voted.groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.col("confidence"))))).alias("score")))
    best = scores.filter(F.col("score") >= MIN_SCORE).groupBy("value").agg(F.max_by("kind", F.struct("score", -F.col("kind"))).alias("kind"))
    return checkpointed(best.select(F.col("value").alias("value_hash"), F.col("kind").alias("new_kind")))


def find_spans(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, base, spans`` of every row: arrays of ``kind, start, stop`` (kind as a number), in order."""
    found = occurrences(docs)
    new = discovered(found)
    candidates = found.filter(F.col("kind") == _OTHER).withColumn("value_hash", F.xxhash64("value"))
    added = join_small(candidates, new, ["value_hash"]).select("_row", "doc_id", "text_hash", F.col("new_kind").alias("kind"), "start", "stop", F.lit(False).alias("_base"))
    base = found.select("_row", "doc_id", "text_hash", F.when(F.col("kind") < _OTHER, F.col("kind")).alias("kind"), "start", "stop", F.lit(True).alias("_base"))
    span = F.when(F.col("kind").isNotNull(), F.struct("kind", "start", "stop"))
    return base.unionByName(added).groupBy("_row").agg(
        F.first("doc_id").alias("doc_id"), F.first("text_hash").alias("text_hash"),
        F.array_sort(F.collect_list(F.when(F.col("_base"), span))).alias("base"), F.array_sort(F.collect_list(span)).alias("spans"),
    ).drop("_row")


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["stop"])), ",")


def redact(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with every span replaced by its kind in brackets; ``n_chars``, if there, counts anew.

    Only texts that hold a digit or ``@`` are shuffled to meet their spans.
    """
    may = F.coalesce(F.col("text").rlike("[0-9@]"), F.lit(False))
    spans = find_spans(docs.filter(may).select("doc_id", "text")).filter(F.size("spans") > 0)
    spans = spans.select(F.col("doc_id").alias("span_id"), F.col("text_hash").alias("span_hash"), "spans").dropDuplicates(["span_id", "span_hash"])
    met = docs.filter(may).select(row_struct(docs).alias("row"), F.col("doc_id"), F.col("text"), F.xxhash64("text").alias("text_hash"))
    met = met.join(spans, F.col("doc_id").eqNullSafe(F.col("span_id")) & (F.col("text_hash") == F.col("span_hash")), "left")
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    in_order = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"))))
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(done: Column, s: Column) -> Column:
        before = F.substr(F.col("text"), (done["at"] + 1).cast("int"), F.greatest(s["start"] - done["at"], F.lit(0)).cast("int"))
        longer = F.struct(s["stop"].alias("at"), F.concat(done["out"], before, F.get(names, s["kind"])).alias("out"))
        return F.when(s["stop"] <= done["at"], done).otherwise(longer)

    text = F.aggregate(in_order, begin, step, lambda done: F.concat(done["out"], F.substr(F.col("text"), (done["at"] + 1).cast("int"))))
    clean = met.select("row", F.coalesce(text, "text").alias("text"))
    changed = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    columns = [changed[c].alias(c) if c in changed else F.col(f"row.`{c}`") for c in docs.columns]
    return clean.select(*columns).unionByName(docs.filter(~may))
