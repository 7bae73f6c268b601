"""Secrets in texts, with multipart credentials linked by an interval join.

Base patterns find assignments of secrets, access key ids and long hex strings; what fails its length is dropped, and
these spans are reported whatever follows. Weaker candidates are parts of a credential in one of three roles:
identifiers (a user, client or key id), secrets (short values of secret words, other secret labels, random-looking
tokens) and endpoints (urls, hosts, addresses). Base spans play a role too: access ids are identifiers, the others secrets.

A scope is a paragraph: text between blank lines. Two parts of a scope co-occur when the end of one lies at most
``REACH`` characters from the start of the other. A weak secret is reported if an identifier or endpoint co-occurs, a
weak identifier if a secret does, and an endpoint if both others do. So a stray label or url alone reports nothing.

The join is by row, scope and blocks of ``REACH`` characters. The edges of all parts are first summed up as the lowest
and highest place per block and role; a weak part then meets three blocks on each of its sides, and the extremes of a
block decide exactly whether any of its parts is near enough. No pairs are formed, so a text with very many parts
costs no more than its length. Texts are read once; only the parts of texts that hold a weak one are shuffled.

Null texts count as empty and give no spans. Positions are code points, the end exclusive. Weak parts that overlap a
base span are dropped, as are weak secrets that overlap an identifier. Equal rows get equal spans; an empty table gives
no rows. The row's own columns stay together in the struct ``row``, so their names cannot clash.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelloom.llm.common import arrow_schema, shared_folder

# Kinds of base spans in the order of results, then the kinds that linking adds.
KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")
BASE_KINDS = 3
_ASSIGN = re.compile(r"""(?ia:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_VALUE = 6

IDENTIFIER, SECRET, ENDPOINT = 0, 1, 2
_ROLE_OF_BASE = (SECRET, IDENTIFIER, SECRET)
REACH = 200
_LABELLED = re.compile(
    r"""(?<![A-Za-z0-9])(?ia:(user(?:_?name|_?id)?|login|account(?:_?id)?|client_?id|access_?key(?:_?id)?|key_?id)"""
    r"""|(pwd|pass(?:phrase|code)?|credentials?|private_?key|signing_?key|bearer|auth)"""
    r"""|(host(?:name)?|server|endpoint|base_?url))["']?\x20*[:=]\x20*["']?([A-Za-z0-9@+/_.:=~-]{3,})"""
)
_TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{32,}")
_SHORT_HEX = re.compile(r"(?<![0-9A-Za-z])[0-9a-f]{16,23}(?![0-9A-Za-z])")
_SHORT_ACCESS = re.compile(r"(?<![A-Z0-9])A[KS]IA[A-Z0-9]{8,}")
_URL = re.compile(r"""(?ia:[a-z][a-z0-9+.-]{1,15})://[^\s"'<>]+""")
_ADDRESS = re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}:[0-9]{1,5}(?![0-9.])")
_BLANK_LINE = re.compile(r"\n[\x20\t\r\x0b\x0c]*\n")
_MIXED = (re.compile("[A-Z]"), re.compile("[a-z]"), re.compile("[0-9]"))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``kind, start, stop`` of the base patterns, by start and then kind."""
    found = [(0, *m.span()) for m in _ASSIGN.finditer(text) if len(m[1]) >= LEAST_VALUE]
    found += [(1, *m.span()) for m in _ACCESS.finditer(text)]
    found += [(2, *m.span()) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], s[0]))


class _Taken:
    """Places already covered by spans that do not overlap each other's starts out of order."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts, self.stops, high = [], [], 0
        for start, stop in sorted(spans):
            high = max(high, stop)
            self.starts.append(start)
            self.stops.append(high)

    def meets(self, start: int, stop: int) -> bool:
        """Whether a span begins before ``stop`` and one of those reaches beyond ``start``."""
        at = bisect_right(self.starts, stop - 1)
        return at > 0 and self.stops[at - 1] > start


def weak_parts(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """``role, start, stop`` of the weak parts of a text; none if it holds no secret, as nothing could be reported."""
    taken = _Taken([s[1:] for s in base])
    found: dict[int, list[tuple[int, int]]] = {IDENTIFIER: [], SECRET: [], ENDPOINT: []}
    for m in _LABELLED.finditer(text) if ":" in text or "=" in text else ():
        found[next(role for role in found if m[role + 1] is not None)].append(m.span())
    found[IDENTIFIER] += [m.span() for m in _SHORT_ACCESS.finditer(text)]
    found[SECRET] += [m.span() for m in _ASSIGN.finditer(text) if len(m[1]) < LEAST_VALUE]
    found[SECRET] += [m.span() for m in _TOKEN.finditer(text) if all(kind.search(m[0]) for kind in _MIXED)]
    found[SECRET] += [m.span() for m in _SHORT_HEX.finditer(text) if _MIXED[1].search(m[0]) and _MIXED[2].search(m[0])]
    if not found[SECRET] and not any(_ROLE_OF_BASE[kind] == SECRET for kind, _, _ in base):
        return []
    found[ENDPOINT] += [m.span() for m in _URL.finditer(text)] if "://" in text else []
    found[ENDPOINT] += [m.span() for m in _ADDRESS.finditer(text)]
    named = _Taken(found[IDENTIFIER])
    found[SECRET] = [s for s in found[SECRET] if not named.meets(*s)]
    return sorted({(role, *s) for role, spans in found.items() for s in spans if not taken.meets(*s)})


def _parts(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, bool, int, int, int]]:
    """``role, weak, scope, start, stop`` of all parts of a text that holds a weak one."""
    weak = weak_parts(text, base)
    if not weak:
        return []
    breaks = [m.end() for m in _BLANK_LINE.finditer(text)]
    every = [(role, True, start, stop) for role, start, stop in weak] + [(_ROLE_OF_BASE[kind], False, start, stop) for kind, start, stop in base]
    return [(role, is_weak, bisect_right(breaks, start), start, stop) for role, is_weak, start, stop in every]


_BASE = "array<struct<kind:int,start:long,stop:long>>"
_PARTS = "array<struct<role:int,weak:boolean,scope:long,start:long,stop:long>>"


def found_parts(docs: DataFrame) -> DataFrame:
    """``_row, row, base, parts`` of every row: ``row`` holds all columns but ``text``; written once, so numbers last."""
    others = [c for c in docs.columns if c != "text"]
    row = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.struct(F.lit(None).cast("int").alias("none"))
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), row.alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    spark_schema, schema = arrow_schema(rows.select("_row", "row"), f"base {_BASE}, parts {_PARTS}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, parts = [], []
            for text in batch.column(2):
                text = text.as_py()
                spans = base_spans(text)
                base.append([dict(zip(("kind", "start", "stop"), s, strict=True)) for s in spans])
                parts.append([dict(zip(("role", "weak", "scope", "start", "stop"), p, strict=True)) for p in _parts(text, spans)])
            yield pa.record_batch([batch.column(0), batch.column(1).cast(schema[1].type), pa.array(base, schema[2].type), pa.array(parts, schema[3].type)], schema=schema)

    folder = shared_folder(docs.sparkSession, "secret-parts")
    rows.mapInArrow(run, spark_schema).write.parquet(folder)
    return docs.sparkSession.read.parquet(folder)


def linked(parts: DataFrame, reach: int = REACH) -> DataFrame:
    """Weak parts of ``_row, role, weak, scope, start, stop`` that are reported, with whether each role co-occurs."""
    at = F.when(F.col("side") == 0, F.col("start")).otherwise(F.col("stop"))
    edges = parts.withColumn("side", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("at", at)
    roles = {IDENTIFIER: "identifier", SECRET: "secret", ENDPOINT: "endpoint"}
    ends = [f(F.when(F.col("role") == r, F.col("at"))).alias(f"{f.__name__}_{name}") for r, name in roles.items() for f in (F.min, F.max)]
    keys = ["_row", "scope", "side", "block"]
    blocks = edges.withColumn("block", F.floor(F.col("at") / reach)).groupBy(*keys).agg(*ends)
    # the start of a weak part looks for ends, its end looks for starts
    around = F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(F.col("at") / reach) + d)
    probes = edges.filter("weak").withColumn("side", 1 - F.col("side")).withColumn("block", F.explode(around))
    met = probes.join(blocks, keys)
    near = [
        F.coalesce(F.bool_or((F.abs(F.col(f"min_{name}") - F.col("at")) <= reach) | (F.abs(F.col(f"max_{name}") - F.col("at")) <= reach)), F.lit(False)).alias(name)
        for name in roles.values()
    ]
    found = met.groupBy("_row", "role", "start", "stop").agg(*near)
    complete = {IDENTIFIER: F.col("secret"), SECRET: F.col("identifier") | F.col("endpoint"), ENDPOINT: F.col("identifier") & F.col("secret")}
    return found.filter(F.coalesce(*[F.when(F.col("role") == r, rule) for r, rule in complete.items()]))


def find_secrets(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """``row, base, spans`` of every row: arrays of ``kind, start, stop`` (kind as a number), by start and then kind."""
    found = found_parts(docs)
    weak = found.filter(F.size("parts") > 0).select("_row", F.explode("parts").alias("part")).select("_row", "part.*")
    span = F.struct((F.col("role") + BASE_KINDS).cast("int").alias("kind"), "start", "stop")
    added = linked(weak, reach).groupBy("_row").agg(F.collect_list(span).alias("added"))
    open_ = found.filter(F.size("parts") > 0).join(added, "_row", "left").withColumn("added", F.coalesce("added", F.array().cast(_BASE)))
    done = found.filter(F.size("parts") == 0).withColumn("added", F.array().cast(_BASE))
    both = open_.select("row", "base", "added").unionByName(done.select("row", "base", "added"))
    ordered = F.array_sort(F.concat("base", "added"), _by_start)
    return both.select("row", "base", ordered.alias("spans"))


def _by_start(a: Column, b: Column) -> Column:
    def order(name: str) -> Column:
        return F.when(a[name] < b[name], -1).when(a[name] > b[name], 1)

    return F.coalesce(order("start"), order("kind"), order("stop"), F.lit(0))


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["stop"])), ",")
