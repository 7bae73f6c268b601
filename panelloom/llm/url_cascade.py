"""Url rules and exact block lists: longest host and path rule first, then a Bloom filter cascade over hosts and addresses.

The cascade answers "is this key listed?" exactly for every key of the corpus, from a few bit arrays and without
a join. Level 1 holds the listed keys. Level 2 holds the unlisted keys of the corpus that level 1 lets through,
level 3 the listed keys that level 2 lets through, and so on until a level lets nothing wrong through. A key is
decided by the first level that rejects it: odd levels reject unlisted keys, even ones listed keys.

The universe of keys is all distinct keys of the corpus, so the answer is exact for them; a key from elsewhere
gets an approximate answer. Keys are dealt by hash to as many cascades as it takes to keep the bits of each below
``PART_BITS``, which is what a worker holds at a time and what is broadcast at once; more cascades are more passes over
the urls. Bits are set in Spark and come to the driver as blocks of ``BLOCK_WORDS`` words.

Null or malformed urls have an empty host and path, fit no rule, and are allowed unless the empty key is listed.
Repeated rows are judged alike. The row's own columns stay together in the struct ``row``, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelloom.llm.common import lower_ascii, row_struct
from panelloom.session import checkpointed

BITS_PER_KEY = 10
HASHES = 7
PART_BITS = 1 << 28
BLOCK_WORDS = 1 << 12
MAX_LEVELS = 64
_GOLDEN = 0x9E3779B97F4A7C15
#: Of the columns host and path, a boolean column.
Condition = Callable[[Column, Column], Column]


def url_parts(url: Column) -> tuple[Column, Column]:
    """Lower-cased host and raw path; both empty for a null url or one without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3))
    host = F.coalesce(lower_ascii(F.regexp_extract(rest, "^[^/?#]*", 0)), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))
    return host, path


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule ``(verdict, host, path)`` as text and its verdict; null when none fits."""
    text = verdict = F.lit(None).cast("string")
    for said, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        text = F.when(fits, F.lit(rule_host + rule_path)).otherwise(text)
        verdict = F.when(fits, F.lit(said)).otherwise(verdict)
    return text, verdict


def _positions(low: np.ndarray, high: np.ndarray, level: int, bits: int) -> np.ndarray:
    """Bit positions of each key at a level, one row per hash."""
    seed = np.uint64(level * _GOLDEN & 0xFFFFFFFFFFFFFFFF)
    step = (high ^ seed) | np.uint64(1)
    mixed = (low + seed) * np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(31)
    i = np.arange(1, HASHES + 1, dtype=np.uint64)[:, None]
    at = mixed + i * step
    at ^= at >> np.uint64(29)
    return at % np.uint64(bits)


def _hashed(keys: DataFrame) -> DataFrame:
    return keys.select("key", F.xxhash64("key").alias("low"), F.xxhash64(F.lit(7), "key").alias("high"))


def _fill(keys: DataFrame, level: int, n: int) -> np.ndarray:
    """The bit array of a level, as 64-bit words."""
    bits = max(64, n * BITS_PER_KEY)

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            at = np.unique(_positions(b.low.to_numpy().view(np.uint64), b.high.to_numpy().view(np.uint64), level, bits))
            word, first = np.unique(at >> np.uint64(6), return_index=True)
            ored = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first) if len(at) else at
            yield pd.DataFrame({"word": word.astype(np.int64), "ored": ored.view(np.int64)})

    def packed(block: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(BLOCK_WORDS, np.int64)
        out[block["word"].to_numpy() % BLOCK_WORDS] = block["ored"].to_numpy()
        return pd.DataFrame({"block": block["word"][:1] // BLOCK_WORDS, "words": [out.tobytes()]})

    ored = keys.select("low", "high").mapInPandas(words, "word long, ored long").groupBy("word").agg(F.bit_or("ored").alias("ored"))
    blocks = ored.groupBy(F.floor(F.col("word") / BLOCK_WORDS).alias("at")).applyInPandas(packed, "block long, words binary")
    out = np.zeros((bits // 64 // BLOCK_WORDS + 1, BLOCK_WORDS), np.uint64)
    for row in blocks.collect():  # PART_BITS in all
        out[row["block"]] = np.frombuffer(row["words"], np.uint64)
    return out.ravel()


class BloomCascade:
    """Exact membership in a list for all keys of a universe.

    ``keys`` needs the columns ``key`` (distinct, not null) and ``listed``. Only the listed keys of the universe
    are encoded. ``levels`` holds one ``(bits, words)`` pair per level.
    """

    def __init__(self, keys: DataFrame):
        self.levels: list[tuple[int, np.ndarray]] = []
        hashed = checkpointed(_hashed(keys.filter("listed")).withColumn("listed", F.lit(True)).unionByName(_hashed(keys.filter("not listed")).withColumn("listed", F.lit(False))))
        wanted, other = hashed.filter("listed"), hashed.filter("not listed")
        while (n := wanted.count()) or not self.levels:
            if len(self.levels) == MAX_LEVELS:
                raise ValueError("two keys have the same hashes")
            level = len(self.levels) + 1
            self.levels.append((max(64, n * BITS_PER_KEY), _fill(wanted, level, n)))
            wanted, other = other.filter(self._passes(level)), wanted

    def _passes(self, level: int) -> Column:
        bits, words = self.levels[level - 1]

        @F.pandas_udf("boolean")
        def inside(low: pd.Series, high: pd.Series) -> pd.Series:
            return pd.Series(_inside(low, high, level, bits, words))

        return inside("low", "high")

    def contains(self, spark, key: Column) -> Column:
        """Whether a key of the universe is listed; the bit arrays go to the executors once."""
        sent = spark.sparkContext.broadcast(self.levels)

        @F.pandas_udf("boolean")
        def listed(low: pd.Series, high: pd.Series) -> pd.Series:
            undecided = np.ones(len(low), bool)
            answer = np.zeros(len(low), bool)
            for level, (bits, words) in enumerate(sent.value, 1):
                inside = _inside(low, high, level, bits, words)
                answer[undecided & ~inside] = level % 2 == 0
                undecided &= inside
            answer[undecided] = len(sent.value) % 2 == 1
            return pd.Series(answer)

        return listed(F.xxhash64(key), F.xxhash64(F.lit(7), key))


class PartedCascade:
    """As many cascades as the listed keys need, each for the keys of one hash value. ``keys`` as for ``BloomCascade``."""

    def __init__(self, keys: DataFrame):
        n = keys.filter("listed").count()
        self.parts = max(1, -(-n * BITS_PER_KEY // PART_BITS))
        self.cascades = [BloomCascade(keys.filter(self._part(F.col("key")) == p) if self.parts > 1 else keys) for p in range(self.parts)]

    def _part(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(F.lit(13), key), F.lit(self.parts))

    def with_membership(self, df: DataFrame, key: Column, name: str) -> DataFrame:
        """Add whether the key is listed; the rows of a part meet the bits of that part alone."""
        if self.parts == 1:
            return df.withColumn(name, self.cascades[0].contains(df.sparkSession, key))
        each = [df.filter(self._part(key) == p).withColumn(name, c.contains(df.sparkSession, key)) for p, c in enumerate(self.cascades)]
        return reduce(DataFrame.unionByName, each)


def _inside(low: pd.Series, high: pd.Series, level: int, bits: int, words: np.ndarray) -> np.ndarray:
    at = _positions(low.to_numpy(np.int64).view(np.uint64), high.to_numpy(np.int64).view(np.uint64), level, bits)
    return ((words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).all(axis=0)


def judge_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]],
    listed_host: Condition,
    listed_address: Condition | None = None,
    url: str = "url",
) -> DataFrame:
    """``row, host, path, rule, verdict`` (``allow`` or ``block``) of every row.

    A host, or an address (host and path), stands on the block list if one of its rows meets its condition, a function
    of the columns host and path that may look at the columns of ``pages`` as well.
    """
    host, path = url_parts(F.col(f"`{url}`"))
    never = F.lit(False)
    on_list = [F.coalesce(listed_host(host, path), never), F.coalesce(listed_address(host, path), never) if listed_address else never]
    parts = pages.select(host.alias("host"), path.alias("path"), F.array(*on_list).alias("listed"))
    keys = F.array(*[F.struct(k.alias("key"), F.get("listed", F.lit(i)).alias("listed")) for i, k in enumerate(_keys())][: 2 if listed_address else 1])
    keys = checkpointed(parts.select(F.inline(keys)).groupBy("key").agg(F.bool_or("listed").alias("listed")))
    cascade = PartedCascade(keys)
    rows = pages.select(row_struct(pages).alias("row"), host.alias("host"), path.alias("path"))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    of_host, of_address = _keys()
    rows = cascade.with_membership(rows, of_host, "host_listed")
    rows = cascade.with_membership(rows, of_address, "address_listed") if listed_address else rows.withColumn("address_listed", never)
    own = F.when(F.col("host_listed") | F.col("address_listed"), F.lit("block")).otherwise(F.lit("allow"))
    return rows.select("row", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"))


def _keys() -> tuple[Column, Column]:
    """The key of a host and that of an address; a host holds no space."""
    return F.concat(F.lit("host "), F.col("host")), F.concat(F.lit("address "), F.col("host"), F.col("path"))
