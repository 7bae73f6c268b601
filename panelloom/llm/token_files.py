"""Token-id files: frequency-ranked ids in a byte-aligned variable-length code with separate control bytes.

Texts are put in order of doc_id and tokenized once; their ids are stored in blocks of whole documents, of at least
``BLOCK_IDS`` ids but for the last of a part, each with the counts of its ids. The counts, summed over all blocks, rank
the ids of the whole corpus: order of falling frequency, ties by id, so that the commonest ids take one byte in every
block. The ranking has a row for each id of the vocabulary at most. Then every block is written again in ranks: a control
stream with two bits per id (its byte count less one, four ids to a byte) and a data stream of little-endian bytes.
Decoding looks the control bytes up in a table of byte counts, sums them to offsets, gathers the data bytes and looks the
ranks up in the ranking, all in numpy.

Parquet is the container, in three folders: ``plain`` (blocks of ids as they are), ``ranking`` (``rank, id``) and ``blocks``
(``part, block, first, n_ids, doc_ids, counts, control, data``). Parts are ranges of doc_id and blocks follow doc_id
inside a part, so reading by ``part, block`` gives documents in ascending order. ``first`` is the number of ids before
the block in its part.

Text is split at ASCII white space, which no token of the tokenizer spans, and words that were seen before come
from bounded caches. Null text counts as empty and gives the end id alone. Null doc_ids come first; rows with
the same doc_id are ordered by text, and equal rows are kept. An empty table gives empty files. A document is
never split over blocks, so a task holds one block and one document at a time. Only ``doc_id`` and ``text`` are read, so
other columns cannot clash.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelloom.llm.common import join_small

END_ID = 2
BLOCK_IDS = 1 << 21
CACHED_WORDS = 350_000
CACHED_CHARS = 48
_PLACE = [("part", pa.int32()), ("block", pa.int64()), ("first", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))]
_PLAIN = pa.schema([*_PLACE, ("width", pa.int32()), ("ids", pa.binary()), ("seen", pa.binary()), ("times", pa.binary())])
_BLOCK = pa.schema([*_PLACE, ("control", pa.binary()), ("data", pa.binary())])
_PLACE_SCHEMA = "part int, block long, first long, n_ids long, doc_ids array<long>, counts array<long>"
PLAIN_SCHEMA = f"{_PLACE_SCHEMA}, width int, ids binary, seen binary, times binary"
BLOCK_SCHEMA = f"{_PLACE_SCHEMA}, control binary, data binary"
# The text steps of the tokenizer file that are done here, and its runs within Latin-1.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": _SPLIT}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]}
_SIMPLE = re.compile(r"[\x21-\x7e\xa1-\xff]+")
_LETTERS, _DIGITS = r"a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", r"0-9\xb2\xb3\xb9\xbc-\xbe"
_RUNS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_DIGITS}]|[^{_LETTERS}{_DIGITS}]+")
#: The printable stand-in of each byte: itself where Latin-1 prints it, else the next character from 256 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_CHARS = {b: b if b in _PRINTED else 256 + sum(x not in _PRINTED for x in range(b)) for b in range(256)}
#: Byte counts of the four ids of each control byte.
_COUNTS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8) + 1


class WordEncoder:
    """Ids of a text as little-endian unsigned 32-bit integers, from a tokenizers file.

    Words of Latin-1 characters are cut into letter runs, digits and other runs as the file's pre-tokenizer does,
    and each is merged on its own; all other words, and any that may hold a special token, go to the tokenizer whole.
    A file whose steps are not the known ones gets every word whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        steps = json.loads(self.tokenizer.to_str())
        self.known_steps = (steps["normalizer"], steps["pre_tokenizer"]) == (_NORMALIZER, _PRE_TOKENIZER)
        self.words = _Cache(self._word)
        self.runs = _Cache(self._run)

    def __call__(self, text: str | bytes | None) -> bytes:
        raw = text if isinstance(text, bytes) else (text or "").encode("utf-8", "replace")
        out = b"".join(map(self.words.__getitem__, raw.split()))
        for cache in (self.words, self.runs):
            if len(cache) > CACHED_WORDS:
                cache.older = dict(cache)
                cache.clear()
        return out

    def _word(self, raw: bytes) -> bytes:
        word = raw.decode()
        if self.known_steps and _SIMPLE.fullmatch(word) and "<|" not in word:
            runs = _RUNS.findall(word.lower())
            return self.runs[runs[0]] if len(runs) == 1 else b"".join(map(self.runs.__getitem__, runs))
        return _bytes_of(self.tokenizer.encode(word, add_special_tokens=False).ids)

    def _run(self, run: str) -> bytes:
        return _bytes_of([t.id for t in self.model.tokenize(run.encode().decode("latin-1").translate(_BYTE_CHARS))])


def _bytes_of(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class _Cache(dict):
    """A dict that makes what it misses, or takes it from the ``older`` one; long keys are not kept."""

    def __init__(self, make: Callable):
        self.make, self.older = make, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= CACHED_CHARS:
            self[key] = value
        return value


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    """One encoder per worker process, so that its caches serve one task after another."""
    return WordEncoder(path)


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data stream of unsigned 32-bit ranks."""
    ranks = np.ascontiguousarray(ranks, "<u4")
    codes = (ranks >= 1 << 8).astype(np.uint8) + (ranks >= 1 << 16) + (ranks >= 1 << 24)
    four = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    four[: len(ranks)] = codes
    four = four.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    ends = np.cumsum(codes.astype(np.int64) + 1)
    at = ends - codes - 1
    data = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    parts = ranks.view(np.uint8).reshape(-1, 4)
    data[at] = parts[:, 0]
    for k in range(1, 4):
        wide = np.flatnonzero(codes >= k)
        data[at[wide] + k] = parts[wide, k]
    return control.tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` ranks of a control and data stream."""
    counts = _COUNTS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    at = np.cumsum(counts, dtype=np.int64) - counts
    stream = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(3, np.uint8)])
    ranks = stream[at].astype(np.uint32)
    for k in range(1, 4):
        wide = np.flatnonzero(counts > k)
        ranks[wide] |= stream[at[wide] + k].astype(np.uint32) << np.uint32(8 * k)
    return ranks


def _plain(docs: DataFrame, tokenizer_path: str, end_id: int, block_ids: int, parts: int) -> DataFrame:
    """Blocks of ids in order of doc_id, with the counts of their ids."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_encoder(tokenizer_path)
        width = 2 if max(encode.tokenizer.get_vocab_size() - 1, end_id) < 1 << 16 else 4
        part, block, first, held = TaskContext.get().partitionId(), 0, 0, 0
        names: list[int | None] = []
        coded: list[bytes] = []
        end = np.array([end_id], "<u4").tobytes()

        def row() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(coded), "<u4")
            times = np.bincount(ids)
            seen = np.flatnonzero(times)
            values = [part, block, first, held, names, [len(c) // 4 for c in coded], width, ids.astype(f"<u{width}").tobytes(), seen.tobytes(), times[seen].tobytes()]
            return pa.record_batch([pa.array([v], t.type) for v, t in zip(values, _PLAIN, strict=True)], schema=_PLAIN)

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                names.append(doc_id.as_py())
                coded.append(encode(text.as_py()) + end)
                held += len(coded[-1]) // 4
                if held >= block_ids:
                    yield row()
                    block, first, held, names, coded = block + 1, first + held, 0, [], []
        if names:
            yield row()

    ordered = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(blocks, PLAIN_SCHEMA)


def ranking(plain: DataFrame) -> np.ndarray:
    """All ids of the corpus in order of falling frequency, ties by id; what comes to the driver is bounded by the vocabulary."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for seen, times in zip(batch.column(0), batch.column(1), strict=True):
                yield pa.record_batch([pa.array(np.frombuffer(c.as_buffer(), np.int64)) for c in (seen, times)], names=["id", "n"])

    summed = plain.select("seen", "times").mapInArrow(counts, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    return np.array([r["id"] for r in summed.orderBy(F.desc("n"), "id").collect()], "<u4")


def write_token_files(
    docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = END_ID, block_ids: int = BLOCK_IDS, parts: int | None = None
) -> None:
    """Write the ids of ``doc_id, text`` rows in ascending doc_id order, each document followed by ``end_id``.

    ``parts`` is by default the session's number of shuffle partitions.
    """
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    _plain(docs, tokenizer_path, end_id, block_ids, parts).write.option("compression", "none").parquet(f"{folder}/plain")
    plain = spark.read.parquet(f"{folder}/plain")
    table = ranking(plain)
    spark.createDataFrame(list(enumerate(table.tolist())), "rank long, id long").write.parquet(f"{folder}/ranking")
    rank = np.zeros(int(table.max(initial=0)) + 1, np.uint32)
    rank[table] = np.arange(len(table))

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                width, ids = (batch.column(c)[i] for c in (len(_PLACE), len(_PLACE) + 1))
                control, data = pack(rank[np.frombuffer(ids.as_buffer(), f"<u{width.as_py()}")])
                yield pa.record_batch([*batch.slice(i, 1).columns[: len(_PLACE)], pa.array([control]), pa.array([data])], schema=_BLOCK)

    plain.drop("seen", "times").mapInArrow(ranked, BLOCK_SCHEMA).write.parquet(f"{folder}/blocks")


def read_token_files(spark: SparkSession, folder: str, per_document: Callable[[np.ndarray], list] | None = None, fields: str = "ids array<long>") -> DataFrame:
    """``doc_id, start, n_tokens`` of every document and its ids, or the ``fields`` that ``per_document`` makes of them.

    ``start`` is the number of ids of all documents before it.
    """
    stored = spark.read.parquet(f"{folder}/blocks")
    table = np.array([r["id"] for r in spark.read.parquet(f"{folder}/ranking").orderBy("rank").collect()], "<u4")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = stored.groupBy("part").agg(F.sum("n_ids").alias("_n"))
    parts = parts.select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    stored = join_small(stored, parts, ["part"])
    schema = f"doc_id long, start long, n_tokens long, {fields}"
    arrow = pa.schema(spark.createDataFrame([], schema).toArrow().schema)

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                b = batch.slice(i, 1).to_pylist()[0]
                ids = table[unpack(b["control"], b["data"], b["n_ids"])]
                counts = np.array(b["counts"], np.int64)
                at = np.cumsum(counts) - counts
                each = [ids[a : a + n] for a, n in zip(at, counts, strict=True)]
                made = [per_document(x) for x in each] if per_document else [[x.tolist()] for x in each]
                rows = [b["doc_ids"], (b["_before"] + b["first"] + at).tolist(), b["counts"], *map(list, zip(*made, strict=True))]
                yield pa.record_batch([pa.array(r, t.type) for r, t in zip(rows, arrow, strict=True)], schema=arrow)

    return stored.select("_before", "first", "n_ids", "doc_ids", "counts", "control", "data").mapInArrow(documents, schema)


def ids_crc32(ids: np.ndarray) -> list[int]:
    return [zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())]
