"""Quality classifier by nearest-neighbour voting among labelled latent-semantic vectors.

Terms are pairs of neighbouring bytes, hashed to ``PAIRS`` buckets, and repeats: words equal to the one, two or
three words before, and lines that came before. A text's term weights are the logarithms of its
counts times the inverse document frequency over all documents, at unit length. The fit takes at most
``PER_CLASS`` labelled rows of each class, those with the smallest hash of their id, and the ``RANK`` leading right
singular vectors of their weights span the latent space. Basis and labelled vectors have a size fixed by these
parameters and are broadcast. Every document is projected, its cosines to all labelled vectors are computed in
blocks, and its ``NEIGHBOURS`` nearest vote with weights that grow with the cosine; of equal cosines all vote.
Classes weigh the same, whatever their numbers in the sample.

Null texts count as empty. A text without terms has no direction and scores 0.5. Labels other than 0 and 1 or null,
and labels of absent documents, are left out; a document with several labels counts with each. If a class has no
row, all texts score the share of the other one. Equal texts score alike. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.llm.common import arrow_schema, row_struct

PAIRS = 1024
#: Distances at which a word repeats; one more term counts repeated lines.
REPEATS = (1, 2, 3)
TERMS = PAIRS + len(REPEATS) + 1
RANK = 32
PER_CLASS = 1000
NEIGHBOURS = 11
#: Votes weigh the cosine to this power.
SHARPNESS = 8
_BLOCK = 256


def _bucket_of_pair() -> np.ndarray:
    pair = np.arange(1 << 16, dtype=np.uint64)
    mixed = (pair + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(32) & np.uint64(PAIRS - 1)).astype(np.int64)


_BUCKETS = _bucket_of_pair()


def term_counts(text: str | None) -> np.ndarray:
    """Counts of the hashed byte pairs and of the repeats of a text."""
    raw = (text or "").encode("utf-8", "replace")
    codes = np.frombuffer(raw, np.uint8)
    out = np.zeros(TERMS)
    if len(codes) > 1:
        out[:PAIRS] = np.bincount(_BUCKETS[codes[:-1].astype(np.int32) << 8 | codes[1:]], minlength=PAIRS)
    words = raw.split()
    for i, back in enumerate(REPEATS):
        out[PAIRS + i] = sum(map(eq, words, words[back:]))
    lines = raw.split(b"\n")
    out[-1] = len(lines) - len(set(lines))
    return out


def weights(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of unit length, or zero."""
    out = np.log1p(counts) * idf
    length = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(length > 0, length, 1)


def document_frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """Number of documents, and in how many each term occurs; tasks sum before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(TERMS, np.int64)
        for batch in batches:
            for text in batch.column(0):
                n += 1
                total += term_counts(text.as_py()) > 0
        yield pa.record_batch([pa.array(np.arange(-1, TERMS)), pa.array(np.concatenate([[n], total]))], names=["term", "n"])

    found = docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(TERMS + 1, np.int64)
    out[found["term"].to_numpy(np.int64) + 1] = found["n"].to_numpy(np.int64)
    return int(out[0]), out[1:]


class LatentVotes:
    """A fitted classifier: inverse document frequencies, basis, labelled unit vectors and their labels."""

    def __init__(self, idf: np.ndarray, counts: np.ndarray, labels: np.ndarray, rank: int = RANK, neighbours: int = NEIGHBOURS):
        self.idf, self.labels, self.neighbours = idf, labels.astype(np.int64), neighbours
        rows = weights(counts, idf)
        _, vectors = np.linalg.eigh(rows.T @ rows)
        self.basis = vectors[:, ::-1][:, :rank].copy()
        self.known = self._latent(rows)
        sizes = np.bincount(self.labels, minlength=2)
        self.class_weight = np.where(sizes > 0, len(labels) / np.maximum(1, 2 * sizes), 0.0)

    def _latent(self, rows: np.ndarray) -> np.ndarray:
        out = rows @ self.basis
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(length > 1e-9, length, 1)

    def scores(self, counts: np.ndarray) -> np.ndarray:
        """Likelihood of label 1 for rows of term counts."""
        if not len(self.labels):
            return np.full(len(counts), 0.5)
        cosines = np.round(self._latent(weights(counts, self.idf)) @ self.known.T, 9)
        k = min(self.neighbours, len(self.labels))
        nearest = np.partition(cosines, -k, axis=1)[:, -k:].min(axis=1, keepdims=True)
        votes = np.where(cosines >= nearest, np.maximum(cosines, 0) ** SHARPNESS, 0) * self.class_weight[self.labels]
        good, both = votes @ (self.labels == 1), votes.sum(axis=1)
        none = 0.5 if (self.class_weight > 0).all() else float(self.labels.mean())
        return np.where(both > 0, good / np.where(both > 0, both, 1), none)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> LatentVotes:
    """Fit on ``doc_id, text`` and ``doc_id, label`` (0 or 1); the sample is bounded by ``per_class`` for each class."""
    order = F.xxhash64("doc_id")
    sides = [labels.filter(F.col("label") == c).select("doc_id", F.lit(c).alias("label")).orderBy(order, "doc_id").limit(per_class) for c in (0, 1)]
    sample = sides[0].unionByName(sides[1])
    drawn = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [term_counts(t.as_py()).astype(np.float32).tobytes() for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(counts, pa.binary())], names=["label", "counts"])

    n, frequency = document_frequencies(docs)
    idf = np.log((1.0 + n) / (1.0 + frequency)) + 0.1
    rows = drawn.mapInArrow(run, "label int, counts binary")
    # repeated documents of a sampled id stay within the bound as well; the order makes the fit repeatable
    rows = rows.orderBy(F.xxhash64("counts"), "label").limit(2 * per_class).toPandas()
    counts = np.stack([np.frombuffer(c, np.float32) for c in rows["counts"]]).astype(float) if len(rows) else np.zeros((0, TERMS))
    return LatentVotes(idf, counts, rows["label"].to_numpy())


def score(docs: DataFrame, model: LatentVotes) -> DataFrame:
    """``row`` (all columns but ``text``) and ``score`` of every row of ``docs``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(row_struct(docs, "text").alias("row"), "text")
    spark_schema, schema = arrow_schema(rows.select("row"), "score double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _BLOCK):
                block = batch.slice(at, _BLOCK)
                counts = np.stack([term_counts(t.as_py()) for t in block.column(1)])
                yield pa.record_batch([block.column(0).cast(schema[0].type), pa.array(sent.value.scores(counts))], schema=schema)

    return rows.mapInArrow(run, spark_schema)
