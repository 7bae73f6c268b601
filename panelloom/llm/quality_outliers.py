"""Quality rules by robust multivariate outliers: minimum-covariance-determinant estimates per language and source.

Base rules reject texts of under ``MIN_WORDS`` words, and texts of whose words more than ``MAX_REPEAT`` per cent lie
in repeated five-word windows. All other rows become transformed statistic vectors (``FEATURES``), and a row is
rejected when its robust Mahalanobis distance lies beyond the chi-square quantile of ``TAIL``.

The estimate of a group is the mean and covariance of the rows nearest to it, the share ``KEPT_SHARE`` of the
group: from two starts, concentration steps measure the distance of every row, find the distance that holds the
share, and take moments inside it; the start that ends with the smaller determinant wins. The pooled estimate over all
rows comes first; a group's own estimate is mixed with it as if ``PRIOR_ROWS`` rows came from the pool, so that a
small group leans on the pool without any switch. ``FLOOR`` is added to the variances, since some statistics are
zero in most texts.

A step is one pass over the narrow vectors that sums counts and moments per group and distance bucket before its
shuffle, so the size of a group does not matter, and results depend on no sample. Distances that share a bucket of
1/16 octave are taken in together.

Null texts have no words and fail the base rules. Rows with a null language or source form a group of their own.
Equal rows get equal verdicts. An empty table gives no rows. Other columns are carried along unread.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import exp, lgamma, log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelloom.llm.common import arrow_schema, join_small, row_struct, shared_folder
from panelloom.session import checkpointed

MIN_WORDS = 10
MAX_REPEAT = 20
WINDOW = 5
SYMBOLS = "#*$%&|<>"
_SPACE_CHARS = " \t\n\v\f\r"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_capitals", "n_lines")
FEATURES = ("length", "word_length", "symbols", "dup_lines", "repeats", "capitals")
#: Standard deviation that is added to that of each feature, in the order of FEATURES.
FLOOR = (1.0, 0.12, 0.03, 0.2, 0.15, 0.08)
KEPT_SHARE = 0.75
STEPS = 4
PRIOR_ROWS = 30.0
TAIL = 1e-7
_P = len(FEATURES)
_PAIRS = [(i, j) for i in range(_P) for j in range(i, _P)]


def text_counts(text: str | None) -> tuple[int, ...]:
    """The COUNTS of a text; of words as runs between ASCII white space, and lines as split at ``\\n``."""
    text = text or ""
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    n = len(words)
    repeated = 0
    if n > WINDOW:
        windows = list(zip(*[words[i:] for i in range(WINDOW)], strict=False))
        if len(set(windows)) < len(windows):
            seen = Counter(windows)
            starts = np.flatnonzero(np.fromiter((seen[w] > 1 for w in windows), bool, len(windows)))
            inside = np.zeros(n + WINDOW, np.int64)
            np.add.at(inside, starts, 1)
            np.add.at(inside, starts + WINDOW, -1)
            repeated = int((np.cumsum(inside) > 0).sum())
    lines = [x for x in text.split("\n") if x.strip(_SPACE_CHARS)]
    codes = np.frombuffer(raw, np.uint8)
    capitals = int(((codes >= 65) & (codes <= 90)).sum())
    chars = len(text) - sum(map(text.count, _SPACE_CHARS))
    return n, chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated, capitals, len(lines)


def with_counts(docs: DataFrame) -> DataFrame:
    """Add the COUNTS (longs) and ``base_failed`` to every row."""
    at = docs.columns.index("text")
    spark_schema, schema = arrow_schema(docs, ", ".join(f"{c} long" for c in COUNTS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = np.array([text_counts(t.as_py()) for t in batch.column(at)], np.int64).reshape(-1, len(COUNTS))
            columns = [*batch.columns, *map(pa.array, counts.T.copy())]
            yield pa.record_batch([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    counted = docs.mapInArrow(run, spark_schema)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    return counted.withColumn("base_failed", failed)


def feature_columns() -> dict[str, Column]:
    """The transformed vector: logarithms of sizes, and arcsines of the roots of shares."""

    def share(part: str, whole: str) -> Column:
        return F.asin(F.sqrt(F.least(F.lit(1.0), F.col(part) / F.greatest(F.col(whole), F.lit(1)))))

    return {
        "length": F.log(F.greatest("n_words", F.lit(1)).cast("double")),
        "word_length": F.log((F.col("word_chars") + 1) / (F.col("n_words") + 1)),
        "symbols": share("n_symbols", "word_chars"),
        "dup_lines": share("n_dup_lines", "n_lines"),
        "repeats": share("n_repeat_words", "n_words"),
        "capitals": share("n_capitals", "word_chars"),
    }


def group_key() -> Column:
    """Language and source as one text that keeps nulls apart."""
    return F.to_json(F.struct("lang", "source"))


def _gamma_share(a: float, x: float) -> float:
    """Regularized lower incomplete gamma function, by its series."""
    term = total = 1.0 / a
    k = a
    while term > total * 1e-16:
        k += 1
        term *= x / k
        total += term
    return total * exp(-x + a * log(x) - lgamma(a)) if x > 0 else 0.0


def chi_square_quantile(share: float, p: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if _gamma_share(p / 2, middle / 2) < share else (low, middle)
    return low


#: Makes the covariance of the nearest share of normal rows that of all of them.
CONSISTENCY = KEPT_SHARE / _gamma_share(_P / 2 + 1, chi_square_quantile(KEPT_SHARE, _P) / 2)
CUTOFF = chi_square_quantile(1 - TAIL, _P)


def distance(mean: str = "mean", inverse: str = "inverse") -> Column:
    """Squared Mahalanobis distance of the features of a row to the estimate in the same row."""
    d = [F.col(f) - F.get(mean, F.lit(i)) for i, f in enumerate(FEATURES)]
    out = F.lit(0.0)
    for i, j in _PAIRS:
        out = out + (1.0 if i == j else 2.0) * F.get(inverse, F.lit(i * _P + j)) * d[i] * d[j]
    return out


_ESTIMATE = "grp string, start int, mean array<double>, inverse array<double>, covariance array<double>, log_det double"


def estimate(n: float, sums: np.ndarray, squares: np.ndarray, pool: tuple[np.ndarray, np.ndarray] | None, factor: float) -> tuple:
    """Mean, inverse of the regularized covariance, covariance and log determinant from the moments of a subset."""
    mean = sums / max(n, 1.0)
    second = np.zeros((_P, _P))
    for (i, j), s in zip(_PAIRS, squares, strict=True):
        second[i, j] = second[j, i] = s / max(n, 1.0)
    covariance = factor * (second - np.outer(mean, mean))
    if pool is not None:
        weight = n / (n + PRIOR_ROWS)
        mean = weight * mean + (1 - weight) * pool[0]
        covariance = weight * covariance + (1 - weight) * pool[1]
    whole = covariance + np.diag(np.square(FLOOR))
    return mean.tolist(), np.linalg.inv(whole).ravel().tolist(), covariance.ravel().tolist(), float(np.linalg.slogdet(whole)[1])


def _estimates(moments: DataFrame, pool: tuple[np.ndarray, np.ndarray] | None, factor: float) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [estimate(float(r.n), np.array(r.sums, float), np.array(r.squares, float), pool, factor) for r in b.itertuples()]
            columns = list(zip(*made, strict=True)) if made else [[]] * 4
            yield pd.DataFrame({"grp": b["grp"], "start": b["start"], **dict(zip(("mean", "inverse", "covariance", "log_det"), map(list, columns), strict=True))})

    return checkpointed(moments.mapInPandas(run, _ESTIMATE))


def _moments() -> list[Column]:
    sums = F.array(*[F.sum(F.col(f)) for f in FEATURES]).alias("sums")
    squares = F.array(*[F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])) for i, j in _PAIRS]).alias("squares")
    return [F.count(F.lit(1)).alias("n"), sums, squares]


def _concentrate(vectors: DataFrame, estimates: DataFrame, pool) -> DataFrame:
    """One concentration step: the estimates of the nearest share of each group, for every start."""
    rows = join_small(vectors, estimates.select("grp", "start", "mean", "inverse"), ["grp"])
    bucket = F.floor(16 * F.log2(distance() + 1e-6)).cast("int")
    parts = rows.withColumn("_bucket", bucket).groupBy("grp", "start", "_bucket").agg(*_moments())
    so_far = Window.partitionBy("grp", "start").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("grp", "start")
    inside = F.coalesce(F.sum("n").over(so_far), F.lit(0)) < KEPT_SHARE * F.sum("n").over(whole)
    near = parts.withColumn("_in", inside).filter("_in")
    total = near.groupBy("grp", "start").agg(
        F.sum("n").alias("n"),
        F.array(*[F.sum(F.get("sums", F.lit(i))) for i in range(_P)]).alias("sums"),
        F.array(*[F.sum(F.get("squares", F.lit(i))) for i in range(len(_PAIRS))]).alias("squares"),
    )
    return _estimates(total, pool, CONSISTENCY)


def _settled(vectors: DataFrame, estimates: DataFrame, pool) -> DataFrame:
    for _ in range(STEPS):
        estimates = _concentrate(vectors, estimates, pool)
    best = F.min_by(F.struct("mean", "inverse", "covariance"), F.struct("log_det", "start")).alias("_best")
    return checkpointed(estimates.groupBy("grp").agg(best).select("grp", "_best.*"))


def fit(vectors: DataFrame) -> DataFrame:
    """``grp, mean, inverse, covariance`` for every group of ``grp`` and the FEATURES; write the vectors first."""
    spark = vectors.sparkSession
    pooled = vectors.withColumn("grp", F.lit(""))
    all_rows = pooled.groupBy("grp").agg(*_moments())
    middle = pooled.agg(*[F.percentile_approx(f, 0.5, 10_000).alias(f) for f in FEATURES]).first()
    if middle[0] is None:
        return spark.createDataFrame([], _ESTIMATE).select("grp", "mean", "inverse", "covariance")
    at_median = ("", 1, [float(m) for m in middle], np.diag(1 / np.square(FLOOR)).ravel().tolist(), np.zeros(_P * _P).tolist(), 0.0)
    starts = _estimates(all_rows.withColumn("start", F.lit(0)), None, 1.0).unionByName(spark.createDataFrame([at_median], _ESTIMATE))
    pool_row = _settled(pooled, checkpointed(starts), None).first()
    pool = np.array(pool_row["mean"]), np.array(pool_row["covariance"]).reshape(_P, _P)
    own = vectors.groupBy("grp").agg(*_moments())
    classical = _estimates(own.withColumn("start", F.lit(0)), pool, 1.0)
    from_pool = classical.select("grp", F.lit(1).alias("start"), *[
        F.array(*map(F.lit, pool_row[c])).alias(c) for c in ("mean", "inverse", "covariance")
    ], F.lit(0.0).alias("log_det"))
    return _settled(vectors, checkpointed(classical.unionByName(from_pool)), pool)


def judge(counted: DataFrame, estimates: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """Add ``distance`` (squared; null where the base rules reject) and ``kept`` to rows of ``with_counts``."""
    names = feature_columns()
    rows = counted.withColumns({**names, "grp": F.when(~F.col("base_failed"), group_key())})
    rows = join_small(rows, estimates.select("grp", "mean", "inverse"), ["grp"], "left")
    rows = rows.withColumn("distance", distance())
    kept = ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= cutoff)
    return rows.withColumn("kept", kept).drop(*names, "grp", "mean", "inverse")


def fit_documents(counted: DataFrame) -> DataFrame:
    """Estimates for rows of ``with_counts``; only the narrow vectors are written."""
    vectors = counted.filter(~F.col("base_failed")).select(group_key().alias("grp"), *[c.alias(n) for n, c in feature_columns().items()])
    return fit(checkpointed(vectors))


def quality_verdicts(docs: DataFrame) -> DataFrame:
    """Counts, distance and verdict of every row of ``doc_id, text, lang, source``, without the text."""
    counted = checkpointed(with_counts(docs.select("doc_id", "text", "lang", "source")).drop("text"))
    return judge(counted, fit_documents(counted))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns. Texts are counted once and stored beside their counts."""
    spark = docs.sparkSession
    folder = shared_folder(spark, "counted-documents")
    with_counts(docs.select(row_struct(docs, "text").alias("row"), "text", "lang", "source")).write.parquet(folder)
    counted = spark.read.parquet(folder)
    kept = judge(counted, fit_documents(counted)).filter("kept")
    return kept.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
