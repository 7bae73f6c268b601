"""Helpers that the text operators share."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# The white space that separates words, as a Java and Python character class body.
SPACES = r"\x20\x09-\x0D"
WORD = f"[^{SPACES}]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Rows of a small table that may be broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 20_000


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that the cluster names in ``spark.checkpoint.dir``.

    A temporary folder takes its place only on a local master that names none.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="panelloom-shared-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def importable(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package also where the driver found it by a path of its own.

    On a cluster the package is installed or shipped with ``--py-files``; then this changes nothing.
    """
    root = str(Path(__file__).resolve().parents[2])
    paths = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in paths.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [paths, root]))
    return spark


def tokenizer_path(name: str, folder: str | None = None) -> str:
    """Place of a public tokenizer file: below ``folder``, else where the installed collection keeps it."""
    if folder:
        return f"{folder.rstrip('/')}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def n_words(text: Column) -> Column:
    """Number of words; a null text has none."""
    spaced = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), f"[{SPACES}]+", " "))
    return F.when(spaced == "", F.lit(0)).otherwise(F.length(spaced) - F.length(F.replace(spaced, F.lit(" "))) + 1).cast("long")


def join_small(df: DataFrame, small: DataFrame, on: Column | list[str], how: str = "inner") -> DataFrame:
    """Join a table that was written or checkpointed before: broadcast if its counted rows are few, else shuffled.

    Beyond the bound, adaptive execution splits the hot keys of the shuffled join.
    """
    few = small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return df.join(F.broadcast(small) if few else small, on, how)


def arrow_schema(df: DataFrame, fields: str) -> tuple[StructType, pa.Schema]:
    """The columns of ``df`` and further ``fields``, as a schema for ``mapInArrow`` and as one of Arrow."""
    spark = df.sparkSession
    whole = StructType([*df.schema.fields, *spark.createDataFrame([], fields).schema.fields])
    return whole, spark.createDataFrame([], whole).toArrow().schema


def row_struct(df: DataFrame, *left_out: str) -> Column:
    """All columns but some as one struct, so that names that an operator adds cannot clash with them."""
    kept = [F.col(f"`{c}`") for c in df.columns if c not in left_out]
    return F.struct(*kept) if kept else F.struct(F.lit(None).cast("int").alias("none"))


def row_hash(df: DataFrame) -> Column:
    """Hash of all columns; maps, which have no order, as JSON."""
    return F.xxhash64(*[F.to_json(f"`{f.name}`") if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in df.schema])
