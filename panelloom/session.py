"""Spark session settings and durable lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(app_name: str = "panelloom", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the operators rely on: UTC dates, AQE and skew-join splitting.

    Shuffle partitions are left to the cluster; AQE coalesces or splits them at run time.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str | None:
    """The folder that the cluster names in ``spark.checkpoint.dir``; None on a local master that names none."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if not named and not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return named


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder below ``shared_root``; a temporary one takes its place where a local master names none."""
    root = shared_root(spark) or tempfile.mkdtemp(prefix="panelloom-shared-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows from a new Parquet copy below ``shared_root``, for what is read many times and costly to work out."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage through the reliable checkpoint folder, so a lost executor loses no state.

    The folder is the one the cluster names in ``spark.checkpoint.dir``. A temporary folder is used only
    on a local master that names none.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_root(df.sparkSession) or tempfile.mkdtemp(prefix="panelloom-checkpoint-"))
    return df.checkpoint()
