"""Saved Spark ML models, with a table that says which one is best for a scope of series, and a run log."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

REGISTRY_SCHEMA = "scope string, model string, metric_name string, metric double, is_best boolean, path string, saved_at timestamp"
WINNER_SCHEMA = "series_id string, model string, metric_name string, metric double, saved_at timestamp"
RUN_SCHEMA = "run_name string, logged_at timestamp, params map<string,string>, metrics map<string,double>"


def _now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


def _read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


class ModelRegistry:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self._loaded: dict[tuple[str, str | None], PipelineModel] = {}

    def save(
        self, model: PipelineModel, scope: str, name: str, metric: float | None = None, metric_name: str = "mae", best: bool = True
    ) -> str:
        path = f"{self.root}/models/{scope}/{name}{'_best' if best else ''}.model"
        model.write().overwrite().save(path)
        row = (scope, name, metric_name, metric, best, path, _now())
        self.spark.createDataFrame([row], REGISTRY_SCHEMA).write.mode("append").parquet(f"{self.root}/registry")
        self._loaded.clear()
        return path

    def entries(self) -> DataFrame:
        return _read_log(self.spark, f"{self.root}/registry", REGISTRY_SCHEMA)

    def save_winners(self, winners: DataFrame, metric_name: str) -> None:
        """Append the best model of each series, from a table with a row per series."""
        rows = winners.select(
            "series_id", "model", F.lit(metric_name).alias("metric_name"), F.col(metric_name).cast("double").alias("metric"), F.lit(_now()).alias("saved_at")
        )
        rows.write.mode("append").parquet(f"{self.root}/winners")

    def winners(self) -> DataFrame:
        """``series_id, model, metric_name, metric`` as saved last for each series."""
        saved = _read_log(self.spark, f"{self.root}/winners", WINNER_SCHEMA)
        newest = saved.groupBy("series_id").agg(F.max_by(F.struct("model", "metric_name", "metric"), "saved_at").alias("_w"))
        return newest.select("series_id", "_w.*")

    def load(self, scope: str, name: str | None = None) -> PipelineModel | None:
        """The newest best model of the scope, else its newest plain one, else None. Loaded once."""
        key = (scope, name)
        if key not in self._loaded:
            rows = self.entries().filter(F.col("scope") == scope)
            if name:
                rows = rows.filter(F.col("model") == name)
            newest = rows.orderBy(F.desc("is_best"), F.desc("saved_at")).limit(1).collect()
            if not newest:
                return None
            self._loaded[key] = PipelineModel.load(newest[0]["path"])
        return self._loaded[key]


class RunLog:
    """Append-only table of runs with their parameters and metrics."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path

    def record(self, run_name: str, params: dict, metrics: dict) -> None:
        row = (
            run_name,
            _now(),
            {k: str(v) for k, v in params.items()},
            {k: float(v) for k, v in metrics.items() if v is not None},
        )
        self.spark.createDataFrame([row], RUN_SCHEMA).write.mode("append").parquet(self.path)

    def read(self) -> DataFrame:
        return _read_log(self.spark, self.path, RUN_SCHEMA)
