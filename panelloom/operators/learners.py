"""Tree and linear models on Spark ML: one pooled model over all series.

Price-level features and the label are divided by the previous value, so series of any price level can share
a model; predictions are multiplied back.
"""

from __future__ import annotations

import random
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


BASE = "lag_1"
LEVELS = ("lag_", "rolling_")
SEED = 42

# Default model parameters and search spaces, under Spark ML's names. The linear penalty is in units of
# the value, as for a model of one series in its own units.
DEFAULTS = {
    "gbt": {"maxIter": 500, "maxDepth": 6, "stepSize": 0.05, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8"},
    "random_forest": {"numTrees": 200, "maxDepth": 10},
    "elastic_net": {"regParam": 1.0, "elasticNetParam": 0.5, "maxIter": 5000},
}
SEARCH = {
    "gbt": {
        "maxIter": [100, 300, 500, 1000],
        "maxDepth": [3, 5, 7, 10],
        "stepSize": [0.01, 0.05, 0.1],
        "subsamplingRate": [0.6, 0.8, 1.0],
        "featureSubsetStrategy": ["0.6", "0.8", "1.0"],
    },
    "random_forest": {"numTrees": [100, 300, 500], "maxDepth": [10, 20, 30], "minInstancesPerNode": [2, 5, 10]},
    "elastic_net": {"regParam": [0.01, 0.1, 1.0, 10.0], "elasticNetParam": [0.1, 0.5, 0.9]},
}
_ESTIMATORS = {"gbt": GBTRegressor, "random_forest": RandomForestRegressor, "elastic_net": LinearRegression}


def relative(df: DataFrame, columns: Sequence[str], target: str | None = "value") -> DataFrame:
    """Add ``_x_`` inputs and ``label``, levels divided by the previous value; NULL where that is missing or zero."""
    base = F.nullif(F.col(BASE).cast("double"), F.lit(0.0))
    scaled = {f"_x_{c}": F.col(c).cast("double") / base if c.startswith(LEVELS) else F.col(c).cast("double") for c in columns}
    if target:
        scaled["label"] = F.col(target) / base
    return df.withColumns(scaled)


@dataclass
class Learner:
    """A pooled model: ``fit`` on rows with features, then ``predict`` adds ``prediction``."""

    kind: str
    columns: Sequence[str]
    params: dict = field(default_factory=dict)
    model: PipelineModel | None = None

    def __post_init__(self) -> None:
        if self.kind not in _ESTIMATORS:
            raise ValueError(f"learner must be one of {tuple(_ESTIMATORS)}")
        if BASE not in self.columns:
            raise ValueError(f"the features must hold {BASE}")

    def _estimator(self, validation: str | None = None, level: float = 1.0):
        """``level`` is the size of the values that the label is a ratio to."""
        params = {**DEFAULTS[self.kind], **self.params}
        if self.kind == "elastic_net":
            params["regParam"] = params["regParam"] / level
        if self.kind != "elastic_net":
            params["seed"] = SEED
        if validation and self.kind == "gbt":
            params["validationIndicatorCol"] = validation
        return _ESTIMATORS[self.kind](featuresCol="_vector", labelCol="label", predictionCol="_ratio", **params)

    def _assembler(self) -> VectorAssembler:
        return VectorAssembler(inputCols=[f"_x_{c}" for c in self.columns], outputCol="_vector", handleInvalid="keep")

    def fit(self, train: DataFrame, validation: str | None = None, target: str = "value") -> Learner:
        """``validation`` names a boolean column of held-out rows that stop boosting early."""
        rows = training_rows(train, self.columns, target)
        if self.kind != "gbt" and validation:
            rows = rows.filter(~F.col(validation))
        if rows.isEmpty():
            raise ValueError("no training row has a label and all features")
        level = level_of(rows) if self.kind == "elastic_net" else 1.0
        narrow = rows.select("label", *[f"_x_{c}" for c in self.columns], *([validation] if validation else []))
        narrow = narrow.persist(StorageLevel.MEMORY_AND_DISK)  # fitting passes over the rows many times
        try:
            self.model = Pipeline(stages=[self._assembler(), self._estimator(validation, level)]).fit(narrow)
        finally:
            narrow.unpersist()
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        if self.model is None:
            raise ValueError("fit or load the model first")
        return apply_model(self.model, df, self.columns)

    def importances(self, top: int = 20) -> DataFrame:
        """The most important features of a fitted tree model, largest first."""
        fitted = self.model.stages[-1]
        pairs = [(c, float(v)) for c, v in zip(self.columns, fitted.featureImportances.toArray())]
        table = SparkSession.active().createDataFrame(pairs, "feature string, importance double")
        return table.orderBy(F.desc("importance"), "feature").limit(top)


def training_rows(df: DataFrame, columns: Sequence[str], target: str = "value") -> DataFrame:
    return relative(df, columns, target).dropna(subset=["label", *[f"_x_{c}" for c in columns]])


def level_of(rows: DataFrame) -> float:
    """Mean size of the previous values of training rows."""
    return rows.agg(F.avg(F.abs(F.col(BASE)))).first()[0] or 1.0


def apply_model(model: PipelineModel, df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Predictions in the units of the value, NULL where the inputs cannot be scaled; the helper columns go.

    No row is filtered: in a recursive forecast a filter would be pushed through every earlier step.
    """
    scored = model.transform(relative(df, columns, None))
    helpers = ["_vector", "_ratio", *[f"_x_{c}" for c in columns]]
    usable = F.col(BASE).isNotNull() & (F.col(BASE) != 0)
    return scored.withColumn("prediction", F.when(usable, F.col("_ratio") * F.col(BASE))).drop(*helpers)


def model_columns(model: PipelineModel) -> list[str]:
    """The feature columns a saved model was fitted on."""
    return [c.removeprefix("_x_") for c in model.stages[0].getInputCols()]


def sample_params(space: dict[str, list], draws: int = 10, seed: int = SEED) -> list[dict]:
    """Distinct random combinations of a search space."""
    chooser = random.Random(seed)
    size = 1
    for options in space.values():
        size *= len(options)
    places = chooser.sample(range(size), min(draws, size))
    combinations = []
    for place in places:
        chosen = {}
        for name, options in space.items():
            place, i = divmod(place, len(options))
            chosen[name] = options[i]
        combinations.append(chosen)
    return combinations


def random_search(
    train: DataFrame,
    kind: str,
    columns: Sequence[str],
    draws: int = 10,
    folds: int = 3,
    space: dict[str, list] | None = None,
    parallelism: int = 4,
    seed: int = SEED,
    target: str = "value",
) -> tuple[Learner, list[tuple[dict, float]]]:
    """Random hyperparameter search by mean absolute error over contiguous date blocks.

    ``train`` holds the train rows of a ``chronological_split``. Returns the refitted best learner and the
    mean score of every draw.
    """
    learner = Learner(kind, columns)
    rows = training_rows(train, columns, target)
    block = F.floor((F.col("row_number") - 1) * folds / F.col("train_size"))
    rows = rows.withColumn("_fold", F.least(block, F.lit(folds - 1)).cast("int"))
    level = level_of(rows) if kind == "elastic_net" else 1.0
    rows = rows.select("label", "_fold", *[f"_x_{c}" for c in columns]).persist(StorageLevel.MEMORY_AND_DISK)
    estimator = learner._estimator(level=level)
    candidates = sample_params(space or SEARCH[kind], draws, seed)
    grid = [{estimator.getParam(name): value / level if name == "regParam" else value for name, value in c.items()} for c in candidates]
    search = CrossValidator(
        estimator=Pipeline(stages=[learner._assembler(), estimator]),
        estimatorParamMaps=grid,
        evaluator=RegressionEvaluator(labelCol="label", predictionCol="_ratio", metricName="mae"),
        numFolds=folds,
        foldCol="_fold",
        parallelism=parallelism,
    ).fit(rows)
    rows.unpersist()
    scores = list(zip(candidates, (float(m) for m in search.avgMetrics)))
    best = min(scores, key=lambda s: s[1])[0]
    return Learner(kind, columns, best, search.bestModel), scores
