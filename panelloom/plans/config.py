"""Settings of a run from a YAML or JSON file: target, features, split, backtest, models and metric.

Sections and keys that are missing keep their defaults. Model names map to the learners here; enabled models of kinds
that are not built are reported in ``unsupported`` and leave the rest of the run as it is.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from pathlib import Path

from panelloom.operators.backtest import BASELINES
from panelloom.operators.forecast import HORIZONS, z_of
from panelloom.operators.splits import FOLD_METHODS
from panelloom.sources.errors import SourceError
from panelloom.sources.series_catalog import read_document

# Model names of a settings file with the learner they stand for, and its parameters under Spark ML's names.
LEARNERS = {"xgboost": "gbt", "lightgbm": "gbt", "catboost": "gbt", "gbt": "gbt", "random_forest": "random_forest", "elasticnet": "elastic_net", "elastic_net": "elastic_net"}
PARAMETERS = {
    "gbt": {"n_estimators": "maxIter", "iterations": "maxIter", "max_depth": "maxDepth", "depth": "maxDepth", "learning_rate": "stepSize", "subsample": "subsamplingRate", "colsample_bytree": "featureSubsetStrategy"},
    "random_forest": {"n_estimators": "numTrees", "max_depth": "maxDepth", "min_samples_leaf": "minInstancesPerNode"},
    "elastic_net": {"alpha": "regParam", "l1_ratio": "elasticNetParam", "max_iter": "maxIter"},
}
TARGETS = {"close": "none", "log_close": "log", "log": "log", "return": "return", "log_return": "log_return", "none": "none"}
METRICS = ("mae", "rmse", "mape", "smape", "mase")


@dataclass(frozen=True)
class RunConfig:
    target: str = "none"
    horizons: tuple[int, ...] = HORIZONS
    features: dict = field(default_factory=dict)
    split: dict = field(default_factory=dict)
    backtest: dict = field(default_factory=dict)
    baselines: tuple[str, ...] = ("naive", "seasonal_naive")
    learners: dict[str, tuple[str, dict]] = field(default_factory=lambda: {k: (k, {}) for k in ("gbt", "random_forest", "elastic_net")})
    unsupported: tuple[str, ...] = ()
    ignored: tuple[str, ...] = ()
    primary_metric: str = "mae"
    n_days: int = 30
    z: float = z_of(0.95)

    @classmethod
    def read(cls, path: str | Path) -> RunConfig:
        return cls.of(read_document(path))

    @classmethod
    def of(cls, document: Mapping) -> RunConfig:
        """Settings from the sections of a file; a value that cannot be used raises ``SourceError``."""
        made: dict = {}
        forecast, future = document.get("forecast", {}), document.get("future_forecast", {})
        if "target" in forecast:
            made["target"] = _one_of(forecast["target"], TARGETS, "forecast.target")
        if "horizons" in forecast:
            made["horizons"] = tuple(int(h) for h in forecast["horizons"])
        if "n_days" in future:
            made["n_days"] = int(future["n_days"])
        if "confidence_level" in future:
            made["z"] = z_of(float(future["confidence_level"]))
        made["features"] = _renamed(
            document.get("features", {}),
            {"lag_days": "lags", "rolling_windows": "windows", "rolling_stats": "stats", "calendar_features": "calendar", "volatility_features": "volatility"},
        )
        made["split"] = _renamed(document.get("train_test_split", {}), {"train_ratio": "train_ratio", "min_test_days": "min_test", "gap_days": "gap"})
        made["backtest"] = _renamed(
            document.get("backtesting", {}), {"initial_train_days": "initial", "test_days": "test", "step_days": "step", "method": "method"}
        )
        if "method" in made["backtest"]:
            _one_of(made["backtest"]["method"], {m: m for m in FOLD_METHODS}, "backtesting.method")
        if "primary_metric" in document.get("evaluation", {}):
            made["primary_metric"] = _one_of(document["evaluation"]["primary_metric"], {m: m for m in METRICS}, "evaluation.primary_metric")
        if "models" in document:
            made |= _models(document["models"])
        return cls(**made)


def _one_of(value: str, known: Mapping[str, str], name: str) -> str:
    if value not in known:
        raise SourceError(f"{name} must be one of {tuple(known)}, not {value!r}")
    return known[value]


def _renamed(section: Mapping, names: Mapping[str, str]) -> dict:
    return {new: section[old] for old, new in names.items() if old in section}


def _models(section: Mapping) -> dict:
    baselines, learners, unsupported, ignored = [], {}, [], []
    for name, entry in section.items():
        entry = entry or {}
        if not entry.get("enabled", "enabled" in entry or name in BASELINES or name in LEARNERS):
            # a group of models of one family holds an entry for each
            unsupported += [f"{name}.{inner}" for inner, e in entry.items() if isinstance(e, Mapping) and e.get("enabled")]
        elif name in BASELINES:
            baselines.append(name)
        elif name in LEARNERS:
            kind, given = LEARNERS[name], entry.get("params", {})
            own = _renamed(given, PARAMETERS[kind])
            if "featureSubsetStrategy" in own:
                own["featureSubsetStrategy"] = str(own["featureSubsetStrategy"])
            ignored += [f"{name}.{p}" for p in given if p not in PARAMETERS[kind]]
            learners[name] = (kind, own)
        else:
            unsupported.append(name)
    return {"baselines": tuple(baselines), "learners": learners, "unsupported": tuple(unsupported), "ignored": tuple(ignored)}
