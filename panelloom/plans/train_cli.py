"""Train from the command line: ``python -m panelloom.plans.train_cli --catalog series.yaml --out models``."""

from __future__ import annotations

import argparse

from panelloom.plans.config import RunConfig
from panelloom.plans.training import prepare, train_baselines, train_learners
from panelloom.session import get_spark
from panelloom.sources.readers import load_all
from panelloom.sources.registry import ModelRegistry, RunLog
from panelloom.sources.series_catalog import SeriesCatalog


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description="Train forecasting models for a panel of series.")
    parser.add_argument("--catalog", required=True, help="YAML or JSON catalog of series")
    parser.add_argument("--out", default="artifacts", help="folder for models, registry and run log")
    parser.add_argument("-c", "--series", default="all", help="series id or 'all'")
    parser.add_argument("-m", "--model-type", default="all", choices=["baseline", "ml", "all"])
    parser.add_argument("--config", default=None, help="YAML or JSON file with the settings of the run")
    parser.add_argument("--no-log", action="store_true", help="do not write the run log")
    parser.add_argument("--no-save", action="store_true", help="do not save models")
    args = parser.parse_args(argv)
    spark = get_spark("panelloom-train")
    wanted = None if args.series == "all" else [args.series]
    raw, errors = load_all(spark, SeriesCatalog.read(args.catalog), series_ids=wanted)
    errors.show(truncate=False)
    config = RunConfig.read(args.config) if args.config else RunConfig()
    for name in config.unsupported:
        print("not built, left out:", name)
    prepared = prepare(raw, target=config.target, **config.features)
    if args.model_type in ("baseline", "all") and config.baselines:
        table, rejected = train_baselines(prepared, config.baselines, **config.backtest)
        table.show(truncate=False)
        rejected.show(truncate=False)
    if args.model_type in ("ml", "all") and config.learners:
        result = train_learners(
            prepared,
            config.learners,
            primary_metric=config.primary_metric,
            registry=None if args.no_save else ModelRegistry(spark, args.out),
            runs=None if args.no_log else RunLog(spark, f"{args.out}/runs"),
            **config.split,
        )
        result["metrics"].show(truncate=False)
        result["rejected"].show(truncate=False)
        result["failed"].show(truncate=False)
        print("best model:", result["best"])


if __name__ == "__main__":
    main()
