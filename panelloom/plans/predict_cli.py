"""Predict from the command line: ``python -m panelloom.plans.predict_cli --catalog series.yaml --models artifacts``."""

from __future__ import annotations

import argparse

from panelloom.operators.backtest import BASELINES
from panelloom.plans.config import RunConfig
from panelloom.plans.prediction import predict_all, predict_routed
from panelloom.plans.training import POOLED_SCOPE
from panelloom.session import get_spark
from panelloom.sources.readers import load_all
from panelloom.sources.registry import ModelRegistry
from panelloom.sources.series_catalog import SeriesCatalog
from panelloom.sources.writers import save_predictions


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description="Predict a panel of series.")
    parser.add_argument("--catalog", required=True, help="YAML or JSON catalog of series")
    parser.add_argument("--models", default="artifacts", help="folder the models were saved under")
    parser.add_argument("-c", "--series", default="all", help="series id or 'all'")
    parser.add_argument("-n", "--horizons", default=None, help="days ahead, comma separated; default 1,7,30 or those of --config")
    parser.add_argument("--config", default=None, help="YAML or JSON file with the settings of the run")
    parser.add_argument("--per-series", action="store_true", help="predict each series with the saved model that is best for it")
    parser.add_argument("-o", "--output", default="predictions", help="folder for the predictions")
    parser.add_argument("-f", "--format", default="parquet", choices=["parquet", "csv"])
    parser.add_argument("-m", "--model", default=None, help="a baseline or a saved model; default the best saved one")
    parser.add_argument("--as-of", default=None, help="hide rows after this date")
    args = parser.parse_args(argv)
    spark = get_spark("panelloom-predict")
    wanted = None if args.series == "all" else [args.series]
    raw, errors = load_all(spark, SeriesCatalog.read(args.catalog), series_ids=wanted)
    errors.show(truncate=False)
    config = RunConfig.read(args.config) if args.config else RunConfig()
    horizons = [int(h) for h in args.horizons.split(",")] if args.horizons else list(config.horizons)
    registry = ModelRegistry(spark, args.models)
    if args.per_series:
        winners = registry.winners()
        names = [r["model"] for r in winners.select("model").distinct().collect()]
        models = {name: name if name in BASELINES else registry.load(POOLED_SCOPE, name) for name in names}
        table, lost = predict_routed(raw, winners, {n: m for n, m in models.items() if m is not None}, horizons, args.as_of)
    else:
        model = args.model if args.model in BASELINES else registry.load(POOLED_SCOPE, args.model)
        if model is None:
            raise SystemExit("no saved model; train one or name a baseline with -m")
        table, lost = predict_all(raw, model, horizons, args.as_of)
    lost.show(truncate=False)
    print(save_predictions(table, args.output, args.format))


if __name__ == "__main__":
    main()
