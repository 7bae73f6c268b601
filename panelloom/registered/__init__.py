"""All registered queries. Importing the modules fills the registry."""

import importlib

from panelloom.registered.catalog import REGISTERED

MODULES = (
    "loading",
    "quality",
    "cleaning",
    "targets",
    "features",
    "sequences",
    "splits",
    "metrics",
    "monitoring",
    "forecasts",
    "learners",
)
for _name in MODULES:
    importlib.import_module(f"panelloom.registered.{_name}")

__all__ = ["REGISTERED"]
