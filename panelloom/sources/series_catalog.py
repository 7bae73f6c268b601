"""The catalog of series: one small row of metadata per series."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from panelloom.sources.errors import SourceError, UnknownSeriesError

# The metadata fields of a catalog entry, and the defaults of the column mapping.
FIELDS = ("id", "name", "unit", "source", "file_path", "timezone", "market", "type")
SCHEMA_DEFAULTS = {"date_column": "date", "close_column": "close", "date_format": "%Y-%m-%d"}


def read_document(path: str | Path) -> dict:
    """The content of a YAML or JSON file."""
    path = Path(path)
    text = path.read_text(encoding="utf-8")
    if path.suffix == ".json":
        return json.loads(text)
    try:
        import yaml
    except ImportError as error:
        raise SourceError("reading a YAML file needs PyYAML; use JSON instead") from error
    return yaml.safe_load(text) or {}


class SeriesCatalog:
    def __init__(self, entries: Iterable[Mapping], schema: Mapping | None = None, base_path: str | Path = "."):
        self.entries = {e["id"]: dict(e) for e in entries}
        self.schema = {**SCHEMA_DEFAULTS, **(schema or {})}
        self.base_path = Path(base_path)

    @classmethod
    def read(cls, path: str | Path, section: str = "series") -> SeriesCatalog:
        """Read a YAML or JSON file with a list of entries under ``section`` and an optional ``schema``."""
        document = read_document(path)
        return cls(document.get(section, []), document.get("schema"), Path(path).parent)

    def list(self) -> list[dict]:
        return list(self.entries.values())

    def get(self, series_id: str) -> dict:
        if series_id not in self.entries:
            raise UnknownSeriesError(f"no series {series_id!r} in the catalog")
        return self.entries[series_id]

    def to_frame(self, spark: SparkSession) -> DataFrame:
        rows = [tuple(e.get(f) for f in FIELDS) for e in self.entries.values()]
        columns = ", ".join(f"{'series_id' if f == 'id' else f} string" for f in FIELDS)
        return spark.createDataFrame(rows, columns)
