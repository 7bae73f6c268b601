"""Read raw price files into the panel schema ``series_id, date, value, ingest_seq``.

The raw text of both columns is kept as ``date_text`` and ``value_text`` for the quality checks.
"""

from __future__ import annotations

from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DateType, NumericType, TimestampNTZType, TimestampType

from panelloom.functions.numeric import nan_to_null
from panelloom.operators.filters import date_range
from panelloom.session import checkpointed
from panelloom.sources.errors import SourceError
from panelloom.sources.series_catalog import SeriesCatalog

PANEL_SCHEMA = "series_id string, date date, value double, ingest_seq bigint, date_text string, value_text string"
PARQUET_SUFFIXES = (".parquet", ".pq")
#: Columns of a header that are looked at for the wanted ones.
HEADER_COLUMNS = 256


def scan(spark: SparkSession, paths: str | list[str], suffix: str) -> DataFrame:
    """CSV (header, ``#`` comments, all text) or Parquet, chosen by suffix."""
    if suffix == ".csv":
        return spark.read.option("header", True).option("comment", "#").csv(paths)
    if suffix in PARQUET_SUFFIXES:
        return spark.read.parquet(*([paths] if isinstance(paths, str) else paths))
    raise SourceError(f"cannot read files ending in {suffix!r}")


def resolve_column(df: DataFrame, wanted: str) -> str:
    """The column whose name matches without regard to case."""
    matches = [c for c in df.columns if c.strip().lower() == wanted.lower()]
    if not matches:
        raise SourceError(f"no column {wanted!r} among {df.columns}")
    if len(matches) > 1:
        raise SourceError(f"column {wanted!r} is ambiguous among {df.columns}")
    return matches[0]


def _spark_date_format(strptime_format: str) -> str:
    # Strptime directives and their Spark datetime patterns.
    for directive, pattern in {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%y": "yy"}.items():
        strptime_format = strptime_format.replace(directive, pattern)
    return strptime_format


_ISO_DATE = r"^([0-9]{4}-[0-9]{1,2}-[0-9]{1,2})([ T][0-9]{1,2}:[0-9]{2}(:[0-9]{2}([.][0-9]+)?)?(Z|[+-][0-9]{2}:?[0-9]{2})?)?$"


def parse_date(text: Column, date_format: str = "yyyy-MM-dd") -> Column:
    """Date or NULL; an ISO date may be followed by a time of day, which is dropped, and by nothing else."""
    if date_format != "yyyy-MM-dd":
        return F.try_to_timestamp(text, F.lit(date_format)).cast("date")
    return F.regexp_extract(text, _ISO_DATE, 1).try_cast("date")


def parse_number(text: Column) -> Column:
    return nan_to_null(text.try_cast("double"))


def _is(df: DataFrame, column: str, *kinds: type[DataType]) -> bool:
    return isinstance(df.schema[column].dataType, kinds)


def standardize(
    df: DataFrame,
    series_id: str | Column,
    date_column: str = "date",
    value_column: str = "close",
    date_format: str = "yyyy-MM-dd",
    ingest_seq: Column | None = None,
) -> DataFrame:
    """Project to the panel schema; what cannot be parsed becomes NULL and the row stays.

    A date column that is a date already stays as it is, so a later filter on it reaches the scan; a timestamp loses
    its time of day, and a number is cast. Text is parsed.
    """
    date_name, value_name = resolve_column(df, date_column), resolve_column(df, value_column)
    raw_date, raw_value = F.col(f"`{date_name}`"), F.col(f"`{value_name}`")
    # a CSV line may end in a comment of its own
    date_text = F.trim(F.regexp_replace(raw_date.cast("string"), "#.*$", ""))
    value_text = F.trim(F.regexp_replace(raw_value.cast("string"), "#.*$", ""))
    if _is(df, date_name, DateType):
        date = raw_date
    elif _is(df, date_name, TimestampType, TimestampNTZType):
        date = raw_date.cast("date")
    else:
        date = parse_date(date_text, date_format)
    value = nan_to_null(raw_value.cast("double")) if _is(df, value_name, NumericType) else parse_number(value_text)
    return df.select(
        (F.lit(series_id) if isinstance(series_id, str) else series_id).alias("series_id"),
        date.alias("date"),
        value.alias("value"),
        (F.monotonically_increasing_id() if ingest_seq is None else ingest_seq).cast("bigint").alias("ingest_seq"),
        F.nullif(date_text, F.lit("")).alias("date_text"),
        F.nullif(value_text, F.lit("")).alias("value_text"),
    )


def typed_range(df: DataFrame, date_column: str, start: str | None, end: str | None) -> DataFrame:
    """``date_range`` on a source column of timestamps, as a comparison that a scan can use; other columns are left.

    Rows without a date go only when a bound is given, as with ``date_range``.
    """
    name = resolve_column(df, date_column)
    if not _is(df, name, TimestampType, TimestampNTZType):
        return df
    at, kind = F.col(f"`{name}`"), df.schema[name].dataType
    if start is not None:
        df = df.filter(at >= F.lit(start).cast("date").cast(kind))
    if end is not None:
        df = df.filter(at < F.date_add(F.lit(end).cast("date"), 1).cast(kind))
    return df


def _locate(catalog: SeriesCatalog, entry: dict) -> str:
    kind = entry.get("source", "file")
    if kind != "file":
        raise SourceError(f"cannot read from source kind {kind!r}")
    path = str(entry["file_path"])
    if "://" not in path and not Path(path).is_absolute():
        path = str(catalog.base_path / path)
    suffix = Path(path).suffix.lower()
    if suffix != ".csv" and suffix not in PARQUET_SUFFIXES:
        raise SourceError(f"cannot read files ending in {suffix!r}")
    return path


def existing(spark: SparkSession, paths: Iterable[str]) -> set[str]:
    """Which paths exist, asked of their file systems with one listing for each folder."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folders: dict[str, list[str]] = {}
    for path in paths:
        folders.setdefault(path.rstrip("/").rpartition("/")[0], []).append(path)
    found: set[str] = set()
    for folder, wanted in folders.items():
        place = jvm.org.apache.hadoop.fs.Path(folder or "/")
        system = place.getFileSystem(conf)
        if system.exists(place):
            names = {status.getPath().getName() for status in system.listStatus(place)}
            found.update(p for p in wanted if p.rstrip("/").rpartition("/")[2] in names)
    return found


def load_series(
    spark: SparkSession, catalog: SeriesCatalog, series_id: str, start: str | None = None, end: str | None = None
) -> DataFrame:
    """One series; raises when it is unknown or its source cannot be read."""
    path = _locate(catalog, catalog.get(series_id))
    if path not in existing(spark, [path]):
        raise SourceError(f"no file at {path}")
    schema = catalog.schema
    source = typed_range(scan(spark, path, Path(path).suffix.lower()), schema["date_column"], start, end)
    panel = standardize(
        source, series_id, schema["date_column"], schema["close_column"], _spark_date_format(schema["date_format"])
    )
    return date_range(panel, start, end)


def load_all(
    spark: SparkSession,
    catalog: SeriesCatalog,
    start: str | None = None,
    end: str | None = None,
    series_ids: Iterable[str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """All readable series, and a table ``series_id, error`` of the sources that failed with the reason.

    All CSV files are one scan and all Parquet files another, whatever their headers, and a row finds its series
    through its file name: the number of jobs does not depend on the number of files. Headers are read by a job, one
    row a file; a file whose header lacks a wanted column, or names it twice, becomes a row of the failures. So does a
    Parquet source in which a wanted column is missing or empty throughout.
    """
    owners: dict[str, list[tuple[str, str]]] = {"csv": [], "parquet": []}
    failures = []
    for series_id in series_ids or catalog.entries:
        try:
            path = _locate(catalog, catalog.get(series_id))
            owners["csv" if path.lower().endswith(".csv") else "parquet"].append((path, series_id))
        except (SourceError, KeyError) as error:
            failures.append((series_id, f"{type(error).__name__}: {error}"))
    there = existing(spark, [path for rows in owners.values() for path, _ in rows])
    failures += [(s, f"SourceError: no file at {path}") for rows in owners.values() for path, s in rows if path not in there]
    panel, errors = spark.createDataFrame([], PANEL_SCHEMA), spark.createDataFrame(failures, "series_id string, error string")
    for read, rows in ((_load_csv, owners["csv"]), (_load_parquet, owners["parquet"])):
        if rows := [(path.rstrip("/"), s) for path, s in rows if path in there]:
            part, failed = read(spark, rows, catalog.schema, start, end)
            panel, errors = panel.unionByName(part), errors.unionByName(failed)
    return date_range(panel, start, end), errors


def _file() -> Column:
    """The path of a row's file as a catalog states it; the metadata escape it like a URL."""
    return F.regexp_replace(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), "^file:/*", "/").alias("_file")


def _bare(path: str) -> str:
    return "/" + path[len("file:") :].lstrip("/") if path.startswith("file:") else path


def _owned(files: DataFrame, rows: list[tuple[str, str]]) -> DataFrame:
    """The files (``_file``) of each series: a source is a file or the folder that holds it."""
    table = files.sparkSession.createDataFrame([(_bare(path), s) for path, s in rows], "_path string, series_id string")
    places = files.withColumn("_path", F.explode(F.array("_file", F.regexp_replace("_file", "/[^/]*$", ""))))
    return places.join(table, "_path").drop("_path")


def csv_headers(lines: DataFrame) -> DataFrame:
    """``_file, _at, _names, _width`` of every file of ``_file, _at, value``: where its header stands and what it names.

    Names are in lower case and in their places, NULL where there is none.
    """
    first = lines.groupBy("_file").agg(F.min_by(F.struct("_at", "value"), "_at").alias("_h"))
    cells = F.from_csv(F.col("_h.value"), ", ".join(f"c{i} string" for i in range(HEADER_COLUMNS)))
    parsed = first.select("_file", F.col("_h._at").alias("_at"), cells.alias("_cells"))
    names = F.transform(F.array(*[F.col(f"_cells.c{i}") for i in range(HEADER_COLUMNS)]), lambda n: F.lower(F.trim(n)))
    named = parsed.select("_file", "_at", names.alias("_names"))
    return named.withColumn("_width", F.array_max(F.transform("_names", lambda n, i: F.when(n.isNotNull(), i + 1))))


def _load_csv(spark: SparkSession, rows: list[tuple[str, str]], schema: dict, start: str | None, end: str | None) -> tuple[DataFrame, DataFrame]:
    paths = list(dict.fromkeys(path for path, _ in rows))
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    lines = spark.read.text(paths).select(_file(), place.alias("_at"), F.regexp_replace("value", "^\ufeff", "").alias("value"))
    lines = lines.filter(~F.col("value").rlike(r"^\s*(#.*)?$"))
    wanted = {name: schema[key].strip().lower() for name, key in (("_date", "date_column"), ("_value", "close_column"))}
    found = csv_headers(lines)
    for name, column in wanted.items():
        places = F.filter(F.transform("_names", lambda n, i: F.when(n == column, i)), lambda i: i.isNotNull())
        found = found.withColumn(name, places)
    headers = checkpointed(found)  # a row a file
    bad = F.concat_ws(
        "; ",
        *[
            F.when(F.size(name) != 1, F.concat(F.lit(f"SourceError: column '{column}' stands "), F.size(name).cast("string"), F.lit(" times in the header")))
            for name, column in wanted.items()
        ],
    )
    owned = _owned(headers.withColumn("error", bad), rows)
    named = spark.createDataFrame([(s,) for s in dict.fromkeys(s for _, s in rows)], "series_id string")
    failed = owned.filter("error <> ''").groupBy("series_id").agg(F.min("error").alias("error"))
    empty = named.join(owned.select("series_id").distinct(), "series_id", "left_anti").withColumn("error", F.lit("SourceError: no header"))
    widest = headers.agg(F.max("_width")).first()[0] or 1
    cells = F.from_csv("value", ", ".join(f"c{i} string" for i in range(widest)))
    good = owned.join(failed, "series_id", "left_anti")
    keys = good.select("_file", F.col("_at").alias("_header"), "series_id", *[F.get(n, F.lit(0)).alias(n) for n in wanted])
    body = lines.join(keys, "_file").filter(F.col("_at") > F.col("_header")).withColumn("_cells", cells)
    picked = body.select("series_id", *[F.get(F.array(*[F.col("_cells")[f"c{i}"] for i in range(widest)]), n).alias(n) for n in wanted])
    panel = standardize(picked, F.col("series_id"), "_date", "_value", _spark_date_format(schema["date_format"]))
    return panel, failed.unionByName(empty)


def _load_parquet(spark: SparkSession, rows: list[tuple[str, str]], schema: dict, start: str | None, end: str | None) -> tuple[DataFrame, DataFrame]:
    paths = list(dict.fromkeys(path for path, _ in rows))
    source = spark.read.option("mergeSchema", True).parquet(*paths)
    columns = {"_date": schema["date_column"], "_value": schema["close_column"]}
    names = {}
    for new, wanted in columns.items():
        try:
            names[new] = F.col(f"`{resolve_column(source, wanted)}`")
        except SourceError as error:
            return spark.createDataFrame([], PANEL_SCHEMA), spark.createDataFrame([(s, f"SourceError: {error}") for _, s in rows], "series_id string, error string")
    seen = source.select(_file(), *[c.alias(n) for n, c in names.items()])
    counts = checkpointed(_owned(seen.groupBy("_file").agg(*[F.count(n).alias(n) for n in names]), rows))  # a row a file
    found = counts.groupBy("series_id").agg(*[F.sum(n).alias(n) for n in names])
    bad = F.concat_ws("; ", *[F.when(F.col(n) == 0, f"SourceError: no column '{columns[n]}', or nothing in it") for n in names])
    failed = found.select("series_id", bad.alias("error")).filter("error <> ''")
    named = spark.createDataFrame([(s,) for s in dict.fromkeys(s for _, s in rows)], "series_id string")
    empty = named.join(found, "series_id", "left_anti").select("series_id", F.lit("SourceError: no rows").alias("error"))
    keys = counts.select("_file", "series_id").join(failed, "series_id", "left_anti")
    picked = typed_range(seen, "_date", start, end).join(keys, "_file")
    panel = standardize(picked, F.col("series_id"), "_date", "_value", _spark_date_format(schema["date_format"]))
    return panel, failed.unionByName(empty)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Saved predictions or processed panels: CSV by suffix, Parquet otherwise."""
    if path.rstrip("/").endswith(".csv"):
        return spark.read.option("header", True).option("inferSchema", True).csv(path)
    return spark.read.parquet(path)
