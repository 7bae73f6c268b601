import json

import pytest
from pyspark.sql import functions as F

from panelloom.operators import filters
from panelloom.operators.monitoring import read_log
from panelloom.sources.errors import SourceError, UnknownSeriesError
from panelloom.sources.readers import load_all, load_series, parse_date, read_table, standardize
from panelloom.sources.registry import RunLog
from panelloom.sources.series_catalog import SeriesCatalog
from panelloom.sources.writers import save, save_forecasts, save_predictions, save_processed


def write_catalog(tmp_path, files):
    entries = []
    for name, text in files.items():
        path = tmp_path / f"{name}.csv"
        path.write_text(text, encoding="utf-8")
        entries.append({"id": name, "name": name, "source": "file", "file_path": str(path)})
    return SeriesCatalog(entries)


def rows(df):
    return sorted((r["series_id"], str(r["date"]), r["value"]) for r in df.collect())


def test_csv_with_bom_comments_and_mixed_case(spark, tmp_path):
    catalog = write_catalog(
        tmp_path,
        {"a": "﻿Date,Close\n2024-01-01,100.0\n2024-01-02,101.5\n", "b": "# note\n\ndate,close\n2024-01-03,7 # late\n# end\n"},
    )
    assert rows(load_series(spark, catalog, "a")) == [("a", "2024-01-01", 100.0), ("a", "2024-01-02", 101.5)]
    assert rows(load_series(spark, catalog, "b")) == [("b", "2024-01-03", 7.0)]


def test_bad_cells_become_null_and_rows_stay(spark, tmp_path):
    catalog = write_catalog(tmp_path, {"a": "date,close\n2024-01-01,x\nsoon,5\n2024-01-03,NaN\n"})
    assert rows(load_series(spark, catalog, "a")) == [("a", "2024-01-01", None), ("a", "2024-01-03", None), ("a", "None", 5.0)]


def test_date_filter_is_inclusive_and_keeps_null_dates_only_without_bounds(spark, tmp_path):
    catalog = write_catalog(tmp_path, {"a": "date,close\n2024-01-01,1\n2024-01-02,2\n2024-01-03,3\nbad,4\n"})
    assert len(rows(load_series(spark, catalog, "a"))) == 4
    assert [r[2] for r in rows(load_series(spark, catalog, "a", "2024-01-01", "2024-01-02"))] == [1.0, 2.0]


def test_load_all_reports_failures_and_maps_files_to_series(spark, tmp_path):
    catalog = write_catalog(
        tmp_path, {"a": "date,close\n2024-01-01,1\n", "b": "date,close\n2024-01-02,2\n", "c": "day,price\n2024-01-01,1\n", "d": "Date,Close\n2024-01-05,5\n"}
    )
    catalog.entries["gone"] = {"id": "gone", "source": "file", "file_path": str(tmp_path / "gone.csv")}
    catalog.entries["odd"] = {"id": "odd", "source": "file", "file_path": str(tmp_path / "odd.xls")}
    (tmp_path / "odd.xls").write_text("x")
    panel, errors = load_all(spark, catalog)
    assert rows(panel) == [("a", "2024-01-01", 1.0), ("b", "2024-01-02", 2.0), ("d", "2024-01-05", 5.0)]
    assert {r["series_id"] for r in errors.collect()} == {"c", "gone", "odd"}


def test_headers_differ_from_file_to_file(spark, tmp_path):
    catalog = write_catalog(
        tmp_path,
        {
            "a": "close,note,DATE\n1,\"x,y\",2024-01-01\n2,z,2024-01-02 # late\n",
            "b b+c": "# first\n\n,date,,close\nq,2024-01-03,r,3,more\n# end\nq,2024-01-04\n",
            "twice": "date,close,Close\n2024-01-01,1,2\n",
            "empty": "# nothing\n",
            "bare": "date,close\n",
        },
    )
    folder = tmp_path / "parts.csv"
    folder.mkdir()
    for i in (1, 2):
        (folder / f"part-{i}.csv").write_text(f"date,close\n2024-02-0{i},{i}\n")
    catalog.entries["folder"] = {"id": "folder", "source": "file", "file_path": str(folder)}
    panel, errors = load_all(spark, catalog)
    want = [("a", "2024-01-01", 1.0), ("a", "2024-01-02", 2.0), ("b b+c", "2024-01-03", 3.0), ("b b+c", "2024-01-04", None), ("folder", "2024-02-01", 1.0), ("folder", "2024-02-02", 2.0)]
    assert rows(panel) == want
    assert {r["series_id"]: "2 times" in r["error"] for r in errors.collect()} == {"twice": True, "empty": False}
    assert rows(load_all(spark, catalog, "2024-01-02", "2024-01-03")[0]) == want[1:3]


def test_parquet_sources_keep_their_types_and_report_missing_columns(spark, tmp_path):
    times = spark.createDataFrame([("2024-01-01 23:00:00", 1.0), ("2024-01-02 00:00:00", 2.0), (None, 3.0)], "date string, close double")
    times.withColumn("date", F.to_timestamp("date")).write.parquet(str(tmp_path / "t.parquet"))
    times.select(F.col("close").alias("price")).write.parquet(str(tmp_path / "p.parquet"))
    entries = [{"id": n, "source": "file", "file_path": str(tmp_path / f"{n}.parquet")} for n in "tp"]
    panel, errors = load_all(spark, SeriesCatalog(entries))
    assert rows(panel) == [("t", "2024-01-01", 1.0), ("t", "2024-01-02", 2.0), ("t", "None", 3.0)]
    assert [r["series_id"] for r in errors.collect()] == ["p"]
    bounded = load_series(spark, SeriesCatalog(entries), "t", "2024-01-02", "2024-01-31")
    assert rows(bounded) == [("t", "2024-01-02", 2.0)]


@pytest.mark.parametrize("kind", ["date", "timestamp", "timestamp_ntz"])
def test_a_date_range_reaches_the_scan(spark, tmp_path, kind):
    days = spark.range(100).select(F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).cast(kind).alias("date"), F.col("id").alias("close"), F.lit("x").alias("note"))
    days.write.parquet(str(tmp_path / "s.parquet"))
    catalog = SeriesCatalog([{"id": "s", "source": "file", "file_path": str(tmp_path / "s.parquet")}])
    for panel in (load_series(spark, catalog, "s", "2024-02-01", "2024-02-10"), load_all(spark, catalog, "2024-02-01", "2024-02-10")[0]):
        assert panel.count() == 10
        plan = panel.select("series_id", "date", "value")._jdf.queryExecution().executedPlan().toString()
        pushed = [line for line in plan.splitlines() if "FileScan parquet" in line and "PushedFilters" in line]
        assert any("GreaterThanOrEqual(date,2024-02-01" in line and "LessThan" in line for line in pushed), plan
        assert "note" not in plan.split("ReadSchema", 1)[1].split("\n")[0]


def test_the_number_of_jobs_does_not_grow_with_the_files(spark, tmp_path):
    def jobs(n):
        folder = tmp_path / str(n)
        folder.mkdir()
        catalog = write_catalog(folder, {f"s{i}": f"date,close{',x' * (i % 3)}\n2024-01-0{1 + i % 9},{i}{',0' * (i % 3)}\n" for i in range(n)})
        spark.sparkContext.setJobGroup(f"load-{n}", "")
        panel, errors = load_all(spark, catalog)
        assert panel.count() == n and errors.count() == 0
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"load-{n}"))

    assert jobs(400) <= jobs(40) + 2  # listing many paths is a job of its own


def test_two_entries_on_one_file_get_its_rows_once_each(spark, tmp_path):
    catalog = write_catalog(tmp_path, {"a": "date,close\n2024-01-01,1\n2024-01-02,2\n"})
    catalog.entries["b"] = catalog.entries["a"] | {"id": "b"}
    panel, _ = load_all(spark, catalog)
    assert rows(panel) == [(s, f"2024-01-0{d}", float(d)) for s in "ab" for d in (1, 2)]


def test_dates_are_parsed_by_their_format_only(spark):
    texts = ["2024-03-05", "2024-03-05 10:20:30", "2024-03-05T10:20", "2024", "2024-3", "2024-03-05 junk", "2024-02-30", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    found = [r.d for r in df.select("i", parse_date(F.col("t")).cast("string").alias("d")).orderBy("i").collect()]
    assert found == ["2024-03-05"] * 3 + [None] * 6


def test_logs_forgive_a_missing_path_only(spark, tmp_path):
    assert read_log(spark, str(tmp_path / "none"), "a int").count() == 0
    broken = tmp_path / "broken"
    broken.mkdir()
    (broken / "part-0.parquet").write_text("no parquet")
    with pytest.raises(Exception):  # noqa: B017
        read_log(spark, str(broken), "a int").count()


def test_load_all_empty_keeps_schema(spark):
    panel, errors = load_all(spark, SeriesCatalog([]))
    assert {"series_id", "date", "value", "ingest_seq"} <= set(panel.columns)
    assert panel.count() == 0 and errors.count() == 0


def test_source_errors(spark, tmp_path):
    catalog = write_catalog(tmp_path, {"a": "x,y\n1,2\n"})
    catalog.entries["api"] = {"id": "api", "source": "api", "file_path": "u"}
    with pytest.raises(UnknownSeriesError):
        load_series(spark, catalog, "nobody")
    with pytest.raises(SourceError):
        load_series(spark, catalog, "a")
    with pytest.raises(SourceError):
        load_series(spark, catalog, "api")
    with pytest.raises(SourceError):
        standardize(spark.createDataFrame([("a", "b", 1.0)], "date string, day string, close double").toDF("date", "DATE2", "close").withColumnRenamed("DATE2", "date "), "s")


def test_catalog_from_json_and_yaml(tmp_path):
    entry = {"id": "a", "name": "A", "file_path": "a.csv"}
    (tmp_path / "c.json").write_text(json.dumps({"series": [entry]}))
    (tmp_path / "c.yaml").write_text("series:\n  - id: a\n    name: A\n    file_path: a.csv\n")
    assert SeriesCatalog.read(tmp_path / "c.json").list() == SeriesCatalog.read(tmp_path / "c.yaml").list() == [entry]


def test_save_and_read_back(spark, panel, tmp_path):
    df = panel({"a": [("2024-01-01", 1)], "b": [("2024-01-01", 2)]})
    save_processed(df, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2
    with pytest.raises(SourceError):
        save(df, str(tmp_path / "x"), "xlsx")
    path = save_predictions(df, str(tmp_path / "pred"), run_ts="20240101_000000")
    assert path.endswith("run_ts=20240101_000000") and read_table(spark, path).count() == 2
    save(df.select("series_id", "value"), str(tmp_path / "t.csv"), "csv")
    assert read_table(spark, str(tmp_path / "t.csv")).count() == 2
    save_forecasts(df.withColumn("model", F.lit("naive")), str(tmp_path / "f"))
    assert (tmp_path / "f" / "series_id=a" / "model=naive").is_dir()


def test_run_log(spark, tmp_path):
    log = RunLog(spark, str(tmp_path / "runs"))
    assert log.read().count() == 0
    log.record("gbt", {"maxIter": 5}, {"mae": 1.5, "mase": None})
    assert [(r["run_name"], r["params"], r["metrics"]) for r in log.read().collect()] == [("gbt", {"maxIter": "5"}, {"mae": 1.5})]


def test_feature_column_choice(panel):
    df = panel({"a": [("2024-01-01", 1)]}).withColumns({c: F.lit(1.0) for c in ("lag_1", "return_1d", "is_dow_0", "z_score")})
    assert filters.feature_columns(df) == ["lag_1", "is_dow_0"]
    assert filters.feature_columns(df, leak_safe=False, day_of_week_flags=False) == ["lag_1", "return_1d"]


def test_as_of_raises_when_nothing_is_left(panel):
    with pytest.raises(ValueError):
        filters.as_of(panel({"a": [("2024-01-02", 1)]}), "2024-01-01", require_rows=True)
