import pytest

from panelloom.operators import cleaning, quality
from panelloom.registered.panels import text_columns
from tests.conftest import days


def column(df, name):
    return [r[name] for r in df.orderBy("series_id", "date").collect()]


def test_long_gap_is_filled_up_to_the_cap(panel):
    dates = days("2024-01-01", 30)
    keep = dates[:3] + dates[14:]  # 11 missing days
    cleaned = cleaning.clean(panel({"a": [(d, i) for i, d in enumerate(keep)]}))
    assert column(cleaned, "missing_streak")[3:14] == list(range(1, 12))
    assert column(cleaned, "value")[3:15] == [2.0] * 10 + [None, 3.0]
    assert column(cleaned, "is_imputed")[3:14] == [True] * 10 + [False]


def test_gap_of_exactly_the_cap_is_filled(panel):
    dates = days("2024-01-01", 30)
    cleaned = cleaning.clean(panel({"a": [(d, 1) for d in dates[:3] + dates[13:]]}))
    assert None not in column(cleaned, "value")


def test_business_calendar_drops_weekend_rows(panel):
    # Friday, Saturday, Monday, then weekdays only
    points = [("2024-01-05", 1), ("2024-01-06", 2), ("2024-01-08", 3)] + [(d, 4) for d in days("2024-01-09", 4)]
    points += [(d, 5) for d in days("2024-01-15", 5)]
    aligned = cleaning.align_calendar(panel({"a": points}))
    assert [str(d) for d in column(aligned, "date")][:3] == ["2024-01-05", "2024-01-08", "2024-01-09"]
    assert 2.0 not in column(aligned, "value")


def test_business_calendar_that_starts_on_a_weekend(panel):
    points = [("2024-01-06", 9)] + [(d, 1) for d in days("2024-01-09", 4)] + [(d, 1) for d in days("2024-01-15", 5) + days("2024-01-22", 5)]
    aligned = cleaning.align_calendar(panel({"a": points}))
    first = aligned.orderBy("date").first()
    assert (str(first["date"]), first["value"]) == ("2024-01-08", None)


def test_keep_last_arrival_even_when_it_has_no_value(panel):
    df = cleaning.dedupe_keep_last(panel({"a": [("2024-01-01", 1), ("2024-01-01", None), (None, 3)]}))
    assert [(str(r["date"]), r["value"], r["ingest_seq"]) for r in df.collect()] == [("2024-01-01", None, 1)]


def test_interpolation_is_by_position_and_holds_the_end(panel):
    aligned = panel({"a": [(d, v) for d, v in zip(days("2024-01-01", 7), [None, 1, None, None, 4, None, None])]})
    filled = cleaning.fill_gaps(cleaning.add_gap_columns(aligned), "interpolate")
    assert column(filled, "value") == [None, 1.0, 2.0, 3.0, 4.0, 4.0, 4.0]


def test_outlier_flag_needs_thirty_rows(panel):
    def flags(n):
        return column(cleaning.flag_outliers(panel({"a": [(d, 1000 if i == 5 else i % 2) for i, d in enumerate(days("2024-01-01", n))]})), "is_outlier")

    assert not any(flags(29))
    assert flags(30)[5]


def test_equal_values_have_no_score(panel):
    scored = cleaning.flag_outliers(panel({"a": [(d, 5) for d in days("2024-01-01", 40)]}))
    assert set(column(scored, "z_score")) == {None} and not any(column(scored, "is_outlier"))


def test_bad_options():
    with pytest.raises(ValueError):
        cleaning.align_calendar(None, "hourly")
    with pytest.raises(ValueError):
        cleaning.fill_gaps(None, "spline")


def checks(df, **options):
    return {r["check_name"]: r for r in quality.run_checks(text_columns(df), **options).collect()}


def test_valid_series_passes(panel):
    df = panel({"a": [(d, 100 + i % 7) for i, d in enumerate(days("2024-01-01", 300))]})
    report = quality.validate(text_columns(df)).first()
    assert report["passed"] and report["error_count"] == 0 and report["n_checks"] == 10


def test_duplicate_and_negative(panel):
    found = checks(panel({"a": [("2024-01-01", 100), ("2024-01-01", 101), ("2024-01-02", -5), ("2024-01-03", 0)]}))
    assert not found["date_unique"]["passed"] and found["date_unique"]["details"]["duplicate_dates"] == "2024-01-01"
    assert found["close_positive"]["details"]["negative_count"] == "1"
    assert found["date_chronological"]["passed"]


def test_missing_columns(spark):
    found = quality.run_checks(spark.createDataFrame([("a", 1)], "series_id string, other int")).collect()
    assert [(r["check_name"], r["passed"]) for r in found] == [("required_columns", False)]


def test_raise_mode(panel):
    with pytest.raises(quality.ValidationError):
        quality.validate(text_columns(panel({"a": [("2024-01-01", -1), ("2024-01-02", 1)]})), raise_on_failure=True)


def test_order_check_across_blocks(panel):
    ordered = panel({"a": [(d, 1) for d in days("2024-01-01", 10)]})
    broken = panel({"a": [(d, 1) for d in days("2024-01-06", 5) + days("2024-01-01", 5)]})
    for size in (1, 2, 5, 7, 100):
        assert quality.date_chronological(ordered, size).first()["passed"]
        assert quality.date_chronological(broken, size).first()["details"]["out_of_order"] == "1"


def test_outlier_rows_do_not_depend_on_chunks(panel):
    df = panel({"a": [(d, (i * 37) % 11 + (300 if i == 70 else 0)) for i, d in enumerate(days("2024-01-01", 200))]})
    expected = sorted(map(tuple, quality.outlier_rows(df).collect()))
    for size in (30, 41, 64):
        assert sorted(map(tuple, quality.outlier_rows(df, chunk_rows=size).collect())) == expected
