from datetime import date

import pytest

from tidecast.operators.contract import (
    CONTRACT_COLUMNS,
    DemandContractError,
    coerce,
    validate,
    violations,
)
from tidecast.operators.reshape import wide_to_long

TEXT = ", ".join(f"{c} string" for c in CONTRACT_COLUMNS)
GOOD = [
    ("2016-03-01", "water", "10", "20", "25", "15", "60", "0"),
    ("2017-03-01", "water", "11", "21", "26", "16", "61", "1"),
]


def test_report_counts(spark):
    report = validate(spark.createDataFrame(GOOD, TEXT))
    assert report.rows == 2 and report.years == [2016, 2017] and report.duplicate_rows == 0
    assert [r["category"] for r in report.categories.collect()] == ["water"]
    assert sum(report.missing_by_column.values()) == 0
    assert [r["message"] for r in report.messages().collect()] == ["Category water has fewer than 10 observations"]


def test_missing_column_is_named(spark):
    with pytest.raises(DemandContractError, match="Missing required columns: rainfall"):
        coerce(spark.createDataFrame(GOOD, TEXT).drop("rainfall"))


def test_errors_are_joined_in_order(spark):
    rows = [*GOOD, GOOD[0], ("no day", "  ", "-1", "20", "25", "15", "101", "-2")]
    frame = spark.createDataFrame(rows, TEXT)
    with pytest.raises(DemandContractError) as caught:
        validate(frame)
    assert str(caught.value) == (
        "1 rows have invalid dates; 1 rows have empty categories; 1 duplicate date/category rows; "
        "sales values must be non-negative; humidity must be between 0 and 100; rainfall must be non-negative"
    )
    report = validate(frame, strict=False)
    messages = [r["message"] for r in report.messages().collect()]
    assert messages[-6:] == report.errors and messages[0].startswith("Category ")


def test_humidity_bounds_are_inclusive(spark):
    rows = [(*GOOD[0][:6], "0", "0"), (*GOOD[1][:6], "100", "0")]
    assert validate(spark.createDataFrame(rows, TEXT)).errors == []


def test_coercion_of_odd_text(spark):
    rows = [(" 2016-03-01 ", " water ", "NA", "1e2", "x", "", " 7 ", "1d"), ("2016-02-30", "NULL", *["1"] * 6)]
    first, second = coerce(spark.createDataFrame(rows, TEXT)).collect()
    assert first["date"] == date(2016, 3, 1) and first["category"] == "water"
    assert list(first)[2:] == [None, 100.0, None, None, 7.0, None]
    assert second["date"] is None and second["category"] is None


def test_validation_reads_its_source_once(spark, tmp_path):
    """Two bad rows and a repeated key; the rows that leave the scan are counted while they pass."""
    rows = [*GOOD, GOOD[0], ("x", "", "-1", "1", "1", "1", "1", "1")]
    spark.createDataFrame(rows, TEXT).write.parquet(str(tmp_path / "in"))
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    source = spark.read.parquet(str(tmp_path / "in"))
    report = validate(source.mapInArrow(counted, source.schema), strict=False)
    assert read.value == len(rows)
    assert report.rows == 4 and report.duplicate_rows == 1 and report.missing_by_column["date"] == 1
    assert report.errors[:3] == ["1 rows have invalid dates", "1 rows have empty categories", "1 duplicate date/category rows"]
    assert report.errors[3:] == ["sales values must be non-negative"]
    assert report.short_categories.count() == 2 and read.value == len(rows)


def test_empty_tables_have_a_report(spark):
    report = validate(spark.createDataFrame([], TEXT))
    assert report.rows == 0 and report.errors == [] and set(report.missing_by_column.values()) == {0} and report.years == []


def test_one_year_warns(spark):
    report = validate(spark.createDataFrame(GOOD[:1], TEXT))
    assert report.warnings == ["Fewer than two calendar years are available for a year-on-year holdout"]


def test_violations_list_every_broken_rule(spark):
    rows = [*GOOD, ("2016-03-02", "", "-1", "1", "1", "1", "1", "1")]
    found = violations(coerce(spark.createDataFrame(rows, TEXT))).collect()
    assert [r["violations"] for r in found] == [["empty category", "sales values must be non-negative"]]


WIDE = {
    "Date": ["1/3", "2/3"], "2016 water sales": ["10", "12"], "2017 water sales": ["20", "22"],
    "2016 AVG temp": ["1", "2"], "2017 AVG temp": ["3", "4"], "2016 MAX temp": ["5", "6"],
    "2017 MAX temp": ["7", "8"], "2016 MIN temp": ["1", "1"], "2017 MIN temp": ["1", "1"],
    "2016 Humidity": ["50", "51"], "2017 Humidity": ["52", "53"], "2016 Rainfall": ["0", "1"],
    "2017 Rainfall": ["2", "3"],
}


def wide(spark, columns):
    return spark.createDataFrame(list(zip(*columns.values(), strict=True)), list(columns))


def test_wide_to_long_maps_years_and_weather(spark):
    rows = {(r["date"], r["category"]): r for r in wide_to_long(wide(spark, WIDE)).collect()}
    assert len(rows) == 4
    row = rows[(date(2017, 3, 1), "water")]
    assert row["sales"] == 20 and row["rainfall"] == 2 and row["avg_temp"] == 3


def test_wide_renames_and_keeps_missing_weather(spark):
    columns = {"Date": ["29/2", "31/3"], "2015 insecticide control sales": ["1", "2"]}
    rows = wide_to_long(wide(spark, columns)).collect()
    assert {r["category"] for r in rows} == {"insect repellent"}
    assert {r["date"] for r in rows} == {None, date(2015, 3, 31)}
    assert all(r["humidity"] is None for r in rows)


def test_wide_errors(spark):
    with pytest.raises(ValueError, match="named Date"):
        wide_to_long(wide(spark, {"day": ["1/3"], "2016 water sales": ["1"]}))
    with pytest.raises(ValueError, match="sales"):
        wide_to_long(wide(spark, {"Date": ["1/3"], "water": ["1"]}))


def test_spellings_of_days_and_infinities(spark):
    spellings = ["2016-03-01", "2016/03/01", "03/01/2016", "20160301", "1 March 2016", "Mar 1, 2016", " 2016-03-01 10:00 "]
    rows = [(text, *GOOD[0][1:]) for text in spellings]
    assert {r["date"] for r in coerce(spark.createDataFrame(rows, TEXT)).collect()} == {date(2016, 3, 1)}
    odd = [("13/01/2016", *GOOD[0][1:]), ("day 1", *GOOD[0][1:]), ("", *GOOD[0][1:]), ("99999999", *GOOD[0][1:])]
    assert [r["date"] for r in coerce(spark.createDataFrame(odd, TEXT)).collect()] == [date(2016, 1, 13), None, None, None]
    endless = coerce(spark.createDataFrame([(*GOOD[0][:2], "inf", *GOOD[0][3:])], TEXT)).first()
    assert endless["sales"] == float("inf") or endless["sales"] is None or float("inf") in endless.asDict().values()
