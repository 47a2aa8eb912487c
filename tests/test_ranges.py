import pytest
from pyspark.sql import functions as F

from tests.helpers import raw_rows
from wattline.operators import ranges
from wattline.restriction import TimeRestriction
from wattline.schemas import AGGREGATED_POWER, RAW_POWER, WINDOWED_POWER
from wattline.series import Series

MACHINE = [("machine", 10, 20.0), ("machine", 20, 20.0), ("machine", 30, 20.0)]


@pytest.mark.parametrize(
    ("restriction", "times"),
    [
        (TimeRestriction(), [10, 20, 30]),
        (TimeRestriction(from_=15), [20, 30]),
        (TimeRestriction(after=15), [20, 30]),
        (TimeRestriction(to=25), [10, 20]),
        (TimeRestriction(from_=10), [10, 20, 30]),
        (TimeRestriction(after=10), [20, 30]),
        (TimeRestriction(to=10), [10]),
        (TimeRestriction(from_=10, after=10), [20, 30]),
        (TimeRestriction(from_=20, after=10), [20, 30]),
        (TimeRestriction(from_=10, after=20), [30]),
        (TimeRestriction(from_=10, to=20, after=10), [20]),
    ],
)
def test_time_bounds(spark, restriction, times):
    series = Series.raw(raw_rows(spark, MACHINE))
    rows = ranges.records(series, restriction, "machine", ordered=True).collect()
    assert [r.timestamp for r in rows] == times
    assert ranges.count(series, restriction, "machine").first()["count"] == len(times)


def test_empty_store(spark):
    series = Series.raw(raw_rows(spark, []))
    assert ranges.records(series).count() == 0
    assert ranges.identifiers(series).count() == 0
    assert ranges.total_count(series).first()["count"] == 0


def test_named_identifiers_without_records_count_zero(spark):
    series = Series.raw(raw_rows(spark, MACHINE))
    counted = {r.identifier: r["count"] for r in ranges.count(series, identifiers=["x", "machine", "x"]).collect()}
    assert counted == {"x": 0, "machine": 3}


def test_identifier_filter_is_exact(spark):
    series = Series.raw(raw_rows(spark, [*MACHINE, ("machine2", 10, 1.0), ("Machine", 10, 1.0)]))
    assert ranges.records(series, identifiers="machine").count() == 3
    assert ranges.records(series, identifiers=["machine2", "Machine"]).count() == 2


def test_series_bindings(spark):
    aggregated = Series.aggregated(spark.createDataFrame([("g", 1, 2, 10.0, 5.0)], AGGREGATED_POWER))
    assert aggregated.values().collect() == [("g", 1, 10.0)]
    windowed = Series.windowed(spark.createDataFrame([("g", 1, 2, 3, 4.0, 5.0, 6.0, 7.0)], WINDOWED_POWER))
    assert windowed.values().collect() == [("g", 1, 4.0)]
    custom = Series(raw_rows(spark, MACHINE), "timestamp", F.col("valueInW") * 2)
    assert {r.value for r in custom.values().collect()} == {40.0}


def test_filters_reach_the_scan(spark, tmp_path):
    spark.createDataFrame(MACHINE, RAW_POWER).write.parquet(str(tmp_path / "t"))
    series = Series.raw(spark.read.parquet(str(tmp_path / "t")))
    plan = ranges.count(series, TimeRestriction(from_=15, to=25), "machine")._jdf.queryExecution().toString()
    assert "EqualTo(identifier,machine)" in plan
    assert "GreaterThanOrEqual(timestamp,15)" in plan
    assert "LessThanOrEqual(timestamp,25)" in plan
    assert "valueInW" not in plan[plan.rindex("ReadSchema"):]
