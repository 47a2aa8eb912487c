import math
from collections import defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tests.helpers import in_time_order, plan, raw_rows, same, skewed
from wattline.errors import InvalidQueryError
from wattline.operators import ends
from wattline.operators.trend import trend
from wattline.restriction import TimeRestriction
from wattline.series import Series

NAN = float("nan")


def brute_force(rows, n, newest):
    by_id = defaultdict(list)
    for identifier, time, value in rows:
        by_id[identifier].append((time, value))
    return {
        (identifier, time, value)
        for identifier, points in by_id.items()
        for time, value in sorted(points, reverse=newest)[:n]
    }


@pytest.mark.parametrize("n", [1, 2, 5, 100, 101, 250, 9_000, 100_000])
@pytest.mark.parametrize("newest", [True, False])
def test_ends_of_skewed_series(spark, n, newest):
    rows = skewed(spark)
    find = ends.latest if newest else ends.earliest
    found = [tuple(r) for r in find(Series.raw(rows), count=n).collect()]
    expected = brute_force([tuple(r) for r in rows.collect()], n, newest)
    assert len(found) == len(expected)
    assert set(found) == expected


@pytest.mark.parametrize("broadcast", [-1, 10 * 1024 * 1024])
def test_bucket_selection_with_either_join(spark, broadcast):
    rows = skewed(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        found = ends._by_buckets(rows, "identifier", "timestamp", 333, True).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {tuple(r) for r in found} == brute_force([tuple(r) for r in rows.collect()], 333, True)


@pytest.mark.parametrize("n", [1, 2, 100, 101])
@pytest.mark.parametrize("newest", [True, False])
def test_null_keys_and_times_take_no_part(spark, n, newest):
    good = [("a", t, float(t)) for t in range(150)] + [("b", 5, 1.0)]
    odd = [(None, t, 1.0) for t in range(300)] + [("a", None, 1.0), ("c", None, 2.0)]
    series = Series.raw(raw_rows(spark, good + odd))
    find = ends.latest if newest else ends.earliest
    assert {tuple(r) for r in find(series, count=n).collect()} == brute_force(good, n, newest)
    trends = {r.identifier: r.trend for r in trend(series, points_to_smooth=n).collect()}
    assert trends.keys() == {"a", "b"} and trends["b"] == 1.0
    start, end = [float(t) for t in range(n)][:150], [float(t) for t in range(150)][-n:]
    expected = sum(end) / len(end) / (sum(start) / len(start)) if sum(start) > 0 else 1.0
    assert same(trends["a"], expected, 1e-9)


def jobs_started_by(spark, build):
    group = f"jobs-{build!r}"
    spark.sparkContext.setJobGroup(group, "")
    try:
        build()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize("n", [1, 100, 101])
def test_nothing_runs_before_the_result_is_used(spark, n):
    series = Series.raw(skewed(spark))
    assert jobs_started_by(spark, lambda: ends.latest(series, count=n)) == 0
    assert jobs_started_by(spark, lambda: trend(series, points_to_smooth=n)) == 0


@pytest.mark.parametrize("query", ["latest", "trend"])
def test_many_records_take_two_scans(spark, tmp_path, query):
    skewed(spark).write.parquet(str(tmp_path / "t"))
    series = Series.raw(spark.read.parquet(str(tmp_path / "t")))
    rows = ends.latest(series, count=500) if query == "latest" else trend(series, points_to_smooth=500)
    rows.collect()
    final = plan(rows).split("== Initial Plan ==")[0]
    kept_whole_and_cut = 2 if query == "latest" else 1
    assert final.count("FileScan") <= 1 + kept_whole_and_cut


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    points=st.dictionaries(
        st.tuples(st.sampled_from("abc"), st.integers(-(10**8), 10**8)), st.floats(-100, 100), max_size=40
    ),
    n=st.integers(1, 6),
    newest=st.booleans(),
)
def test_every_method_agrees(spark, points, n, newest):
    rows = [(i, t, v) for (i, t), v in points.items()]
    frame = raw_rows(spark, rows)
    expected = brute_force(rows, n, newest)
    assert {tuple(r) for r in ends.outermost(frame, "identifier", "timestamp", n, newest=newest).collect()} == expected
    by_buckets = ends._by_buckets(frame, "identifier", "timestamp", n, newest)
    assert {tuple(r) for r in by_buckets.collect()} == expected


def test_order_and_restriction(spark):
    series = Series.raw(in_time_order(spark, [1.0, 2.0, 3.0, 4.0]))
    newest = ends.newest_first(ends.latest(series, TimeRestriction(to=2), 2), series)
    assert [r.timestamp for r in newest.collect()] == [2, 1]
    assert ends.latest(series, identifiers="nobody").count() == 0


@pytest.mark.parametrize("n", [0, -1])
def test_counts_must_be_positive(spark, n):
    series = Series.raw(in_time_order(spark, [1.0]))
    for query in (ends.latest, ends.earliest):
        with pytest.raises(InvalidQueryError):
            query(series, count=n)
    with pytest.raises(InvalidQueryError):
        trend(series, points_to_smooth=n)


def test_input_is_cut_before_the_shuffle(spark):
    ranked = plan(ends.latest(Series.raw(skewed(spark)), count=5))
    after_exchange = ranked.index("Exchange")
    assert "WindowGroupLimit" in ranked[after_exchange:]
    single = plan(ends.latest(Series.raw(skewed(spark))))
    assert "Sort" not in single and single.count("HashAggregate") == 2


@pytest.mark.parametrize(
    ("values", "k", "expected"),
    [
        ([1.0, 2.0, 3.0, 6.0], 1, 6.0),
        ([1.0, 3.0, 4.0, 8.0], 2, 3.0),
        ([2.0, 4.0], 10, 1.0),
        ([0.0, 5.0], 1, 1.0),
        ([-2.0, 5.0], 1, 1.0),
        ([NAN, 5.0], 1, 1.0),
        ([5.0, NAN], 1, NAN),
        ([1.0, 3.0, 4.0, 8.0], 1000, 1.0),
    ],
)
def test_trend(spark, values, k, expected):
    result = trend(Series.raw(in_time_order(spark, values)), points_to_smooth=k).first()
    assert same(result.trend, expected)


def test_one_point_trend_is_one_aggregate(spark):
    text = plan(trend(Series.raw(skewed(spark)), points_to_smooth=1))
    assert text.count("Exchange") == 1 and "Join" not in text


def test_trend_joins_without_another_shuffle(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert plan(trend(Series.raw(skewed(spark)))).count("Exchange") == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_trend_of_named_identifier_without_records(spark):
    series = Series.raw(in_time_order(spark, [1.0, 2.0]))
    found = {r.identifier: r.trend for r in trend(series, points_to_smooth=1, identifiers=["s", "x"]).collect()}
    assert found == {"s": 2.0, "x": -1.0}


def test_identifiers_without_records_are_observed(spark):
    from pyspark.sql import Observation

    series = Series.raw(in_time_order(spark, [1.0, 2.0]))
    rows = trend(series, points_to_smooth=1, identifiers=["s", "x", "y"])
    assert "CollectMetrics" in plan(rows)
    assert Observation and rows.count() == 3


def test_trend_of_skewed_series(spark):
    rows = [tuple(r) for r in skewed(spark).collect()]
    found = {r.identifier: r.trend for r in trend(Series.raw(skewed(spark)), points_to_smooth=120).collect()}
    points = defaultdict(list)
    for identifier, time, value in rows:
        points[identifier].append((time, value))
    for identifier, series in points.items():
        values = [v for _, v in sorted(series)]
        start, end = values[:120], values[-120:]
        start, end = math.fsum(start) / len(start), math.fsum(end) / len(end)
        assert same(found[identifier], end / start if start > 0 else 1.0, 1e-9)
