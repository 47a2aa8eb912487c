import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tests.helpers import in_time_order, plan, raw_rows, same, skewed
from wattline.errors import InvalidQueryError
from wattline.operators.distribution import distribution
from wattline.operators.per_identifier import BROADCAST_LIMIT_BYTES, durable, join_facts
from wattline.series import Series

NAN, INF = float("nan"), float("inf")


@pytest.mark.parametrize(
    ("values", "buckets", "expected"),
    [
        ([0.0, 1.0, 2.0, 3.0, 4.0], 4, [(0, 1, 1), (1, 2, 1), (2, 3, 1), (3, 4, 2)]),
        ([0.0, 10.0], 4, [(0, 2.5, 1), (2.5, 5, 0), (5, 7.5, 0), (7.5, 10, 1)]),
        ([5.0, 5.0, 5.0], 3, [(5, 5, 3), (5, 5, 0), (5, 5, 0)]),
        ([1.0, NAN, 2.0], 2, [(NAN, NAN, 3), (NAN, NAN, 0)]),
        ([1.0, INF], 2, [(1, INF, 2), (INF, INF, 0)]),
        ([-INF, 1.0], 2, [(-INF, NAN, 2), (NAN, NAN, 0)]),
        ([0.0, 5e-324], 4, [(0, 0, 1), (0, 0, 0), (0, 0, 0), (0, 0, 1)]),
        ([-1.7e308, 1.7e308], 2, [(-1.7e308, INF, 2), (INF, INF, 0)]),
        ([], 4, []),
    ],
)
@pytest.mark.parametrize("limit_bytes", [0, BROADCAST_LIMIT_BYTES])
def test_vectors(spark, values, buckets, expected, limit_bytes):
    series = Series.raw(in_time_order(spark, values))
    rows = distribution(series, buckets=buckets, limit_bytes=limit_bytes).orderBy("bucket").collect()
    assert len(rows) == len(expected)
    for row, (lower, upper, elements) in zip(rows, expected, strict=True):
        assert same(row.lower, lower) and same(row.upper, upper) and row.elements == elements


@pytest.mark.parametrize("buckets", [0, -3])
def test_buckets_must_be_positive(spark, buckets):
    with pytest.raises(InvalidQueryError):
        distribution(Series.raw(in_time_order(spark, [1.0])), buckets=buckets)


def by_hand(values, n):
    low, high = min(values), max(values)
    width = (high - low) / n
    counts = Counter(min(math.trunc((v - low) / width), n - 1) if width > 0 else 0 for v in values)
    bounds, lower = [], low
    for i in range(n):
        bounds.append((lower, lower + width, counts[i]))
        lower += width
    return bounds


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    series=st.dictionaries(
        st.sampled_from("abcd"), st.lists(st.floats(-1e6, 1e6, width=32), min_size=1, max_size=25), min_size=1
    ),
    buckets=st.sampled_from([1, 2, 3, 7, 32, 33, 40]),
)
def test_bounds_and_counts_are_exact(spark, series, buckets):
    frame = raw_rows(spark, [(k, i, v) for k, values in series.items() for i, v in enumerate(values)])
    found = defaultdict(list)
    for row in distribution(Series.raw(frame), buckets=buckets).orderBy("identifier", "bucket").collect():
        found[row.identifier].append((row.lower, row.upper, row.elements))
    assert found == {k: by_hand(values, buckets) for k, values in series.items()}


@pytest.mark.parametrize("buckets", [13, 45])
@pytest.mark.parametrize("limit_bytes", [0, BROADCAST_LIMIT_BYTES])
def test_skewed_series_loses_nothing(spark, limit_bytes, buckets):
    rows = skewed(spark)
    values = defaultdict(list)
    for identifier, _, value in rows.collect():
        values[identifier].append(value)
    found = defaultdict(list)
    result = distribution(Series.raw(rows), buckets=buckets, limit_bytes=limit_bytes)
    for row in result.orderBy("identifier", "bucket").collect():
        found[row.identifier].append((row.lower, row.upper, row.elements))
    assert found == {k: by_hand(v, buckets) for k, v in values.items()}


def test_only_bounded_sides_are_broadcast(spark):
    rows = skewed(spark).select("identifier", "valueInW")
    sizes = rows.groupBy("identifier").agg(F.max("valueInW").alias("top"), F.count("*").alias("rows"))
    facts = durable(sizes.select("identifier", "top"))
    totals = durable(sizes.select("identifier", "rows"))
    assert "SortMergeJoin" not in plan(join_facts(rows, facts, totals))
    beyond = join_facts(rows, facts, totals, limit_bytes=0)
    # Hot identifiers are joined by broadcast and kept out of the shuffled rest.
    assert "SortMergeJoin" in plan(beyond) and "LeftAnti" in plan(beyond)
    assert beyond.count() == rows.count()


@pytest.mark.parametrize("limit_bytes", [0, BROADCAST_LIMIT_BYTES])
def test_left_join_keeps_rows_without_facts(spark, limit_bytes):
    rows = skewed(spark).select("identifier", "valueInW")
    totals = durable(rows.groupBy("identifier").agg(F.count("*").alias("rows")))
    facts = durable(rows.filter("identifier like 's1%'").groupBy("identifier").agg(F.max("valueInW").alias("top")))
    joined = join_facts(rows, facts, totals, how="left", limit_bytes=limit_bytes)
    assert joined.count() == rows.count()
    assert joined.filter("(top is null) = (identifier like 's1%')").count() == 0


def test_both_ways_of_counting_agree(spark):
    """32 buckets are columns, 33 are rows: the same data, the shared range of buckets compared whole."""
    rows = skewed(spark)
    for buckets in (32, 33):
        found = distribution(Series.raw(rows), buckets=buckets, keep_values=buckets == 33)
        assert found.schema["elements"].dataType.simpleString() == "bigint"
        values = defaultdict(list)
        for identifier, _, value in rows.collect():
            values[identifier].append(value)
        seen = defaultdict(list)
        for row in found.orderBy("identifier", "bucket").collect():
            seen[row.identifier].append((row.lower, row.upper, row.elements))
        assert seen == {k: by_hand(v, buckets) for k, v in values.items()}


def test_null_identifiers_belong_to_no_series(spark):
    rows = raw_rows(spark, [("a", 1, 1.0), (None, 2, 5.0), ("a", None, 9.0)])
    assert [tuple(r) for r in distribution(Series.raw(rows), buckets=1).collect()] == [("a", 0, 1.0, 1.0, 1)]
