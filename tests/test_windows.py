import math
import statistics as py_statistics
from collections import defaultdict

from tests.helpers import aggregated_rows, plan, raw_rows, same, skewed
from wattline.operators.windows import combined_power, tumbling_windows

HOUR = 3_600_000


def test_statistics_of_one_window(spark):
    rows = raw_rows(spark, [("a", 0, 1.0), ("a", HOUR - 1, 3.0), ("a", HOUR, 7.0), ("b", 5, 2.0)])
    found = {(r.identifier, r.startTimestamp): r for r in tumbling_windows(rows, HOUR).collect()}
    assert len(found) == 3
    first = found["a", 0]
    assert tuple(first) == ("a", 0, HOUR, 2, 2.0, 1.0, 1.0, 3.0)
    assert tuple(found["a", HOUR]) == ("a", HOUR, 2 * HOUR, 1, 7.0, 0.0, 7.0, 7.0)


def test_nan_and_infinity(spark):
    inf, nan = float("inf"), float("nan")
    rows = raw_rows(spark, [("n", 0, 1.0), ("n", 1, nan), ("n", 2, 3.0), ("i", 0, 1.0), ("i", 1, inf)])
    found = {r.identifier: r for r in tumbling_windows(rows, HOUR).collect()}
    assert all(math.isnan(found["n"][c]) for c in ("mean", "populationVariance", "min", "max"))
    assert found["i"]["mean"] == inf and math.isnan(found["i"]["populationVariance"])
    assert (found["i"]["min"], found["i"]["max"]) == (1.0, inf)


def test_duplicates_count_and_inputs_merge(spark):
    raw = raw_rows(spark, [("a", 0, 1.0), ("a", 60_000, 3.0), ("a", 0, 1.0), ("a", 60_000, 3.0)])
    groups = aggregated_rows(spark, [("g", 0, 2, 10.0, 5.0), ("a", 1000, 1, 7.0, 7.0)])
    found = {r.identifier: r for r in tumbling_windows(combined_power(raw, groups), HOUR).collect()}
    assert found["a"]["count"] == 5 and found["a"]["mean"] == 3.0
    assert same(found["a"]["populationVariance"], 4.8, 1e-12)
    assert found["g"]["mean"] == 10.0


def test_null_keys_are_dropped(spark):
    assert tumbling_windows(raw_rows(spark, [(None, 0, 1.0)]), HOUR).count() == 0


def test_skewed_series_by_hand(spark):
    expected = defaultdict(list)
    for identifier, time, value in skewed(spark).collect():
        expected[identifier, time // HOUR * HOUR].append(value)
    found = tumbling_windows(skewed(spark), HOUR).collect()
    assert len(found) == len(expected)
    for row in found:
        values = expected[row.identifier, row.startTimestamp]
        assert row["count"] == len(values) and row["min"] == min(values) and row["max"] == max(values)
        assert same(row["mean"], py_statistics.fmean(values), 1e-9)
        assert same(row["populationVariance"], py_statistics.pvariance(values), 1e-6)


def test_one_exchange_after_partial_aggregation(spark):
    text = plan(tumbling_windows(skewed(spark), HOUR))
    assert text.count("Exchange") == 1
    assert "partial_avg" in text[text.index("Exchange"):]
    assert text.count("HashAggregate") == 2 and "SortAggregate" not in text
