"""Clustered files, fine counts, feeds with retention, quarantine and replay, decoded messages, observed warnings."""

import math
import random

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tests.helpers import plan, raw_rows, same, skewed
from wattline.errors import InvalidQueryError
from wattline.operators import fine_counts as fc
from wattline.operators.distribution import distribution
from wattline.operators.quality import CORRUPT, accepted
from wattline.operators.trend import trend, warn_of_missing
from wattline.operators.windows import tumbling_windows
from wattline.restriction import DAY_MS, TimeRestriction
from wattline.schemas import RAW_POWER, WINDOWED_POWER
from wattline.series import Series
from wattline.sources import folders
from wattline.sources.clustered import ClusteredStore, interleaved
from wattline.sources.quarantine import Quarantine
from wattline.sources.readers import decoded
from wattline.sources.table import KeyedTable
from wattline.streaming.feeds import RetainedFeed

HOUR = 3_600_000
INF, NAN = math.inf, math.nan


# -- clustered files -------------------------------------------------------------------------


def rows_of_scan(rows) -> int:
    """Rows that the only scan of a plan gave out, after it ran."""
    query = rows._jdf.queryExecution()
    query.executedPlan().executeCollect()
    return query.executedPlan().collectLeaves().head().metrics().get("numOutputRows").get().value()


@pytest.fixture(scope="module")
def clustered(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("clustered")
    rows = skewed(spark, n=200_000, others=60)
    store = ClusteredStore(f"{folder}/store", RAW_POWER)
    store.write(rows, files=24, row_group_bytes=8 * 1024)
    return store, rows


def test_lookups_equal_plain_filters(spark, clustered):
    store, rows = clustered
    middle = TimeRestriction(from_=61_000 * 90_000, to=61_000 * 110_000)
    for names in ("s7", "hot", ["s1", "s55", "s1", "absent"], [], None):
        for restriction in (TimeRestriction(), middle):
            found = store.series(spark, "valueInW", restriction, names)
            expected = Series.raw(rows).restricted(restriction, names)
            assert sorted(map(tuple, found.restricted(restriction, names).collect())) == sorted(map(tuple, expected.collect()))


def test_a_lookup_reads_less_than_a_tenth(spark, clustered):
    store, rows = clustered
    span = TimeRestriction(from_=61_000 * 90_000, to=61_000 * 95_000)
    for name, restriction in (("s7", TimeRestriction()), ("s55", TimeRestriction()), ("hot", span), (None, span)):
        found = store.rows(spark, restriction, name)
        assert 0 < rows_of_scan(found) < 0.1 * 200_000, (name, restriction)
    assert rows_of_scan(store.rows(spark, identifiers="absent")) < 0.1 * 200_000


def test_identifiers_have_bloom_filters(spark, tmp_path):
    """Where a column is no dictionary: many identifiers that occur once each."""
    rows = spark.range(40_000).select(F.sha2(F.col("id").cast("string"), 256).alias("identifier"), F.col("id").alias("timestamp"), F.lit(1.0).alias("valueInW"))
    ClusteredStore(f"{tmp_path}/s", RAW_POWER).write(rows, files=1, distinct=40_000)
    file = next((tmp_path / "s").glob("*.parquet"))
    java = spark._jvm
    path = java.org.apache.hadoop.fs.Path(str(file))
    reader = java.org.apache.parquet.hadoop.ParquetFileReader.open(java.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(path, spark._jsc.hadoopConfiguration()))
    offsets = {c.getPath().toDotString(): c.getBloomFilterOffset() for c in reader.getFooter().getBlocks().get(0).getColumns()}
    reader.close()
    assert offsets["identifier"] > 0 and offsets["valueInW"] <= 0


def test_hot_identifier_is_spread_over_files(spark, clustered, tmp_path):
    store, _ = clustered
    files = spark.read.parquet(store.path).filter("identifier = 'hot'").select(F.input_file_name()).distinct().count()
    assert files >= 6  # it has a third of the rows of 24 files


def test_curve_alternates_bits(spark):
    rows = spark.createDataFrame([(a, b) for a in range(8) for b in range(8)], "a int, b int")
    for a, b, z in rows.select("a", "b", interleaved(F.col("a"), F.col("b"), 3)).collect():
        assert z == sum(((a >> i & 1) << (2 * i + 1)) | ((b >> i & 1) << (2 * i)) for i in range(3))


# -- fine counts -----------------------------------------------------------------------------


def histogram(rows):
    return {(r["identifier"], r["bucket"]): (r["lower"], r["upper"], r["elements"]) for r in rows.collect()}


def assert_histograms(found, expected):
    found, expected = histogram(found), histogram(expected)
    assert found.keys() == expected.keys()
    for key, values in expected.items():
        for a, b in zip(found[key], values, strict=True):
            assert a == b or (a is not None and b is not None and same(a, b)), (key, found[key], values)


def odd_series(spark):
    rng = random.Random(2)
    rows = [(rng.choice("abc"), t * 1009, rng.choice([rng.random(), rng.gauss(0, 1e4), 0.0, -5.0, 1e-9])) for t in range(1500)]
    rows += [("one", 5, 3.0), ("same", 1, 2.0), ("same", 2, 2.0), ("nan", 1, NAN), ("nan", 2, 5.0), ("inf", 1, INF), ("inf", 2, -INF), ("inf", 9, 1.0)]
    rows += [("null", 1, None), ("null", 2, 1.0), ("null", 3, 9.0), ("void", 1, None), ("neg", -5, 1.0), ("neg", -1500, -3.0), (None, 1, 1.0)]
    return Series.raw(raw_rows(spark, rows))


@pytest.mark.parametrize("buckets", [1, 4, 33])
@pytest.mark.parametrize("limit", [None, 0])
def test_refined_equals_distribution(spark, buckets, limit):
    series, period = odd_series(spark), 250_000
    halves = [Series.raw(series.records.filter(F.pmod(F.hash("identifier", "timestamp"), F.lit(2)) == i)) for i in range(2)]
    cells = fc.merged_counts(fc.fine_counts(halves[0], period).unionByName(fc.fine_counts(halves[1], period)))
    options = {} if limit is None else {"limit_bytes": limit}
    for restriction in (TimeRestriction(), TimeRestriction(from_=1, to=999_999), TimeRestriction(after=250_000, to=749_999), TimeRestriction(from_=300_000, to=310_000), TimeRestriction(after=10**9)):
        found = fc.refined_distribution(series, cells, restriction, buckets, period_ms=period, **options)
        assert_histograms(found, distribution(series, restriction, buckets, limit_bytes=limit if limit is not None else 1 << 26))
    one = fc.refined_distribution(series, cells, buckets=buckets, identifiers="a", period_ms=period)
    assert_histograms(one, distribution(series, buckets=buckets, identifiers="a"))


def test_cells_rise_with_values(spark):
    values = sorted([*[random.Random(4).gauss(0, 10**e) for e in range(-9, 9) for _ in range(9)], -INF, INF, 0.0, -0.0, 1e300])
    cells = [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i").select(fc.cell_of(F.col("v"))).collect()]
    assert cells == sorted(cells)


def test_few_records_are_looked_at_again(spark):
    series = Series.raw(skewed(spark))
    cells = fc.fine_counts(series)
    total = series.records.count()
    cut = []
    original = fc.durable
    try:
        fc.durable = lambda rows: cut.append(original(rows)) or cut[-1]
        fc.refined_distribution(series, cells, buckets=4).collect()
    finally:
        fc.durable = original
    again = series.values().select("identifier", fc._period(F.col("time"), DAY_MS).alias("period"), fc.cell_of(F.col("value")).alias("cell"))
    assert 0 < again.join(cut[-1], ["identifier", "period", "cell"]).count() < 0.06 * total


def test_refined_needs_buckets(spark):
    with pytest.raises(InvalidQueryError, match="positive"):
        fc.refined_distribution(odd_series(spark), fc.fine_counts(odd_series(spark)), buckets=0)


# -- feeds -----------------------------------------------------------------------------------


def test_feed_keeps_spans_not_batches(spark, tmp_path):
    now = [1000]
    feed = RetainedFeed(f"{tmp_path}/feed", span_ms=100, keep_ms=300, grace_ms=200, clock=lambda: now[0])
    assert feed.latest(spark).collect() == [] and feed.remove_old(spark) == 0
    records = [("a", i, float(i)) for i in range(40)] + [("b", HOUR, 1.0)]
    for batch in range(20):
        rows = tumbling_windows(raw_rows(spark, records[: 2 + 2 * batch]), HOUR)
        feed(rows, batch)
        feed(rows, batch)  # the batch ran again
        now[0] += 20
    feed(rows.limit(0), 20)
    assert [p.name for p in sorted((tmp_path / "feed").iterdir())] == ["span=10", "span=11", "span=12", "span=13"]
    assert {(r["identifier"], r["count"]) for r in feed.latest(spark).collect()} == {("a", 40)}
    assert feed.latest(spark).columns == WINDOWED_POWER.names
    assert [r["batch_id"] for r in feed.updates(spark, 1299).orderBy("batch_id").collect()] == list(range(20))
    assert feed.updates(spark).count() == 10
    # What is too old is out of sight first, and removed later.
    assert feed.spans(spark, 1399) == [11, 12, 13] and feed.spans(spark, 1400) == [12, 13]
    before = feed.latest(spark, 1399)
    assert feed.remove_old(spark, 1599) == 0 and before.count() == 1
    assert feed.remove_old(spark, 1600) == 1
    assert [p.name for p in sorted((tmp_path / "feed").iterdir())] == ["span=11", "span=12", "span=13"]


# -- quarantine ------------------------------------------------------------------------------


@pytest.fixture
def quarantine(spark, tmp_path):
    schema = "identifier string, timestamp long, valueInW double, arrival long, reason string"
    first = [(None, 1, 1.0, 0, "r"), ("a", -2, 2.0, 1, "r"), ("a", -2, 2.0, 2, "r"), ("", None, 3.0, 3, "r")]
    for batch, rows in enumerate((first, [first[0], ("c", 5, None, 4, "r")])):  # one of them was written twice
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/rejected/batch_id={batch}")
    stored = spark.createDataFrame([], schema).drop("reason").schema
    return Quarantine(f"{tmp_path}/rejected", f"{tmp_path}/repaired", stored)


def positive(rows):
    return rows.withColumn("timestamp", F.abs("timestamp"))


def named(rows):
    return positive(rows).withColumn("identifier", F.coalesce("identifier", F.lit("n"))).fillna({"timestamp": 7})


def test_each_record_returns_once(spark, quarantine, tmp_path):
    assert quarantine.records(spark).count() == 5
    assert quarantine.replay(spark, positive) == 2  # the two deliveries of the same values
    assert quarantine.replay(spark, positive) == 0
    assert quarantine.waiting(spark).count() == 3
    assert Quarantine(quarantine.rejected, quarantine.repaired, quarantine.schema).replay(spark, named) == 2
    back = spark.read.parquet(quarantine.repaired)
    assert sorted((r.identifier, r.timestamp, r.arrival) for r in back.collect()) == [("", 7, 3), ("a", 2, 1), ("a", 2, 2), ("n", 1, 0)]
    assert [r.arrival for r in quarantine.waiting(spark).collect()] == [4]


def test_replay_after_a_crash_in_the_middle(spark, quarantine, tmp_path):
    """Some files of an append are there, others are not, and nothing says that it was finished."""
    whole = accepted(named(quarantine.waiting(spark)).drop("reason")).select(*quarantine.schema.names, "contentKey")
    whole.repartition(4, "contentKey").write.parquet(f"{tmp_path}/whole")
    (tmp_path / "repaired").mkdir()
    files = sorted((tmp_path / "whole").glob("*.parquet"))
    files[0].rename(tmp_path / "repaired" / files[0].name)
    there = spark.read.parquet(quarantine.repaired).count()
    assert quarantine.replay(spark, named) == 4 - there
    assert spark.read.parquet(quarantine.repaired).count() == 4


def test_empty_quarantine(spark, tmp_path):
    empty = Quarantine(f"{tmp_path}/none", f"{tmp_path}/repaired", RAW_POWER)
    assert empty.records(spark).collect() == [] and empty.waiting(spark).collect() == []
    assert empty.replay(spark, named) == 0


# -- messages, sizes, warnings ---------------------------------------------------------------


def test_a_decoded_record_without_identifier_is_no_garbage(spark):
    schema = "record struct<identifier: string, timestamp: bigint, valueInW: double>, messageKey string, messageTimestamp long, arrival struct<offset: long>, value binary"
    rows = [
        (("a", 1, 1.0), "k", 5, (0,), b"x"),
        ((None, 2, 2.0), "k", 6, (1,), b"y"),  # its payload has no identifier
        ((None, None, None), "k", 7, (2,), b"garbage"),
        (None, "k", 8, (3,), b"garbage"),
        (None, "k", 9, (4,), None),
    ]
    found = decoded(spark.createDataFrame(rows, schema))
    kept = {r.arrival.offset: r[CORRUPT] for r in found.collect()}
    assert kept == {0: None, 1: None, 2: "Z2FyYmFnZQ==", 3: "Z2FyYmFnZQ==", 4: None}
    good = accepted(found, time="messageTimestamp", identifier="messageKey")
    windows = tumbling_windows(good, HOUR, key="messageKey", time="messageTimestamp").collect()
    assert [(w.identifier, w["count"], w["mean"]) for w in windows] == [("k", 2, 1.5)]


def test_sizes_come_from_one_listing(spark, tmp_path):
    table = KeyedTable(f"{tmp_path}/t", RAW_POWER, "timestamp", period_ms=10)
    for batch in range(3):
        table.write_batch(raw_rows(spark, [("a", t, float(batch)) for t in range(batch, 40)]), batch, unique=True)
    sizes = table._sizes(spark)
    parts = table.segment_parts(spark)
    assert {p.path for p in parts} == set(sizes)
    assert all(sizes[p.path] == folders.size_bytes(spark, p.path) for p in parts)
    assert {r.valueInW for r in table.read(spark).filter("timestamp > 1").collect()} == {2.0}


def test_identifiers_without_trend_are_warned_about(spark, caplog):
    series = Series.raw(raw_rows(spark, [("a", 1, 1.0)]))
    seen = Observation()
    found = trend(series, identifiers=["a", "b", "c"], observation=seen)
    assert {r["identifier"]: r["trend"] for r in found.collect()} == {"a": 1.0, "b": -1.0, "c": -1.0}
    assert warn_of_missing(seen) == 2 and "2 identifiers" in caplog.text


def test_bounds_of_refined_reach_the_scan(spark, tmp_path):
    skewed(spark).write.parquet(f"{tmp_path}/r")
    series = Series.raw(spark.read.parquet(f"{tmp_path}/r"))
    edges = fc._edges(series, TimeRestriction(from_=DAY_MS + 5, to=3 * DAY_MS - 1), None, 2, 2, DAY_MS)
    assert "PushedFilters" in plan(edges) and "GreaterThanOrEqual(timestamp" in plan(edges)
