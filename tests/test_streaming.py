import pytest
from pyspark.sql import functions as F

from tests.helpers import aggregated_rows, raw_rows, same
from wattline.history import PowerHistory
from wattline.operators import ranges, reconcile
from wattline.operators.windows import combined_power, tumbling_windows
from wattline.resolution import Resolution, default_resolutions
from wattline.restriction import DAY_MS
from wattline.schemas import AGGREGATED_POWER, RAW_POWER
from wattline.sources.readers import file_stream
from wattline.streaming.topology import HistoryTopology

HOUR = 3_600_000
HOURLY = Resolution("hours", "hours", "hourly", HOUR)


class Feeder:
    """Two input folders and a topology that drains whatever has arrived."""

    def __init__(self, spark, root, resolutions):
        self.spark, self.root = spark, root
        self.history = PowerHistory(f"{root}/tables", resolutions)
        self.options = {}
        # A folder must exist before a stream can watch it.
        for name in ("raw", "aggregated"):
            (root / name).mkdir()

    def arrive(self, raw=(), aggregated=()):
        raw_rows(self.spark, list(raw)).coalesce(1).write.mode("append").parquet(f"{self.root}/raw")
        rows = aggregated_rows(self.spark, list(aggregated))
        rows.coalesce(1).write.mode("append").parquet(f"{self.root}/aggregated")

    def topology(self):
        return HistoryTopology(
            self.history,
            file_stream(self.spark, f"{self.root}/raw", RAW_POWER),
            file_stream(self.spark, f"{self.root}/aggregated", AGGREGATED_POWER),
            f"{self.root}/checkpoints",
            trigger={"availableNow": True},
            name=self.root.name,
            **self.options,
        )

    def drain(self):
        queries = self.topology().start()
        for query in queries:
            query.awaitTermination()
        return queries

    def windows(self, api="hourly"):
        return {(r.identifier, r.startTimestamp): r for r in self.history.windowed(self.spark, api).records.collect()}

    def feed(self, resolution=HOURLY):
        return self.spark.read.parquet(self.history.feed_folder(resolution))


@pytest.fixture
def feeder(spark, tmp_path):
    return Feeder(spark, tmp_path, [HOURLY])


def test_updates_late_data_and_restart(spark, feeder):
    """Each step is a new run from the checkpoint."""
    twice = [("a", 0, 1.0), ("a", 60_000, 3.0)]
    feeder.arrive([*twice, *twice], [("g", 0, 2, 10.0, 5.0), ("a", 1000, 1, 7.0, 7.0)])
    feeder.drain()
    windows = feeder.windows()
    assert windows.keys() == {("a", 0), ("g", 0)}
    assert windows["a", 0]["count"] == 5 and windows["a", 0]["mean"] == 3.0
    assert same(windows["a", 0]["populationVariance"], 4.8, 1e-12)
    assert windows["g", 0]["mean"] == 10.0
    # The table holds one row per key although the window counted the copies.
    raw = feeder.history.raw(spark)
    assert sorted(tuple(r) for r in raw.records.collect()) == twice
    assert ranges.total_count(feeder.history.aggregated(spark)).first()["count"] == 2

    feeder.arrive([("b", DAY_MS, 1.0)])
    feeder.drain()
    assert feeder.windows().keys() == {("a", 0), ("g", 0), ("b", DAY_MS)}

    # 24 hours after its start the first window is closed; the second is not.
    feeder.arrive([("a", 5000, 100.0), ("a", HOUR + 1, 1.0)])
    feeder.drain()
    windows = feeder.windows()
    assert windows["a", 0]["count"] == 5
    assert windows["a", HOUR]["count"] == 1
    # The late record is missing from the window only.
    assert feeder.history.raw(spark).records.filter("timestamp = 5000").count() == 1

    # Each changed window was published once per run, with its state at that time.
    published = sorted((r.identifier, r.startTimestamp, r["count"]) for r in feeder.feed().collect())
    assert published == [("a", 0, 5), ("a", HOUR, 1), ("b", DAY_MS, 1), ("g", 0, 1)]


def test_state_survives_a_restart(feeder):
    feeder.arrive([("a", 0, 1.0)])
    feeder.drain()
    feeder.arrive([("a", 1, 2.0), ("a", 2, 6.0)])
    feeder.drain()
    assert tuple(feeder.windows()["a", 0])[3:5] == (3, 3.0)
    assert sorted(r["count"] for r in feeder.feed().collect()) == [1, 3]


def test_a_run_without_new_data_changes_nothing(feeder):
    feeder.arrive([("a", 0, 1.0)])
    feeder.drain()
    before = feeder.windows()
    feeder.drain()
    assert feeder.windows() == before


def test_stream_equals_batch(spark, feeder):
    raw = [(f"s{i % 7}", i * 37_000 + i % 11, float(i * 31 % 101)) for i in range(2000)]
    groups = [(f"s{i % 3}", i * HOUR, 2, float(i), i / 2) for i in range(20)]
    for part in range(0, 2000, 500):
        feeder.arrive(raw[part : part + 500], groups[part // 100 : part // 100 + 5])
        feeder.drain()
    batch = tumbling_windows(combined_power(raw_rows(spark, raw), aggregated_rows(spark, groups)), HOUR)
    expected = {(r.identifier, r.startTimestamp): r for r in batch.collect()}
    found = feeder.windows()
    assert found.keys() == expected.keys()
    for key, row in expected.items():
        for column in ("endTimestamp", "count", "min", "max"):
            assert found[key][column] == row[column]
        for column in ("mean", "populationVariance"):
            assert same(found[key][column], row[column], 1e-9)


def test_unusable_records_and_reconciliation(spark, feeder):
    good = [("a", 1, 1.0), ("a", 1, 2.0), ("b", 5, 1.0)]
    feeder.arrive([*good, (None, 1, 1.0), ("c", -1, 1.0), ("d", 1, None), ("e", 2**63 - 1, 1.0)])
    feeder.drain()
    rejected = spark.read.parquet(feeder.history.rejected_folder("raw"))
    assert sorted(r.reason for r in rejected.collect()) == [
        "missing identifier",
        "missing valueInW",
        "negative timestamp",
        "timestamp out of range",
    ]
    assert feeder.windows().keys() == {("a", 0), ("b", 0)}
    compared = reconcile.reconcile_counts(
        feeder.history.received(spark),
        ranges.count(feeder.history.raw(spark)).withColumnRenamed("count", "stored"),
    )
    found = {r.identifier: tuple(r)[1:] for r in compared.collect()}
    assert found["a"] == (2, 1, 1) and found["b"] == (1, 1, 0) and found["d"] == (1, 0, 1)


def test_written_records_are_observed(spark, feeder):
    feeder.arrive([("a", 3, 1.0), ("a", 9, 2.0)])
    topology = feeder.topology()
    query = topology.start_raw_store()
    query.awaitTermination()
    seen = [p["observedMetrics"]["rawWritten"] for p in query.recentProgress if p["numInputRows"]]
    assert [s.asDict() for s in seen] == [{"records": 2, "firstTimestamp": 3, "lastTimestamp": 9}]


def test_a_batch_of_windows_is_one_file(feeder, tmp_path):
    feeder.arrive([(f"s{i}", 0, 1.0) for i in range(100)])
    feeder.drain()
    assert len(list((tmp_path / "tables/windowed/hours").rglob("*.parquet"))) == 1


def test_maintenance_between_runs(spark, tmp_path):
    feeder = Feeder(spark, tmp_path, default_resolutions())
    feeder.options["clock"] = lambda: 1_000
    for value in (1.0, 3.0):
        feeder.arrive([("a", 0, value), ("b", int(value), value)], [("g", 0, 1, value, value)])
        feeder.drain()
    assert feeder.history.compact(spark) == 5
    assert feeder.history.compact(spark) == 0
    feeder.arrive([("a", 1, 5.0)])
    feeder.drain()
    assert tuple(feeder.windows()["a", 0])[3:5] == (3, 3.0)
    assert ranges.total_count(feeder.history.raw(spark)).first()["count"] == 4
    assert feeder.history.vacuum(spark, 10**14) == 1
    assert feeder.history.windowed(spark, "minutely", as_of_ms=0).records.count() == 0
    assert len(feeder.windows()) == 3


def test_windows_expire_but_hours_stay(spark, tmp_path):
    feeder = Feeder(spark, tmp_path, default_resolutions())
    feeder.options["clock"] = lambda: 1_000
    feeder.arrive([("a", 0, 1.0)])
    feeder.drain()
    ttl = feeder.history.resolutions[0].ttl_ms
    for as_of, left in ((ttl + 999, 1), (ttl + 1_000, 0)):
        assert feeder.history.windowed(spark, "minutely", as_of_ms=as_of).records.count() == left
        assert feeder.history.windowed(spark, "hourly", as_of_ms=as_of).records.count() == 1


def test_other_keys_and_event_times(spark, tmp_path):
    """Windows may follow message key and time while the raw table keeps the payload's."""
    feeder = Feeder(spark, tmp_path, [HOURLY])
    rows = raw_rows(spark, [("a", 1, 1.0), ("b", 2, 3.0)])
    rows.withColumn("messageKey", F.lit("k")).withColumn("messageTime", F.lit(HOUR).cast("long")).write.mode(
        "append"
    ).parquet(f"{tmp_path}/raw")
    schema = "identifier string, timestamp long, valueInW double, messageKey string, messageTime long"
    topology = HistoryTopology(
        feeder.history,
        spark.readStream.schema(schema).parquet(f"{tmp_path}/raw"),
        None,
        f"{tmp_path}/checkpoints",
        trigger={"availableNow": True},
        key="messageKey",
        event_time="messageTime",
    )
    for query in topology.start():
        query.awaitTermination()
    assert {k: r["count"] for k, r in feeder.windows().items()} == {("k", HOUR): 2}
    assert sorted(tuple(r) for r in feeder.history.raw(spark).records.collect()) == [("a", 1, 1.0), ("b", 2, 3.0)]


def test_windows_check_the_columns_they_use(spark, tmp_path):
    """A payload without identifier counts under its message key; a null key is written aside."""
    feeder = Feeder(spark, tmp_path, [HOURLY])
    schema = "identifier string, timestamp long, valueInW double, messageKey string, messageTime long"
    rows = [(None, 1, 1.0, "k", 5), ("b", 2, 3.0, None, 5), ("c", 3, 4.0, "k", -5)]
    spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{tmp_path}/raw")
    topology = HistoryTopology(
        feeder.history, file_stream(spark, f"{tmp_path}/raw", spark.createDataFrame([], schema).schema), None,
        f"{tmp_path}/checkpoints", trigger={"availableNow": True}, key="messageKey", event_time="messageTime",
    )
    for query in topology.start():
        query.awaitTermination()
    assert {k: r["count"] for k, r in feeder.windows().items()} == {("k", 0): 1}
    assert sorted(r.identifier for r in feeder.history.raw(spark).records.collect()) == ["b", "c"]
    rejected = spark.read.parquet(feeder.history.rejected_folder("raw"))
    assert sorted(r.reason for r in rejected.collect()) == [
        "missing identifier", "not in windows: missing messageKey", "not in windows: negative messageTime"
    ]


def test_the_last_line_of_a_file_wins(spark, tmp_path):
    """Text streams: order inside files, later files after earlier ones, undecodable lines with their text."""
    feeder = Feeder(spark, tmp_path, [])
    (tmp_path / "lines").mkdir()
    (tmp_path / "lines/1.csv").write_text("a,1,9.0\na,1,5.0\nb,1,7.0\nb,x,1.0\n")
    topology = HistoryTopology(
        feeder.history, file_stream(spark, f"{tmp_path}/lines", RAW_POWER, file_format="csv"), None,
        f"{tmp_path}/checkpoints", trigger={"availableNow": True},
    )
    topology.start_raw_store().awaitTermination()
    assert sorted(tuple(r) for r in feeder.history.raw(spark).records.collect()) == [("a", 1, 5.0), ("b", 1, 7.0)]
    rejected = spark.read.parquet(feeder.history.rejected_folder("raw")).collect()
    assert [(r["_corrupt_record"], r.reason) for r in rejected] == [("b,x,1.0", "undecodable")]


def test_nothing_is_left_by_batches_without_rejects(feeder, tmp_path):
    feeder.arrive([("a", 0, 1.0), ("a", 0, 2.0)])
    feeder.drain()
    assert not (tmp_path / "tables/rejected").exists()
    # The reader's own order: the row further down in the file was written last.
    assert [r.valueInW for r in feeder.history.raw(feeder.spark).records.collect()] == [2.0]


def test_lost_checkpoint_does_not_overwrite_the_table(feeder, tmp_path):
    feeder.arrive([("a", 0, 1.0)])
    feeder.drain()
    lost = HistoryTopology(
        feeder.history, feeder.topology().raw, None, f"{tmp_path}/elsewhere", trigger={"availableNow": True}
    )
    with pytest.raises(RuntimeError, match="checkpoint"):
        lost.start_raw_store()


def test_unknown_resolution(spark, feeder):
    with pytest.raises(ValueError, match="daily"):
        feeder.history.windowed(spark, "daily")
