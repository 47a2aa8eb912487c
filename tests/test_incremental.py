"""What is kept between batches: window states, the record clock, summaries, one-pass windows, stream state, counters."""

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tests.helpers import plan, raw_rows, same, skewed
from wattline.errors import InvalidQueryError
from wattline.functions.ranks import quantile_borders, rank_among
from wattline.history import PowerHistory
from wattline.operators.record_clock import windows_by_record_clock, with_lateness, with_stream_time
from wattline.operators.window_states import StateStore, merged_states, window_states, windows_of
from wattline.operators.windows import tumbling_windows
from wattline.resolution import Resolution, default_resolutions
from wattline.restriction import DAY_MS, TimeRestriction
from wattline.schemas import RAW_POWER
from wattline.series import Series
from wattline.sources.readers import file_stream
from wattline.sources.summaries import Summaries
from wattline.sources.table import KeyedTable
from wattline.streaming.fanout import all_windows
from wattline.streaming.progress import ProgressListener
from wattline.streaming.state import all_open_windows, open_windows
from wattline.streaming.topology import HistoryTopology

HOUR = 3_600_000
HOURLY = Resolution("hours", "hours", "hourly", HOUR)
INF, NAN = math.inf, math.nan


def by_window(rows):
    return {(r["identifier"], r["startTimestamp"]): r for r in rows.collect()}


def assert_windows(found, expected, tolerance=1e-9):
    found, expected = by_window(found), by_window(expected)
    assert found.keys() == expected.keys()
    for key, row in expected.items():
        for column in row.asDict():
            a, b = found[key][column], row[column]
            assert a == b or (a is not None and b is not None and same(a, b, tolerance)) if column not in ("identifier",) else a == b, (key, column, a, b)


# -- states ----------------------------------------------------------------------------------


@pytest.mark.parametrize("offset", [0.0, 1e9, -1e12])
def test_merged_states_are_those_of_all_records(spark, offset):
    rng = random.Random(7)
    rows = [(rng.choice("abc"), rng.randrange(3 * HOUR), offset + rng.random() * 8) for _ in range(900)]
    rows += [("hot", i, offset + i % 7) for i in range(600)]
    parts = [raw_rows(spark, rows[i::6]) for i in range(6)]
    states = window_states(parts[0], HOUR)
    for part in parts[1:]:
        states = states.unionByName(window_states(part, HOUR))
    values = defaultdict(list)
    for identifier, time, value in rows:
        values[identifier, time // HOUR * HOUR].append(value)
    found = by_window(windows_of(merged_states(states), HOUR))
    assert found.keys() == values.keys()
    for key, own in values.items():
        mean = math.fsum(own) / len(own)
        variance = math.fsum((v - mean) ** 2 for v in own) / len(own)
        assert found[key]["count"] == len(own) and (found[key]["min"], found[key]["max"]) == (min(own), max(own))
        assert found[key]["mean"] == pytest.approx(mean, rel=1e-14)
        # The values themselves are rounded to 1e-16 of the offset; nothing more may be lost.
        assert found[key]["populationVariance"] == pytest.approx(variance, rel=1e-9 + 1e-15 * abs(offset))


def test_odd_values_merge_as_if_seen_together(spark):
    rows = [("n", 0, 1.0), ("n", 1, NAN), ("i", 0, INF), ("i", 1, 2.0), ("j", 0, INF), ("j", 1, -INF), ("z", 0, None), ("z", 1, 4.0), ("o", 0, None), ("o", 1, None), ("s", 5, 3.0)]
    rows += [(None, 0, 1.0), ("n", 2, 3.0)]
    states = window_states(raw_rows(spark, rows[::2]), HOUR).unionByName(window_states(raw_rows(spark, rows[1::2]), HOUR))
    assert_windows(windows_of(merged_states(states), HOUR), tumbling_windows(raw_rows(spark, rows), HOUR))


def test_state_store_counts_each_batch_once(spark, tmp_path):
    store = StateStore(f"{tmp_path}/states", HOUR)
    assert store.windows(spark).collect() == [] and store.fold(spark) is None
    rows = [(f"s{i % 5}", i * 97_000, float(i % 13)) for i in range(400)]
    for batch in range(4):
        store.add(raw_rows(spark, [("wrong", 0, 1.0)]), batch)
        store.add(raw_rows(spark, rows[batch::4]), batch)  # the repeated batch replaces its first attempt
        if batch == 1:
            assert store.fold(spark) == 1
            with pytest.raises(InvalidQueryError, match="folded"):
                store.add(raw_rows(spark, rows), 1)
            with pytest.raises(InvalidQueryError, match="folded"):
                store.states(spark, upto=0)
    every = tumbling_windows(raw_rows(spark, rows), HOUR)
    assert_windows(store.windows(spark), every)
    assert store.fold(spark) == 3
    assert sorted(p.name for p in (tmp_path / "states").iterdir()) == ["folded=000000000003"]
    assert_windows(store.windows(spark), every)
    assert store.fold(spark) == 3


def test_new_windows_come_from_states_alone(spark, tmp_path):
    raw = f"{tmp_path}/raw"
    skewed(spark).write.parquet(raw)
    store = StateStore(f"{tmp_path}/states", HOUR)
    store.add(spark.read.parquet(raw), 0)
    store.add(spark.read.parquet(raw), 1)
    text = plan(store.windows(spark))
    assert "/states/" in text and raw not in text
    assert text.count("Exchange hashpartitioning") == 1 and "SinglePartition" not in text


# -- record clock ----------------------------------------------------------------------------


def clock_by_hand(rows, lifetime, size, clock=None):
    largest, found = {}, []
    for row in sorted(rows, key=lambda r: (r["arrival"], r["timestamp"])):
        of = row[clock] if clock else 0
        largest[of] = max(largest.get(of, -(10**18)), row["timestamp"])
        start = row["timestamp"] // size * size
        found.append((row["arrival"], row["timestamp"], largest[of], start + lifetime <= largest[of]))
    return sorted(found)


@pytest.mark.parametrize("clock", [None, "part"])
@pytest.mark.parametrize("ranges", [1, 3, 64])
def test_clock_moves_with_every_record(spark, clock, ranges):
    rng = random.Random(ranges)
    rows = [(i // 2 if i % 5 else i, rng.randrange(i + 1) * 500_000, rng.choice(["p", "q", None])) for i in range(700)]
    frame = spark.createDataFrame([("hot" if i % 3 == 0 else f"s{i}", *r) for i, r in enumerate(rows)], "identifier string, arrival long, timestamp long, part string")
    judged = with_lateness(frame, HOURLY, clock=clock, ranges=ranges).collect()
    expected = clock_by_hand([r.asDict() for r in frame.collect()], DAY_MS, HOUR, clock)
    assert sorted((r.arrival, r.timestamp, r.streamTime, r.late) for r in judged) == expected
    assert 0 < sum(r.late for r in judged) < len(judged)


def test_records_that_move_no_clock(spark):
    schema = "identifier string, arrival long, timestamp long, valueInW double"
    frame = spark.createDataFrame([("a", 1, 10, 1.0), ("a", None, 99, 1.0), ("a", 3, None, 1.0), ("b", 2, 5, 2.0)], schema)
    found = {(r.arrival, r.timestamp): r.streamTime for r in with_stream_time(frame).collect()}
    assert found == {(1, 10): 10, (None, 99): None, (3, None): None, (2, 5): 10}
    assert with_stream_time(frame.limit(0)).collect() == []
    assert sorted(r["count"] for r in windows_by_record_clock(frame, HOURLY).collect()) == [1, 1]


def test_a_hot_sensor_is_split_by_arrival(spark):
    frame = skewed(spark).withColumn("arrival", F.col("timestamp") * 3)
    rows = with_stream_time(frame, ranges=8)
    assert "SinglePartition" not in plan(rows)
    borders = quantile_borders(frame, "arrival", 8)
    sizes = [r["count"] for r in frame.groupBy(rank_among(F.col("arrival"), borders)).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 1.1 * min(sizes)
    assert rows.filter("streamTime <> timestamp").isEmpty()


# -- summaries -------------------------------------------------------------------------------


def facts_by_hand(table, spark, restriction=TimeRestriction(), as_of=0):
    found = defaultdict(list)
    for r in table.read(spark, restriction, as_of_ms=as_of).collect():
        found[r["identifier"]].append(r["valueInW"])
    return {i: (len(v), NAN if any(map(math.isnan, v)) else min(v), NAN if any(map(math.isnan, v)) else max(v)) for i, v in found.items()}


def assert_facts(summaries, spark, restriction=TimeRestriction(), as_of=0):
    found = {r["identifier"]: tuple(r)[1:] for r in summaries.per_identifier(spark, restriction, as_of).collect()}
    expected = facts_by_hand(summaries.table, spark, restriction, as_of)
    assert found.keys() == expected.keys()
    for i, values in expected.items():
        assert found[i][0] == values[0] and all(map(same, found[i][1:], values[1:]))
    total = summaries.total_count(spark, restriction, as_of).first()["count"]
    assert total == sum(v[0] for v in expected.values())


def test_summaries_equal_the_rows(spark, tmp_path):
    table = KeyedTable(f"{tmp_path}/t", RAW_POWER, "timestamp", period_ms=100)
    summaries = Summaries(table, "valueInW")
    assert summaries.total_count(spark).first()["count"] == 0
    rng = random.Random(3)
    for batch in range(4):
        # Batches are far apart, but each also overwrites some keys of the one before.
        keys = {(rng.choice("abc"), batch * 300 + rng.randrange(-60, 300)) for _ in range(120)}
        rows = [(i, t, NAN if t % 97 == 0 else float(rng.randrange(1000))) for i, t in keys]
        table.write_batch(raw_rows(spark, rows), batch, unique=True)
        if batch != 2:
            assert summaries.refresh(spark) == (2 if batch == 3 else 1)
        for restriction in (TimeRestriction(), TimeRestriction(from_=150, to=899), TimeRestriction(after=299, to=420), TimeRestriction(from_=300, to=399)):
            assert_facts(summaries, spark, restriction)
    assert summaries.refresh(spark) == 0
    assert table.compact(spark, fold_share=0.0) > 0
    assert_facts(summaries, spark)
    assert summaries.refresh(spark) == 1
    assert not summaries.scope(spark).read
    assert_facts(summaries, spark)


def test_settled_periods_are_not_read(spark, tmp_path):
    table = KeyedTable(f"{tmp_path}/t", RAW_POWER, "timestamp", period_ms=100)
    table.write_batch(raw_rows(spark, [("a", t, float(t)) for t in range(0, 500, 7)]), 0, unique=True)
    table.write_batch(raw_rows(spark, [("a", 7, -1.0)]), 1, unique=True)
    summaries = Summaries(table, "valueInW")
    summaries.refresh(spark)
    scope = summaries.scope(spark)
    assert {p.period for p in scope.read} == {0} and {p.period for p in scope.summarised} == {1, 2, 3, 4}
    inside = TimeRestriction(from_=100, to=499)
    assert not summaries.scope(spark, inside).read
    text = plan(summaries.total_count(spark, inside, as_of_ms=0))
    assert "t-summaries" in text and "/t/segment" not in text
    cut = summaries.scope(spark, TimeRestriction(after=100, to=399))
    assert {p.period for p in cut.read} == {1} and {p.period for p in cut.summarised} == {2, 3}


def test_expired_records_do_not_count(spark, tmp_path):
    table = KeyedTable(f"{tmp_path}/t", RAW_POWER, "timestamp", period_ms=100)
    table.write_batch(raw_rows(spark, [("a", 1, 1.0), ("b", 2, 2.0)]), 0, unique=True, written_at_ms=10, ttl_ms=5)
    table.write_batch(raw_rows(spark, [("a", 101, 3.0)]), 1, unique=True, written_at_ms=20, ttl_ms=5)
    table.write_batch(raw_rows(spark, [("a", 102, 4.0), ("c", 203, 5.0)]), 2, unique=True)
    summaries = Summaries(table, "valueInW")
    summaries.refresh(spark)
    for as_of in (0, 14, 15, 24, 25):
        assert_facts(summaries, spark, as_of=as_of)
    table.compact(spark, fold_share=0.0)  # now one segment holds records with and without expiry
    summaries.refresh(spark)
    for as_of in (0, 14, 15, 24, 25):
        assert_facts(summaries, spark, as_of=as_of)


# -- one pass, state, counters ---------------------------------------------------------------


class Runs:
    """Files that arrive between runs of a topology over one input."""

    def __init__(self, spark, root, resolutions, name):
        self.spark, self.root, self.folder = spark, root, f"{root}/raw"
        (root / "raw").mkdir(exist_ok=True)
        self.history = PowerHistory(f"{root}/{name}", resolutions)
        self.topology = HistoryTopology(
            self.history, file_stream(spark, self.folder, RAW_POWER), None, f"{root}/{name}-checkpoints",
            trigger={"availableNow": True}, name=f"{root.name}-{name}",
        )

    def arrive(self, rows):
        raw_rows(self.spark, rows).write.mode("append").parquet(self.folder)


STEPS = [
    [("a", 0, 1.0), ("a", 61_000, 3.0), ("b", 5, 2.0)],
    [("a", DAY_MS - 1, 1.0), ("a", 1, 5.0)],
    [("b", DAY_MS + 59_999, 7.0)],
    [("a", 2, 100.0), ("a", 60_001, 100.0), ("c", HOUR, 4.0), (None, 3, 1.0)],
    [("c", 2 * DAY_MS, NAN)],
    [("b", DAY_MS - HOUR, 9.0), ("b", DAY_MS + HOUR, 9.0)],
]


def test_one_pass_equals_a_query_for_each_resolution(spark, tmp_path):
    one, each = (Runs(spark, tmp_path, default_resolutions(), name) for name in ("one", "each"))
    for step in STEPS:
        one.arrive(step)
        one.topology.start_all_windows().awaitTermination()
        for resolution in each.history.resolutions:
            each.topology.start_windows(resolution).awaitTermination()
    for resolution in one.history.resolutions:
        found, expected = (r.history.windowed(spark, resolution.api, as_of_ms=0).records for r in (one, each))
        assert_windows(found, expected)
        assert not found.isEmpty()
        published = [sorted(map(str, spark.read.parquet(r.history.feed_folder(resolution)).drop("batch_id").collect())) for r in (one, each)]
        assert published[0] == published[1]
        folder = f"{each.topology.checkpoints}/windowed-{resolution.table}"
        separate = open_windows(spark, folder, resolution)
        together = all_open_windows(spark, f"{one.topology.checkpoints}/windowed-all", one.history.resolutions)
        assert_windows(together.filter(F.col("resolution") == resolution.table).drop("resolution"), separate)
        latest = max(t for step in STEPS for _, t, _ in step)
        assert all(r.closesAt > latest for r in separate.collect()) and not separate.isEmpty()


def test_hour_closed_by_a_late_day(spark, tmp_path):
    """The first window of a day takes records until stream time is a day after its start, to the millisecond."""
    runs = Runs(spark, tmp_path, default_resolutions(), "late")
    counts = []
    for last, time in ((DAY_MS - 1, 1), (DAY_MS, 2)):
        runs.arrive([("x", last, 0.0)])
        runs.topology.start_all_windows().awaitTermination()
        runs.arrive([("a", time, 1.0)])
        runs.topology.start_all_windows().awaitTermination()
        counts.append({api: runs.history.windowed(spark, api, as_of_ms=0).records.filter("identifier = 'a'").count() for api in ("hourly", "minutely")})
    assert counts == [{"hourly": 1, "minutely": 1}] * 2
    assert {r["count"] for r in runs.history.windowed(spark, "hourly").records.filter("identifier = 'a'").collect()} == {1}


def test_each_input_is_read_once(spark, tmp_path):
    skewed(spark).write.parquet(f"{tmp_path}/raw")
    rows = spark.read.parquet(f"{tmp_path}/raw")
    found = all_windows(rows, default_resolutions())
    text = plan(found)
    assert text.count("FileScan") == 1 and text.count("Exchange") == 1 and "partial_avg" in text
    for resolution in default_resolutions():
        own = found.filter(F.col("resolution") == resolution.table).drop("resolution")
        assert_windows(own, tumbling_windows(rows, resolution.size_ms), 1e-6)
    with pytest.raises(ValueError, match="tables"):
        all_windows(rows, [HOURLY, HOURLY])


def test_state_after_an_earlier_batch(spark, tmp_path):
    runs = Runs(spark, tmp_path, [HOURLY], "state")
    for step in STEPS[:2]:
        runs.arrive(step)
        runs.topology.start_windows(HOURLY).awaitTermination()
    folder = f"{runs.topology.checkpoints}/windowed-hours"
    first = {r.identifier: (r["count"], r["mean"]) for r in open_windows(spark, folder, HOURLY, batch_id=0).collect()}
    assert first == {"a": (2, 2.0), "b": (1, 2.0)}


def test_lost_checkpoint_of_one_pass(spark, tmp_path):
    runs = Runs(spark, tmp_path, default_resolutions(), "lost")
    runs.arrive(STEPS[0])
    runs.topology.start_all_windows().awaitTermination()
    runs.topology.checkpoints += "-elsewhere"
    with pytest.raises(RuntimeError, match="checkpoint"):
        runs.topology.start_all_windows()


def test_counters_follow_each_trigger(spark, tmp_path):
    runs = Runs(spark, tmp_path, [], "live")
    told = []
    listener = ProgressListener(runs.topology.query_name("raw-store"), sink=told.append)
    other = ProgressListener("another query")
    for each in (listener, other):
        spark.streams.addListener(each)
    try:
        for rows in ([("a", 1, 1.0), ("a", 2, 1.0)], [("a", 2, 5.0), ("b", DAY_MS, 1.0), (None, 1, 1.0)], [("a", 1, 2.0)]):
            runs.arrive(rows)
            query = runs.topology.start_raw_store()
            query.awaitTermination()
            listener.wait(query)
    finally:
        for each in (listener, other):
            spark.streams.removeListener(each)
    found = sorted(tuple(r) for r in listener.rows(spark, runs.history.raw_table).collect())
    assert found == [(0, 2, 2, 2, 0), (1, 3, 5, 3, 2), (2, 1, 6, 3, 3)]
    assert [(t["batch"], t["received"], t["totalReceived"]) for t in told] == [(0, 2, 2), (1, 3, 5), (2, 1, 6)]
    summaries = Summaries(runs.history.raw_table, "valueInW")
    summaries.refresh(spark)
    assert listener.latest(spark, summaries) == (6, 3, 3)
    assert other.received(spark).collect() == []
    assert Series.raw(runs.history.raw_table.read(spark)).records.count() == 3


def test_old_triggers_stay_in_the_total(spark):
    listener = ProgressListener("q", kept=2)
    for batch, received in enumerate((5, 7, 1, 2)):
        listener.note(batch, "", received)
    listener.note(3, "", 4)  # the last trigger ran again
    assert [tuple(r) for r in listener.received(spark).orderBy("batch").collect()] == [(2, 1, 13), (3, 4, 17)]
