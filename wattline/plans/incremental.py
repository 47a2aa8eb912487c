"""Registered queries on what is kept between batches: window states, summaries, the record clock, stream state, counters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattline.history import PowerHistory
from wattline.operators import ends, ranges
from wattline.operators.fine_counts import CELLS, fine_counts, merged_counts, refined_distribution
from wattline.operators.last_write import last_write
from wattline.operators.record_clock import windows_by_record_clock, with_lateness
from wattline.operators.trend import trend
from wattline.operators.window_states import StateStore
from wattline.plans import tables
from wattline.plans.catalog import (
    BATCHES,
    DAY_MS,
    FIRST_HOUR,
    HOUR_MS,
    LAST,
    _resolution,
    _with_batches,
    comparable,
    registered,
    rounded,
    stored,
)
from wattline.resolution import Resolution, default_resolutions
from wattline.restriction import TimeRestriction, parse_number
from wattline.schemas import AGGREGATED_POWER, RAW_POWER
from wattline.series import Series
from wattline.session import new_work_dir
from wattline.sources import folders
from wattline.sources.clustered import ClusteredStore
from wattline.sources.quarantine import Quarantine
from wattline.sources.readers import file_stream
from wattline.sources.summaries import Summaries
from wattline.sources.table import KeyedTable
from wattline.streaming.feeds import RetainedFeed
from wattline.streaming.progress import ProgressListener
from wattline.streaming.state import open_windows as windows_in_state
from wattline.streaming.topology import HistoryTopology


def _groups(spark, rows: DataFrame) -> dict[int, DataFrame]:
    """The rows of each ``batch``, staged by one pass; each group may have many files."""
    staged = new_work_dir(spark, "groups")
    rows.write.partitionBy("batch").parquet(staged)
    schema = rows.drop("batch").schema
    paths = {int(p.rsplit("=", 1)[1]): p for p in folders.matching(spark, f"{staged}/batch=*")}
    return {number: spark.read.schema(schema).parquet(paths[number]) for number in sorted(paths)}


# -- AGG2: states that batches are merged into -----------------------------------------------


def _state_store(spark, sf_dir, resolution_ms: int) -> StateStore:
    store = StateStore(new_work_dir(spark, "states"), resolution_ms)
    for number, rows in _groups(spark, _with_batches(spark, sf_dir)).items():
        store.add(rows, number)
        if number == BATCHES // 2:
            store.fold(spark)
    return store


@registered
def windows_merged(spark, sf_dir):
    """Windows of all events from the states of six batches, some of which have been folded."""
    return comparable(_state_store(spark, sf_dir, HOUR_MS).windows(spark))


@registered
def windows_merged_daily_lineitem(spark, sf_dir):
    """Daily windows of line items, whose six batches all touch the same windows."""
    rows = tables.lineitem_raw(spark, sf_dir, arrival=True)
    rows = rows.withColumn("batch", F.pmod(F.col(tables.LINEITEM_ARRIVAL), F.lit(BATCHES)).cast("int"))
    store = StateStore(new_work_dir(spark, "states"), DAY_MS)
    for number, group in _groups(spark, rows).items():
        store.add(group, number)
    return comparable(store.windows(spark))


# -- STR4: lateness by the record ------------------------------------------------------------

# Every 11th event arrives this many places after its turn (in event_id), so that some of them are late.
DELAY_EVERY, DELAY_SHARE = 11, 4


def _disordered(spark, sf_dir) -> DataFrame:
    """Events with an order of arrival of their own: some come a quarter of all events too late."""
    tables.use_utc(spark)
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    last = events.agg(F.max("event_id")).first()[0] or 0
    delay = F.when(F.col("arrival") % DELAY_EVERY == 0, F.lit(last // DELAY_SHARE)).otherwise(F.lit(0))
    return tables.raw_from_events(events, "event_type").select(
        "identifier", "timestamp", "valueInW", (F.col("arrival") * 2 + delay * 2 + F.col("arrival") % 2).alias("arrival")
    )


@registered
def late_by_record_clock(spark, sf_dir):
    """Stream time at each event and whether its hour had closed by then."""
    judged = with_lateness(_disordered(spark, sf_dir), _resolution("hourly"), ["arrival", "timestamp"])
    return judged.select("identifier", "timestamp", "arrival", "streamTime", "late")


@registered
def windowed_by_record_clock(spark, sf_dir):
    return comparable(windows_by_record_clock(_disordered(spark, sf_dir), _resolution("hourly"), ["arrival", "timestamp"]))


# -- AGG3, AGG4, AGG6, Q8: counts and ranges from summaries ----------------------------------


def _summarised_events(spark, sf_dir) -> Summaries:
    """Events in six batches by arrival, and a seventh that overwrites the first one's values with their negatives."""
    table = KeyedTable(new_work_dir(spark, "events"), RAW_POWER, "timestamp")
    groups = _groups(spark, _with_batches(spark, sf_dir))
    summaries = Summaries(table, "valueInW")
    for number, rows in groups.items():
        table.write_batch(rows, number, unique=True)
        summaries.refresh(spark)
    table.write_batch(groups[0].withColumn("valueInW", -F.col("valueInW")), BATCHES, unique=True)
    summaries.refresh(spark)
    return summaries


@registered
def total_count_from_summaries(spark, sf_dir):
    return _summarised_events(spark, sf_dir).total_count(spark)


@registered
def value_range_from_summaries(spark, sf_dir):
    found = _summarised_events(spark, sf_dir).per_identifier(spark)
    return found.select("identifier", F.col("low").alias("min"), F.col("high").alias("max"))


@registered
def count_in_range_from_summaries(spark, sf_dir):
    """Both bounds lie inside days, which are read; the days between are not."""
    restriction = TimeRestriction(from_=FIRST_HOUR + 1, to=LAST)
    found = _summarised_events(spark, sf_dir).per_identifier(spark, restriction)
    return found.select("identifier", F.col("records").alias("count"))


# -- STR2, STR6, Q10, SNK5: one pass, state as data, live counters ---------------------------


def _topology(spark, work: str, resolutions: list[Resolution], grouped: bool) -> HistoryTopology:
    schema = "identifier string, timestamp bigint, valueInW double, arrival bigint"
    folders.create(spark, f"{work}/raw")
    return HistoryTopology(
        PowerHistory(f"{work}/tables", resolutions),
        file_stream(spark, f"{work}/raw", spark.createDataFrame([], schema).schema),
        file_stream(spark, f"{work}/groups", AGGREGATED_POWER) if grouped else None,
        f"{work}/checkpoints",
        trigger={"availableNow": True},
        name=work.rsplit("/", 1)[-1],
    )


def _arrive(rows: DataFrame, work: str) -> None:
    rows.select("identifier", "timestamp", "valueInW", "arrival").write.mode("append").parquet(f"{work}/raw")


@registered
def stream_all_resolutions(spark, sf_dir):
    """Both inputs once through one query: windows of every resolution."""
    work = new_work_dir(spark, "one-pass")
    tables.events_grouped(spark, sf_dir).write.parquet(f"{work}/groups")
    _arrive(_with_batches(spark, sf_dir).withColumn("identifier", F.col("event_type")), work)
    topology = _topology(spark, work, default_resolutions(), grouped=True)
    topology.start_all_windows().awaitTermination()
    found = [
        topology.history.windowed(spark, r.api, as_of_ms=0).records.withColumn("resolution", F.lit(r.api))
        for r in topology.history.resolutions
    ]
    return comparable(found[0].unionByName(found[1]))


@registered
def open_windows(spark, sf_dir):
    """What the hourly query still keeps after three runs of two groups each."""
    work = new_work_dir(spark, "open")
    resolution = _resolution("hourly")
    topology = _topology(spark, work, [resolution], grouped=False)
    groups = list(_groups(spark, _with_batches(spark, sf_dir)).values())
    for i in range(0, len(groups), 2):
        for rows in groups[i : i + 2]:
            _arrive(rows, work)
        topology.start_windows(resolution).awaitTermination()
    return comparable(windows_in_state(spark, f"{topology.checkpoints}/windowed-{resolution.table}", resolution))


@registered
def progress_rows(spark, sf_dir):
    """Received, stored and the difference after each of seven micro-batches; the last brings the third again."""
    work = new_work_dir(spark, "progress")
    topology = _topology(spark, work, [], grouped=False)
    groups = _groups(spark, _with_batches(spark, sf_dir))
    listener = ProgressListener(topology.query_name("raw-store"))
    spark.streams.addListener(listener)
    try:
        for rows in [*groups.values(), *([groups[2]] if 2 in groups else [])]:
            _arrive(rows, work)
            query = topology.start_raw_store()
            query.awaitTermination()
            listener.wait(query)
    finally:
        spark.streams.removeListener(listener)
    return stored(spark, listener.rows(spark, topology.history.raw_table), "progress-rows")


# -- SRC3, FLT1: files that a lookup skips ---------------------------------------------------


def _clustered(spark, sf_dir, files: int = 16) -> ClusteredStore:
    store = ClusteredStore(new_work_dir(spark, "clustered"), RAW_POWER)
    store.write(tables.events_raw(spark, sf_dir), files=files, row_group_bytes=1 << 20)
    return store


@registered
def range_of_identifier_stored(spark, sf_dir):
    """Three users in a span of time, from files laid out for both filters; the filters are the operator here."""
    restriction = TimeRestriction(from_=FIRST_HOUR, to=LAST)
    store = _clustered(spark, sf_dir)
    series = store.series(spark, "valueInW", restriction, LOOKED_UP)
    return ranges.records(series, restriction, LOOKED_UP)


LOOKED_UP = ("1", "7", "12")


# -- Q6: distributions from fine counts ------------------------------------------------------


def _with_fine_counts(spark, sf_dir, identifier: str):
    """The events as a series, and their fine counts from six batches."""
    rows = _with_batches(spark, sf_dir)
    rows = rows.withColumn("identifier", F.col(identifier))
    counts = new_work_dir(spark, "fine-counts")
    for number, group in _groups(spark, rows).items():
        fine_counts(Series.raw(group)).write.parquet(f"{counts}/batch={number}")
    cells = merged_counts(spark.read.schema(CELLS).parquet(*folders.matching(spark, f"{counts}/batch=*")))
    return Series.raw(rows), cells


@registered
def distribution_refined(spark, sf_dir):
    series, cells = _with_fine_counts(spark, sf_dir, "identifier")
    return refined_distribution(series, cells)


@registered
def distribution_refined_dense(spark, sf_dir):
    series, cells = _with_fine_counts(spark, sf_dir, "event_type")
    return refined_distribution(series, cells, buckets=50)


@registered
def distribution_refined_in_range(spark, sf_dir):
    """Both bounds lie inside days: these are read, the days between come from the counts."""
    series, cells = _with_fine_counts(spark, sf_dir, "identifier")
    return refined_distribution(series, cells, TimeRestriction(from_=FIRST_HOUR, to=LAST), 7)


# -- SNK4: a feed that forgets ---------------------------------------------------------------


@registered
def feed_latest(spark, sf_dir):
    """The last published state of every window after six runs, published into three spans of time."""
    work = new_work_dir(spark, "feed")
    resolution = _resolution("hourly")
    hours = iter(range(1, 1000))
    feed = RetainedFeed(f"{work}/feed", span_ms=2, keep_ms=1000, clock=lambda: next(hours))
    topology = _topology(spark, work, [resolution], grouped=False)
    topology.feeds[resolution.feed] = feed
    for rows in _groups(spark, _with_batches(spark, sf_dir)).values():
        _arrive(rows, work)
        topology.start_windows(resolution).awaitTermination()
    return comparable(feed.latest(spark, as_of_ms=999))


# -- SRC4: repair and replay -----------------------------------------------------------------


@registered
def quarantine_replayed(spark, sf_dir):
    """Events that arrive damaged, are rejected, repaired in two steps and replayed; then the store has all of them."""
    work = new_work_dir(spark, "repair")
    schema = T.StructType([*RAW_POWER.fields, T.StructField("arrival", T.LongType())])
    topology = _topology(spark, work, [], grouped=False)
    # What returns is an input of its own beside the first.
    folders.create(spark, f"{work}/repaired")
    topology.raw = topology.raw.unionByName(file_stream(spark, f"{work}/repaired", schema))
    tables.use_utc(spark)
    events = tables.raw_from_events(spark.read.parquet(f"{sf_dir}/events.parquet"))
    damaged = events.select(
        F.when(F.col("arrival") % 5 != 0, F.col("identifier")).alias("identifier"),
        F.when(F.col("arrival") % 7 != 0, F.col("timestamp")).otherwise(-F.col("timestamp")).alias("timestamp"),
        "valueInW",
        "arrival",
    )
    _arrive(damaged, work)
    topology.start_raw_store().awaitTermination()
    quarantine = Quarantine(topology.history.rejected_folder("raw"), f"{work}/repaired", schema)
    names = events.select("arrival", F.col("identifier").alias("name"))

    def times(rows: DataFrame) -> DataFrame:
        return rows.withColumn("timestamp", F.abs("timestamp"))

    def times_and_names(rows: DataFrame) -> DataFrame:
        return times(rows).join(names, "arrival", "left").withColumn("identifier", F.coalesce("identifier", "name"))

    for repair in (times, times_and_names, times_and_names):  # the third finds nothing to do
        quarantine.replay(spark, repair)
    topology.start_raw_store().awaitTermination()
    return topology.history.raw(spark).records


# -- FLT3 - FLT5, UDF1, STR7: text parameters, values by expression, event time of the message -


@registered
def latest_by_text_parameters(spark, sf_dir):
    """Bounds and count as they come from a caller; the count cannot be read and falls back to its default."""
    restriction = TimeRestriction.parse({"from": str(FIRST_HOUR), "to": f"+{LAST}"})
    series = Series.raw(tables.events_raw(spark, sf_dir, restriction))
    return ends.latest(series, restriction, count=parse_number("two", default=2))


@registered
def trend_of_expression(spark, sf_dir):
    """The value is an expression over several columns of the records."""
    lines = tables.lineitem_raw(spark, sf_dir, arrival=True)
    kept = last_write(lines, ["identifier", "timestamp"], [tables.LINEITEM_ARRIVAL])
    line = F.pmod(F.call_function("div", F.col(tables.LINEITEM_ARRIVAL), F.lit(100_000_000)), F.lit(8))
    value = F.col("valueInW") * (line + 1)
    return rounded(trend(Series(kept, "timestamp", value), points_to_smooth=1), "trend")


@registered
def stream_by_message_time(spark, sf_dir):
    """Windows follow the key and the time of the message, the raw table those of the payload."""
    work = new_work_dir(spark, "messages")
    tables.use_utc(spark)
    events = tables.raw_from_events(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_type")
    messages = events.select(
        F.col("identifier").alias("messageKey"),
        (F.col("timestamp") + F.lit(MESSAGE_DELAY_MS)).alias("messageTimestamp"),
        F.when(F.col("arrival") % 3 != 0, F.lit("payload")).alias("identifier"),
        "timestamp",
        "valueInW",
        "arrival",
    )
    messages.write.parquet(f"{work}/raw")
    resolution = _resolution("hourly")
    topology = HistoryTopology(
        PowerHistory(f"{work}/tables", [resolution]), file_stream(spark, f"{work}/raw", messages.schema), None,
        f"{work}/checkpoints", trigger={"availableNow": True}, name=work.rsplit("/", 1)[-1],
        key="messageKey", event_time="messageTimestamp",
    )
    topology.start_windows(resolution).awaitTermination()
    return comparable(topology.history.windowed(spark, "hourly").records)


MESSAGE_DELAY_MS = 1_234_567
