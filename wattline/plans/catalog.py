"""The registered queries: every operator over whole test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattline.history import PowerHistory
from wattline.operators import ends, quality, ranges, reconcile
from wattline.operators.distribution import distribution, value_ranges
from wattline.operators.last_write import last_write
from wattline.operators.trend import trend
from wattline.operators.windows import combined_power, power_from_aggregated, tumbling_windows
from wattline.plans import tables
from wattline.resolution import Resolution, default_resolutions
from wattline.restriction import TimeRestriction
from wattline.schemas import AGGREGATED_POWER, RAW_POWER
from wattline.series import Series
from wattline.session import new_work_dir
from wattline.sources import folders
from wattline.sources.readers import file_stream, text_records
from wattline.sources.table import TARGET_FILE_BYTES, KeyedTable
from wattline.streaming.topology import HistoryTopology

Query = Callable[[SparkSession, str], DataFrame]

MINUTE_MS = 60_000
HOUR_MS = tables.HOUR_MS
DAY_MS = tables.DAY_MS

# Bounds inside the month the events cover. FIRST_HOUR is a full hour, so that inclusive and
# exclusive bounds differ on windowed series.
FIRST_HOUR = 1_704_499_200_000
LATER = 1_705_000_123_456
LAST = 1_705_708_800_000
# Windows are taken as written when they end, and live for ten days.
TTL_MS = 10 * DAY_MS
AS_OF = 1_705_708_800_000

QUERIES: dict[str, Query] = {}


def registered(query: Query) -> Query:
    QUERIES[query.__name__] = query
    return query


def rounded(rows: DataFrame, *columns: str) -> DataFrame:
    """Means, variances and ratios in single precision: their last bits depend on the order of
    additions. (Rounding to decimals would not do: means of decimals often are exact ties.)
    """
    return rows.withColumns({c: tables.single_precision(F.col(c)) for c in columns})


def comparable(windows: DataFrame) -> DataFrame:
    return rounded(windows, "mean", "populationVariance")


def exact_hourly(spark: SparkSession, sf_dir: str, identifier: str = "user_id") -> DataFrame:
    return tumbling_windows(tables.events_raw(spark, sf_dir, identifier=identifier), HOUR_MS)


def hourly(spark: SparkSession, sf_dir: str, identifier: str = "user_id") -> DataFrame:
    return comparable(exact_hourly(spark, sf_dir, identifier))


def stored(spark: SparkSession, rows: DataFrame, purpose: str) -> DataFrame:
    """Computed once, for queries that look at it several times."""
    path = new_work_dir(spark, purpose)
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def raw_series(spark: SparkSession, sf_dir: str, restriction=TimeRestriction()) -> Series:
    return Series.raw(tables.events_raw(spark, sf_dir, restriction))


def dense_series(spark: SparkSession, sf_dir: str, restriction=TimeRestriction()) -> Series:
    return Series.raw(tables.events_raw(spark, sf_dir, restriction, identifier="event_type"))


def grouped_series(spark: SparkSession, sf_dir: str) -> Series:
    return Series.aggregated(tables.events_grouped(spark, sf_dir))


def windowed_series(spark: SparkSession, sf_dir: str) -> Series:
    """Windows with all their digits; results are cut to comparable precision at the end."""
    return Series.windowed(exact_hourly(spark, sf_dir))


def stored_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.lineitem_raw(spark, sf_dir, arrival=True)
    return last_write(rows, ["identifier", "timestamp"], [tables.LINEITEM_ARRIVAL]).select(*RAW_POWER.names)


# -- AGG1, AGG2, PRJ2, STR1: tumbling windows ------------------------------------------------


@registered
def windowed_minutely(spark, sf_dir):
    return comparable(tumbling_windows(tables.events_raw(spark, sf_dir), MINUTE_MS))


@registered
def windowed_hourly(spark, sf_dir):
    return hourly(spark, sf_dir)


@registered
def windowed_hourly_dense(spark, sf_dir):
    return hourly(spark, sf_dir, identifier="event_type")


@registered
def windowed_daily_lineitem(spark, sf_dir):
    return comparable(tumbling_windows(tables.lineitem_raw(spark, sf_dir), DAY_MS))


# -- PRJ1, SET1: group records as power, union of both inputs --------------------------------


@registered
def aggregated_as_power(spark, sf_dir):
    return power_from_aggregated(tables.events_grouped(spark, sf_dir))


@registered
def combined(spark, sf_dir):
    dense = tables.events_raw(spark, sf_dir, identifier="event_type")
    return combined_power(dense, tables.events_grouped(spark, sf_dir))


@registered
def windowed_combined_hourly(spark, sf_dir):
    return comparable(tumbling_windows(combined(spark, sf_dir), HOUR_MS))


@registered
def windowed_combined_minutely(spark, sf_dir):
    return comparable(tumbling_windows(combined(spark, sf_dir), MINUTE_MS))


# -- Q1, AGG5: identifiers -------------------------------------------------------------------


@registered
def identifiers(spark, sf_dir):
    return ranges.identifiers(raw_series(spark, sf_dir))


@registered
def identifiers_aggregated(spark, sf_dir):
    return ranges.identifiers(grouped_series(spark, sf_dir))


@registered
def identifiers_windowed(spark, sf_dir):
    return ranges.identifiers(windowed_series(spark, sf_dir))


# -- Q2, SRC3, SRC5, FLT1, FLT2: ranges ------------------------------------------------------


def _range(spark, sf_dir, restriction):
    return ranges.records(raw_series(spark, sf_dir, restriction), restriction)


@registered
def range_all(spark, sf_dir):
    return ranges.records(raw_series(spark, sf_dir), ordered=True)


@registered
def range_from(spark, sf_dir):
    return _range(spark, sf_dir, TimeRestriction(from_=LATER))


@registered
def range_to(spark, sf_dir):
    return _range(spark, sf_dir, TimeRestriction(to=LATER))


@registered
def range_after(spark, sf_dir):
    return _range(spark, sf_dir, TimeRestriction(after=LATER))


@registered
def range_from_to(spark, sf_dir):
    return _range(spark, sf_dir, TimeRestriction(from_=FIRST_HOUR, to=LAST))


@registered
def range_from_after(spark, sf_dir):
    return _range(spark, sf_dir, TimeRestriction(from_=FIRST_HOUR, after=LATER))


@registered
def range_aggregated(spark, sf_dir):
    restriction = TimeRestriction(after=FIRST_HOUR, to=LAST)
    return ranges.records(grouped_series(spark, sf_dir), restriction)


@registered
def range_windowed(spark, sf_dir):
    restriction = TimeRestriction(from_=FIRST_HOUR, to=LAST)
    return comparable(ranges.records(windowed_series(spark, sf_dir), restriction))


@registered
def range_of_identifier(spark, sf_dir):
    """The identifier filter is the operator here; it reaches the scan as an equality."""
    return ranges.records(dense_series(spark, sf_dir), identifiers="click", ordered=True)


# -- Q3, Q4: ends ----------------------------------------------------------------------------


@registered
def latest_one(spark, sf_dir):
    return ends.latest(raw_series(spark, sf_dir))


@registered
def latest_n(spark, sf_dir):
    return ends.latest(raw_series(spark, sf_dir), count=5)


@registered
def latest_in_range(spark, sf_dir):
    restriction = TimeRestriction(from_=FIRST_HOUR, to=LAST)
    return ends.latest(raw_series(spark, sf_dir, restriction), restriction, count=3)


@registered
def latest_many(spark, sf_dir):
    return ends.latest(dense_series(spark, sf_dir), count=1500)


@registered
def latest_aggregated(spark, sf_dir):
    return ends.latest(grouped_series(spark, sf_dir), count=5)


@registered
def latest_windowed(spark, sf_dir):
    return comparable(ends.latest(windowed_series(spark, sf_dir), count=5))


@registered
def latest_stored_lineitem(spark, sf_dir):
    return ends.latest(Series.raw(stored_lineitem(spark, sf_dir)), count=10)


@registered
def earliest_one(spark, sf_dir):
    return ends.earliest(raw_series(spark, sf_dir))


@registered
def earliest_n(spark, sf_dir):
    return ends.earliest(raw_series(spark, sf_dir), count=5)


@registered
def earliest_many(spark, sf_dir):
    return ends.earliest(dense_series(spark, sf_dir), count=250)


# -- Q5, AGG7: trend -------------------------------------------------------------------------


@registered
def trend_raw(spark, sf_dir):
    return rounded(trend(raw_series(spark, sf_dir)), "trend")


@registered
def trend_one_point(spark, sf_dir):
    return rounded(trend(raw_series(spark, sf_dir), points_to_smooth=1), "trend")


@registered
def trend_in_range(spark, sf_dir):
    restriction = TimeRestriction(after=FIRST_HOUR, to=LAST)
    return rounded(trend(raw_series(spark, sf_dir, restriction), restriction, 3), "trend")


@registered
def trend_many_points(spark, sf_dir):
    return rounded(trend(dense_series(spark, sf_dir), points_to_smooth=150), "trend")


@registered
def trend_aggregated(spark, sf_dir):
    return rounded(trend(grouped_series(spark, sf_dir)), "trend")


@registered
def trend_windowed(spark, sf_dir):
    return rounded(trend(windowed_series(spark, sf_dir)), "trend")


@registered
def trend_stored_lineitem(spark, sf_dir):
    return rounded(trend(Series.raw(stored_lineitem(spark, sf_dir))), "trend")


# -- Q6, AGG6: distribution ------------------------------------------------------------------


@registered
def value_range(spark, sf_dir):
    """Smallest and largest value, as the distribution determines them."""
    found = value_ranges(raw_series(spark, sf_dir).values())
    return found.select("identifier", F.col("low").alias("min"), F.col("high").alias("max"))


@registered
def distribution_raw(spark, sf_dir):
    return distribution(raw_series(spark, sf_dir))


@registered
def distribution_in_range(spark, sf_dir):
    restriction = TimeRestriction(from_=FIRST_HOUR, to=LAST)
    return distribution(raw_series(spark, sf_dir, restriction), restriction, 7)


@registered
def distribution_dense(spark, sf_dir):
    return distribution(dense_series(spark, sf_dir), buckets=50)


@registered
def distribution_shuffled(spark, sf_dir):
    """The way taken when the value ranges are too many to broadcast."""
    return distribution(raw_series(spark, sf_dir), buckets=10, limit_bytes=0)


@registered
def distribution_aggregated(spark, sf_dir):
    return distribution(grouped_series(spark, sf_dir))


@registered
def distribution_windowed(spark, sf_dir):
    """Here precision is cut before: in which bucket a mean falls is a yes or no of its last digit."""
    return distribution(Series.windowed(hourly(spark, sf_dir)), keep_values=True)


@registered
def distribution_stored_lineitem(spark, sf_dir):
    return distribution(Series.raw(stored_lineitem(spark, sf_dir)), buckets=10, keep_values=True)


# -- Q7, Q8, AGG3, AGG4: counts --------------------------------------------------------------


@registered
def count_in_range(spark, sf_dir):
    restriction = TimeRestriction(from_=FIRST_HOUR, to=LAST)
    return ranges.count(raw_series(spark, sf_dir, restriction), restriction)


@registered
def count_in_range_aggregated(spark, sf_dir):
    return ranges.count(grouped_series(spark, sf_dir), TimeRestriction(after=FIRST_HOUR, to=LAST))


@registered
def count_in_range_windowed(spark, sf_dir):
    return ranges.count(windowed_series(spark, sf_dir), TimeRestriction(from_=FIRST_HOUR))


@registered
def total_count(spark, sf_dir):
    return ranges.total_count(raw_series(spark, sf_dir))


@registered
def total_count_aggregated(spark, sf_dir):
    return ranges.total_count(grouped_series(spark, sf_dir))


@registered
def total_count_windowed(spark, sf_dir):
    return ranges.total_count(windowed_series(spark, sf_dir))


@registered
def total_count_stored_lineitem(spark, sf_dir):
    return ranges.total_count(Series.raw(stored_lineitem(spark, sf_dir)))


# -- SNK1, SNK2, SNK3: stores ----------------------------------------------------------------


@registered
def upsert_latest(spark, sf_dir):
    return stored_lineitem(spark, sf_dir)


def _lineitem_in_batches(spark, sf_dir) -> KeyedTable:
    """Line items written in four batches in order of arrival, later batches overwriting earlier ones.

    One pass deals the rows out to batches; each batch then reads its own folder.
    """
    table = KeyedTable(new_work_dir(spark, "lineitem"), RAW_POWER, "timestamp", period_ms=365 * DAY_MS)
    rows = tables.lineitem_raw(spark, sf_dir, arrival=True)
    largest = rows.agg(F.max(tables.LINEITEM_ARRIVAL)).first()[0] or 0
    staged = new_work_dir(spark, "lineitem-batches")
    batch = F.call_function("div", F.col(tables.LINEITEM_ARRIVAL), F.lit(largest // 4 + 1)).cast("int")
    rows.withColumn("batch", batch).write.partitionBy("batch").parquet(staged)
    for number in range(4):
        if folders.exists(spark, f"{staged}/batch={number}"):
            share = spark.read.schema(rows.schema).parquet(f"{staged}/batch={number}")
            files = -(-folders.size_bytes(spark, f"{staged}/batch={number}") // TARGET_FILE_BYTES)
            table.write_batch(share, number, arrival=[tables.LINEITEM_ARRIVAL], range_partitions=max(1, files))
    return table


@registered
def upsert_stored(spark, sf_dir):
    return _lineitem_in_batches(spark, sf_dir).read(spark)


@registered
def upsert_late_rows(spark, sf_dir):
    """All resolved line items, and then a few corrections, which are looked up in them by key."""
    table = KeyedTable(new_work_dir(spark, "corrected"), RAW_POWER, "timestamp", period_ms=365 * DAY_MS)
    table.write_batch(stored_lineitem(spark, sf_dir), 0, unique=True)
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").filter((F.col("l_quantity") <= 1) & (F.col("l_discount") == 0))
    corrections = lines.groupBy(
        F.col("l_suppkey").cast("string").alias("identifier"), tables.epoch_ms(F.col("l_shipdate")).alias("timestamp")
    ).agg((-F.max("l_extendedprice")).alias("valueInW"))
    table.write_batch(corrections, 1, unique=True)
    return table.read(spark)


@registered
def upsert_stored_aggregated(spark, sf_dir):
    """Group records written twice: hour by hour as first seen, then all of them again."""
    table = KeyedTable(new_work_dir(spark, "grouped"), AGGREGATED_POWER, "timestamp")
    grouped = tables.events_grouped(spark, sf_dir)
    first = grouped.withColumns({"count": F.lit(0).cast("long"), "sumInW": F.lit(0.0), "averageInW": F.lit(0.0)})
    table.write_batch(first, 0, unique=True)
    table.write_batch(grouped, 1, unique=True)
    return table.read(spark)


@registered
def ttl_view(spark, sf_dir):
    """Hourly windows, written every ten days, seen when the earliest batch has expired."""
    windows = stored(spark, hourly(spark, sf_dir), "windows")
    table = KeyedTable(new_work_dir(spark, "expiring"), windows.schema, "startTimestamp")
    bounds = windows.agg(F.min("startTimestamp"), F.max("startTimestamp")).first()
    step = 10 * DAY_MS
    for batch, begin in enumerate(range(bounds[0] // step * step, bounds[1] + 1, step)):
        share = windows.filter(F.col("startTimestamp").between(begin, begin + step - 1))
        table.write_batch(share, batch, unique=True, written_at_ms=begin + step, ttl_ms=TTL_MS)
    return table.read(spark, as_of_ms=AS_OF)


# -- SRC4: unusable records ------------------------------------------------------------------


def _damaged(spark, sf_dir) -> DataFrame:
    """Events with the early ones before the epoch and with gaps in keys and values."""
    rows = tables.events_raw(spark, sf_dir)
    return rows.select(
        F.when(F.col("valueInW") < 480.0, F.col("identifier")).alias("identifier"),
        (F.col("timestamp") - F.lit(FIRST_HOUR)).alias("timestamp"),
        F.when(F.col("valueInW") >= 1.0, F.col("valueInW")).alias("valueInW"),
    )


@registered
def quarantine_accepted(spark, sf_dir):
    return quality.accepted(_damaged(spark, sf_dir))


@registered
def quarantine_rejected(spark, sf_dir):
    return quality.rejected(_damaged(spark, sf_dir))


@registered
def quarantine_text(spark, sf_dir):
    """Events as CSV lines, some with a field too many and some with a time that is no number."""
    rows = tables.events_raw(spark, sf_dir)
    damage = F.when(F.col("valueInW") < 50.0, ",more").otherwise("")
    time = F.when(F.col("valueInW") > 450.0, F.lit("soon")).otherwise(F.col("timestamp").cast("string"))
    lines = rows.select(F.concat_ws(",", "identifier", time, "valueInW").alias("line"), damage.alias("damage"))
    folder = new_work_dir(spark, "lines")
    lines.select(F.concat("line", "damage").alias("value")).write.text(folder)
    rejected = quality.rejected(text_records(spark, folder, RAW_POWER, "csv"))
    return rejected.select(F.col(quality.CORRUPT).alias("line"), quality.REASON)


# -- Q10: reconciliation ---------------------------------------------------------------------


@registered
def reconciliation(spark, sf_dir):
    return reconcile.reconciliation(tables.lineitem_raw(spark, sf_dir), stored_lineitem(spark, sf_dir))


@registered
def reconciliation_total(spark, sf_dir):
    return reconcile.reconciliation_total(tables.lineitem_raw(spark, sf_dir), stored_lineitem(spark, sf_dir))


# -- SRC1, SRC2, STR1 - STR8, SNK1 - SNK5: the continuous part -------------------------------


def _run_once(spark, sf_dir, part: str, resolution: Resolution | None = None, grouped: bool = False):
    """Drain the events through one query of the topology; returns the history it filled."""
    resolutions = default_resolutions()
    work = new_work_dir(spark, "stream")
    history = PowerHistory(f"{work}/tables", resolutions)
    groups = None
    if grouped:
        tables.events_grouped(spark, sf_dir).write.parquet(f"{work}/groups")
        groups = file_stream(spark, f"{work}/groups", AGGREGATED_POWER)
    topology = HistoryTopology(
        history,
        tables.events_stream(spark, sf_dir, "event_type" if grouped else "user_id"),
        groups,
        f"{work}/checkpoints",
        trigger={"availableNow": True},
        name=work.rsplit("/", 1)[-1],
    )
    if part == "windows":
        query = topology.start_windows(resolution)
    else:
        query = topology.start_raw_store() if part == "raw" else topology.start_aggregated_store()
    query.awaitTermination()
    return history


def _resolution(api: str) -> Resolution:
    return next(r for r in default_resolutions() if r.api == api)


@registered
def stream_windowed_hourly(spark, sf_dir):
    history = _run_once(spark, sf_dir, "windows", _resolution("hourly"))
    return comparable(history.windowed(spark, "hourly").records)


@registered
def stream_windowed_minutely(spark, sf_dir):
    history = _run_once(spark, sf_dir, "windows", _resolution("minutely"))
    return comparable(history.windowed(spark, "minutely").records)


@registered
def stream_windowed_combined(spark, sf_dir):
    history = _run_once(spark, sf_dir, "windows", _resolution("hourly"), grouped=True)
    return comparable(history.windowed(spark, "hourly").records)


@registered
def stream_change_feed(spark, sf_dir):
    resolution = _resolution("hourly")
    history = _run_once(spark, sf_dir, "windows", resolution)
    return comparable(spark.read.parquet(history.feed_folder(resolution)).drop("batch_id"))


@registered
def stream_raw_store(spark, sf_dir):
    return _run_once(spark, sf_dir, "raw").raw(spark).records


@registered
def stream_aggregated_store(spark, sf_dir):
    return _run_once(spark, sf_dir, "aggregated", grouped=True).aggregated(spark).records


# -- several micro-batches: files that arrive one after the other ----------------------------

BATCHES = 6
LATE_MS = 20 * DAY_MS
A_LITTLE_LATE_MS = 6 * HOUR_MS


def _with_batches(spark, sf_dir) -> DataFrame:
    """Events in ``BATCHES`` groups by arrival."""
    tables.use_utc(spark)
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    last = events.agg(F.max("event_id")).first()[0] or 0
    batch = F.call_function("div", F.col("event_id"), F.lit(last // BATCHES + 1)).cast("int")
    return events.select(
        F.col("user_id").cast("string").alias("identifier"),
        tables.epoch_ms(F.col("ts")).alias("timestamp"),
        F.col("value").alias("valueInW"),
        F.col("event_id").alias("arrival"),
        batch.alias("batch"),
        "event_type",
    )


def _late(rows: DataFrame) -> DataFrame:
    """In the last group, clicks come weeks too late and views some hours."""
    last = F.col("batch") == BATCHES - 1
    delay = F.when(last & (F.col("event_type") == "click"), LATE_MS).when(
        last & (F.col("event_type") == "view"), A_LITTLE_LATE_MS
    )
    return rows.withColumn("timestamp", F.col("timestamp") - F.coalesce(delay, F.lit(0)))


def _run_batches(spark, sf_dir, rows: DataFrame, part: str) -> PowerHistory:
    """Let one group after the other arrive, in as many files as it has, and drain it in a run of its own.

    With both inputs (``all``) there is one run: the sums of the whole month come at once,
    and one clock covers both inputs, so that events after it would be late.
    """
    work = new_work_dir(spark, "batches")
    staged = new_work_dir(spark, "staged")
    rows.select("identifier", "timestamp", "valueInW", "arrival", "batch").write.partitionBy("batch").parquet(staged)
    schema = rows.select("identifier", "timestamp", "valueInW", "arrival").schema
    groups = {int(p.rsplit("=", 1)[1]): p for p in folders.matching(spark, f"{staged}/batch=*")}
    history = PowerHistory(f"{work}/tables", default_resolutions())
    folders.create(spark, f"{work}/raw")
    grouped = f"{work}/groups"
    tables.events_grouped(spark, sf_dir).write.parquet(grouped)
    topology = HistoryTopology(
        history,
        file_stream(spark, f"{work}/raw", schema),
        file_stream(spark, grouped, AGGREGATED_POWER) if part == "all" else None,
        f"{work}/checkpoints",
        trigger={"availableNow": True},
        name=work.rsplit("/", 1)[-1],
    )
    for number in sorted(groups):  # a handful, as many as BATCHES
        spark.read.schema(schema).parquet(groups[number]).write.mode("append").parquet(f"{work}/raw")
        if part == "windows":
            topology.start_windows(_resolution("hourly")).awaitTermination()
        elif part == "raw":
            topology.start_raw_store().awaitTermination()
    if part == "all":
        for query in topology.start():
            query.awaitTermination()
    return history


@registered
def stream_windowed_late(spark, sf_dir):
    """Hours late is counted; weeks late is dropped, as its window was closed in an earlier micro-batch."""
    history = _run_batches(spark, sf_dir, _late(_with_batches(spark, sf_dir)), "windows")
    return comparable(history.windowed(spark, "hourly").records)


@registered
def stream_change_feed_updates(spark, sf_dir):
    """How often each window was published, and with how many records at last."""
    history = _run_batches(spark, sf_dir, _with_batches(spark, sf_dir), "windows")
    feed = spark.read.parquet(history.feed_folder(_resolution("hourly")))
    return feed.groupBy("identifier", "startTimestamp").agg(
        F.count("*").alias("published"), F.max_by("count", "batch_id").alias("count")
    )


@registered
def stream_reconciliation(spark, sf_dir):
    """The third group arrives twice: received again, but stored once."""
    rows = _with_batches(spark, sf_dir)
    again = rows.filter(F.col("batch") == 2).withColumn("batch", F.lit(BATCHES))
    history = _run_batches(spark, sf_dir, rows.unionByName(again), "raw")
    stored_rows = ranges.count(history.raw(spark)).withColumnRenamed("count", "stored")
    return reconcile.reconcile_counts(history.received(spark), stored_rows)


@registered
def stream_topology(spark, sf_dir):
    """Both stores and all resolutions at once: records and sums of every series."""
    history = _run_batches(spark, sf_dir, _with_batches(spark, sf_dir), "all")
    series = {"raw": history.raw(spark), "aggregated": history.aggregated(spark)}
    series |= {r.api: history.windowed(spark, r.api, as_of_ms=0) for r in history.resolutions}
    parts = [
        s.restricted().groupBy("identifier").agg(F.count("*").alias("records")).withColumn("series", F.lit(name))
        for name, s in series.items()
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result.select("series", "identifier", "records")


# -- last write wins, for both inputs --------------------------------------------------------


@registered
def stream_raw_store_overwrites(spark, sf_dir):
    """Line items of a key arrive from the dearest to the cheapest; the cheapest is kept."""
    tables.use_utc(spark)
    schema = spark.read.parquet(f"{sf_dir}/lineitem.parquet").schema
    lines = file_stream(spark, sf_dir, schema, glob="lineitem.parquet")
    raw = lines.select(
        F.col("l_suppkey").cast("string").alias("identifier"),
        tables.epoch_ms(F.col("l_shipdate")).alias("timestamp"),
        F.col("l_extendedprice").alias("valueInW"),
        (-F.round(F.col("l_extendedprice") * 100)).cast("long").alias("cheapness"),
    )
    work = new_work_dir(spark, "overwrites")
    history = PowerHistory(f"{work}/tables", [], period_ms=365 * DAY_MS)
    name = work.rsplit("/", 1)[-1]
    topology = HistoryTopology(
        history, raw, None, f"{work}/c", trigger={"availableNow": True}, raw_arrival=["cheapness"], name=name
    )
    topology.start_raw_store().awaitTermination()
    return history.raw(spark).records


@registered
def stream_aggregated_store_overwrites(spark, sf_dir):
    """Group records of a key arrive in falling order of their count; the smallest is kept."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    tables.use_utc(spark)
    groups = lines.groupBy(
        F.col("l_returnflag").alias("identifier"), tables.epoch_ms(F.col("l_shipdate")).alias("timestamp"), "l_linenumber"
    ).agg(F.count("*").alias("count"))
    work = new_work_dir(spark, "overwrites")
    groups.select(
        "identifier", "timestamp", "count", F.col("l_linenumber").cast("double").alias("sumInW"),
        F.lit(0.0).alias("averageInW"), (-(F.col("count") * 8 + F.col("l_linenumber"))).cast("long").alias("order"),
    ).write.parquet(f"{work}/groups")
    schema = spark.read.parquet(f"{work}/groups").schema
    history = PowerHistory(f"{work}/tables", [], period_ms=365 * DAY_MS)
    topology = HistoryTopology(
        history, tables.events_stream(spark, sf_dir), file_stream(spark, f"{work}/groups", schema), f"{work}/c",
        trigger={"availableNow": True}, aggregated_arrival=["order"], name=work.rsplit("/", 1)[-1],
    )
    topology.start_aggregated_store().awaitTermination()
    return history.aggregated(spark).records


from wattline.plans import incremental  # noqa: E402, F401  registers its queries
