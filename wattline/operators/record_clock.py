"""Lateness by a clock that every record moves: stream time as the largest event time that has arrived so far.

A structured stream moves its watermark between micro-batches. A clock per record closes a window as soon as one
record has an event time ``max(24 h, size)`` after the window's start, so that which records are late depends on their exact
order of arrival. That is a running maximum over all records, computed here without putting them into one
task: arrival is cut into ranges, the largest time of each range is carried over to the ranges after it, and the
running maximum inside a range starts from what is carried.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import groupby

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattline.functions.ranks import quantile_borders, rank_among
from wattline.operators.windows import tumbling_windows
from wattline.resolution import Resolution

STREAM_TIME = "streamTime"
#: Ranges of arrival: independent of the data, so that facts per range may be collected and broadcast.
RANGES = 256
_RANGE, _CARRIED = "_range", "_carried"


def with_stream_time(
    records: DataFrame,
    arrival: str | Sequence[str] = "arrival",
    *,
    time: str = "timestamp",
    clock: str | None = None,
    ranges: int = RANGES,
) -> DataFrame:
    """``records`` with ``streamTime``: the largest ``time`` of the records up to and with each one.

    ``arrival`` orders the records; the first of its columns must be a number or timestamp. Records that are equal
    in all of them count by rising time. ``clock`` names a column with one clock for each of its values, as each input partition of
    a broker has its own; without it one clock runs for all. Records without arrival or time move no clock
    and have no stream time.

    One shuffle of the rows, by (clock, range), whatever share of them one identifier has; two scans of
    (clock, arrival, time) before it.
    """
    arrival = [arrival] if isinstance(arrival, str) else list(arrival)
    usable = F.col(time).isNotNull()
    for column in arrival:
        usable = usable & F.col(column).isNotNull()
    position = rank_among(F.col(arrival[0]), quantile_borders(records.filter(usable), arrival[0], ranges))
    key = F.lit(0) if clock is None else F.col(clock)
    placed = records.withColumns({_RANGE: F.when(usable, position), "_clock": key})
    carried = _carried(placed.filter(usable), time)
    inside = Window.partitionBy("_clock", _RANGE).orderBy(*arrival, time).rowsBetween(Window.unboundedPreceding, 0)
    so_far = F.greatest(F.max(time).over(inside), F.col(_CARRIED))
    # Rows that move no clock take part in no join or window: their missing keys would all meet in one task.
    moving = placed.filter(usable).join(F.broadcast(carried), F.col("_clock").eqNullSafe(F.col("_of")) & (F.col(_RANGE) == F.col("_at")), "left")
    moving = moving.withColumn(STREAM_TIME, so_far).select(*records.columns, STREAM_TIME)
    still = records.filter(~usable).withColumn(STREAM_TIME, F.lit(None).cast(records.schema[time].dataType))
    return moving.unionByName(still)


def _carried(placed: DataFrame, time: str) -> DataFrame:
    """For each clock and range, the largest time of the ranges before it; at most one row per clock and range."""
    largest = placed.groupBy("_clock", _RANGE).agg(F.max(time).alias("largest")).collect()
    order = sorted(largest, key=lambda row: (row["_clock"] is not None, row["_clock"], row[_RANGE]))
    rows = []
    for of, own in groupby(order, key=lambda row: row["_clock"]):
        before = None
        for row in own:
            rows.append((of, row[_RANGE], before))
            before = row["largest"] if before is None else max(before, row["largest"])
    kinds = {f.name: f.dataType.simpleString() for f in placed.schema}
    return placed.sparkSession.createDataFrame(rows, f"_of {kinds['_clock']}, _at int, {_CARRIED} {kinds[time]}")


def with_lateness(records: DataFrame, resolution: Resolution, arrival: str | Sequence[str] = "arrival", *, time: str = "timestamp", clock: str | None = None, ranges: int = RANGES) -> DataFrame:
    """``records`` with ``streamTime`` and ``late``: whether the record's window had closed when it arrived.

    A window closes once stream time, the record's own time included, reaches max(24 h, size) after its start.
    """
    rows = with_stream_time(records, arrival, time=time, clock=clock, ranges=ranges)
    start = F.col(time) - F.pmod(F.col(time), F.lit(resolution.size_ms))
    closes = start + F.lit(resolution.size_ms + resolution.watermark_delay_ms)
    return rows.withColumn("late", closes <= F.col(STREAM_TIME))


def windows_by_record_clock(records: DataFrame, resolution: Resolution, arrival: str | Sequence[str] = "arrival", *, time: str = "timestamp", clock: str | None = None, ranges: int = RANGES) -> DataFrame:
    """Windowed records without those that came too late, as a clock per record decides it."""
    judged = with_lateness(records, resolution, arrival, time=time, clock=clock, ranges=ranges)
    return tumbling_windows(judged.filter(~F.col("late")), resolution.size_ms, time=time)
