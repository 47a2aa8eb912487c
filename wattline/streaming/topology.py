"""The continuous part: two input streams into keyed tables, windows and feeds."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from wattline.history import PowerHistory
from wattline.operators.quality import REASON, accepted, reason_for
from wattline.operators.windows import combined_power
from wattline.resolution import Resolution
from wattline.sources import folders
from wattline.sources.readers import ARRIVAL
from wattline.sources.table import KeyedTable
from wattline.streaming.fanout import RESOLUTION, all_windows
from wattline.streaming.feeds import Feed, file_feed
from wattline.streaming.windows import windowed_stream

ROWS_PER_FILE = 1_000_000

_POSITION = "_position"

AGGREGATED_VALUES = ("count", "sumInW", "averageInW")


def now_ms() -> int:
    return int(time.time() * 1000)


class HistoryTopology:
    """Streaming queries that feed a ``PowerHistory``.

    Each query has its own checkpoint, and each resolution its own watermark. Every write of a
    micro-batch replaces what an earlier attempt of the same batch left, so a restart does not
    count or store anything twice.

    ``event_time`` and ``key`` name the columns windows use; with Kafka these may be the message
    timestamp and key. ``raw_arrival`` and ``aggregated_arrival`` name the columns that order
    records of one key within a micro-batch, the last one being kept; by default the column ``arrival``
    that the readers supply. A stream without any must not have different records for one key.
    """

    def __init__(
        self,
        history: PowerHistory,
        raw: DataFrame,
        aggregated: DataFrame | None,
        checkpoints: str,
        *,
        trigger: Mapping[str, object] | None = None,
        raw_arrival: Sequence[str] | None = None,
        aggregated_arrival: Sequence[str] | None = None,
        key: str = "identifier",
        event_time: str = "timestamp",
        feeds: Mapping[str, Feed] | None = None,
        clock: Callable[[], int] = now_ms,
        name: str = "history",
    ) -> None:
        self.history = history
        self.raw = raw
        self.aggregated = aggregated
        self.checkpoints = checkpoints.rstrip("/")
        self.trigger = dict(trigger or {"processingTime": "1 second"})
        self.raw_arrival = raw_arrival
        self.aggregated_arrival = aggregated_arrival
        self.key = key
        self.event_time = event_time
        self.feeds = dict(feeds or {})
        self.clock = clock
        self.name = name

    def start(self, *, one_pass: bool = False) -> list[StreamingQuery]:
        """Start every query: both stores and all resolutions, the latter in one query if ``one_pass``."""
        queries = [self.start_raw_store()]
        if self.aggregated is not None:
            queries.append(self.start_aggregated_store())
        if one_pass:
            return queries + [self.start_all_windows()]
        return queries + [self.start_windows(r) for r in self.history.resolutions]

    def start_raw_store(self) -> StreamingQuery:
        received = self.history.received_table
        return self._start_store("raw", self.raw, self.history.raw_table, ("valueInW",), self.raw_arrival, received)

    def start_aggregated_store(self) -> StreamingQuery:
        table = self.history.aggregated_table
        return self._start_store(
            "aggregated", self.aggregated, table, AGGREGATED_VALUES, self.aggregated_arrival, None
        )

    def start_windows(self, resolution: Resolution) -> StreamingQuery:
        updates = windowed_stream(self._windowable(), resolution)
        table = self.history.windowed_table(resolution)

        def write(rows: DataFrame, batch_id: int) -> None:
            rows.persist()
            try:
                self._publish(rows, batch_id, resolution)
            finally:
                rows.unpersist()

        return self._start(
            updates.writeStream.outputMode("update").foreachBatch(write), f"windowed-{resolution.table}", [table]
        )

    def start_all_windows(self) -> StreamingQuery:
        """All resolutions in one query that reads each input once."""
        resolutions = self.history.resolutions
        updates = all_windows(self._windowable(), resolutions)

        def write(rows: DataFrame, batch_id: int) -> None:
            rows.persist()
            try:
                for resolution in resolutions:
                    own = rows.filter(F.col(RESOLUTION) == resolution.table).drop(RESOLUTION)
                    self._publish(own, batch_id, resolution)
            finally:
                rows.unpersist()

        tables = [self.history.windowed_table(r) for r in resolutions]
        return self._start(updates.writeStream.outputMode("update").foreachBatch(write), "windowed-all", tables)

    def _publish(self, rows: DataFrame, batch_id: int, resolution: Resolution) -> None:
        """Changed windows of one resolution to its table and its feed."""
        changed = rows.count()
        if changed == 0:
            return  # a batch that only closed windows
        # State has many partitions, a micro-batch few rows: do not write a file for each.
        merged = rows.coalesce(-(-changed // ROWS_PER_FILE))
        # Update mode emits each changed window once per micro-batch.
        self.history.windowed_table(resolution).write_batch(
            merged, batch_id, unique=True, written_at_ms=self.clock(), ttl_ms=resolution.ttl_ms
        )
        feed = self.feeds.get(resolution.feed) or file_feed(self.history.feed_folder(resolution))
        feed(merged, batch_id)

    def _windowable(self) -> DataFrame:
        """The combined series, with the columns windows group by in identifier and timestamp."""

        def prepared(rows: DataFrame, required: Sequence[str]) -> DataFrame:
            good = accepted(rows, time=self.event_time, required=required, identifier=self.key)
            return good.withColumns({"identifier": F.col(self.key), "timestamp": F.col(self.event_time)})

        raw = prepared(self.raw, ("valueInW",))
        if self.aggregated is None:
            return raw.select("identifier", "timestamp", "valueInW")
        return combined_power(raw, prepared(self.aggregated, AGGREGATED_VALUES))

    def _start_store(
        self,
        name: str,
        stream: DataFrame,
        table: KeyedTable,
        required: Sequence[str],
        arrival: Sequence[str] | None,
        received: KeyedTable | None,
    ) -> StreamingQuery:
        rejected_feed = file_feed(self.history.rejected_folder(name))
        order = list(arrival) if arrival else [ARRIVAL] if ARRIVAL in stream.columns else None
        if order and any("file_block_start" in stream.select(c).schema.simpleString() for c in order):
            order.append(_POSITION)

        def write(rows: DataFrame, batch_id: int) -> None:
            rows = rows.withColumn(_POSITION, F.monotonically_increasing_id())  # places inside blocks of text files
            rows.persist()
            try:
                if rows.isEmpty():
                    return
                table.write_batch(accepted(rows, required=required), batch_id, arrival=order)
                rejected_feed(self._rejected(rows.drop(_POSITION), required), batch_id)
                if received is not None:
                    counts = rows.groupBy("identifier").agg(F.count("*").alias("received"))
                    counts = counts.withColumn("batch", F.lit(batch_id).cast("long")).select(*received.schema.names)
                    files = -(-counts.count() // ROWS_PER_FILE)  # one row per identifier
                    received.write_batch(counts.coalesce(max(1, files)), batch_id, unique=True)
            finally:
                rows.unpersist()

        observed = stream.observe(
            f"{name}Written",
            F.count("*").alias("records"),
            F.min("timestamp").alias("firstTimestamp"),
            F.max("timestamp").alias("lastTimestamp"),
        )
        return self._start(observed.writeStream.foreachBatch(write), f"{name}-store", [table])

    def _rejected(self, rows: DataFrame, required: Sequence[str]) -> DataFrame:
        """Records that the store, or only the windows, cannot use, with the reason."""
        stored = reason_for(rows, required=required)
        windowed = reason_for(rows, time=self.event_time, required=required, identifier=self.key)
        reason = F.coalesce(stored, F.concat(F.lit("not in windows: "), windowed))
        return rows.withColumn(REASON, reason).filter(F.col(REASON).isNotNull())

    def query_name(self, part: str) -> str:
        """The name of a running query, as listeners see it: ``raw-store``, ``windowed-<table>`` and so on."""
        return f"{self.name}-{part}"

    def _start(self, writer: DataStreamWriter, name: str, tables: Sequence[KeyedTable]) -> StreamingQuery:
        checkpoint = f"{self.checkpoints}/{name}"
        spark = self.raw.sparkSession
        # A fresh checkpoint counts batches from 0 again and would replace stored ones.
        for table in tables:
            if not folders.exists(spark, checkpoint) and not table.is_empty(spark):
                raise RuntimeError(f"{table.path} has data, but its checkpoint {checkpoint} is missing.")
        return (
            writer.queryName(self.query_name(name))
            .option("checkpointLocation", checkpoint)
            .trigger(**self.trigger)
            .start()
        )
