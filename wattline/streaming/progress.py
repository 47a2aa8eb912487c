"""Live counters: what each trigger has received, what is stored, and the difference.

A listener takes the records that a store's query has received from its observed metrics, trigger by trigger, without
a job of its own. What is stored follows from the table: summaries where a period is settled, rows where it is contested.
"""

from __future__ import annotations

import logging
import time
from collections import OrderedDict
from collections.abc import Callable
from threading import Lock

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from wattline.operators.trend import OBSERVED
from wattline.sources.summaries import Summaries
from wattline.sources.table import VERSION, KeyedTable

LOGGER = logging.getLogger(__name__)
#: Triggers kept in the driver; older ones live on in the running total.
KEPT_TRIGGERS = 10_000

Sink = Callable[[dict], None]


class ProgressListener(StreamingQueryListener):
    """Received records per trigger of the store query ``query`` (its name), from the metric ``metric``.

    A trigger that runs again after a failure replaces what was noted for its number. ``sink`` is called with
    each new row, for a log or a monitoring system. Metrics named ``OBSERVED`` of any query are warned about.
    """

    def __init__(self, query: str, metric: str = "rawWritten", sink: Sink | None = None, kept: int = KEPT_TRIGGERS) -> None:
        self.query, self.metric, self.sink, self.kept = query, metric, sink, kept
        self._rows: OrderedDict[int, dict] = OrderedDict()
        self._before = 0
        self._lock = Lock()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        missing = progress.observedMetrics.get(OBSERVED)
        if missing is not None and missing["identifiers"]:
            LOGGER.warning("No trend for %d identifiers without records.", missing["identifiers"])
        seen = progress.observedMetrics.get(self.metric)
        if progress.name == self.query and seen is not None and progress.numInputRows:
            self.note(progress.batchId, progress.timestamp, seen["records"])

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def note(self, batch: int, at: str, received: int) -> None:
        with self._lock:
            self._rows[batch] = {"batch": batch, "at": at, "received": received}
            while len(self._rows) > self.kept:
                self._before += self._rows.popitem(last=False)[1]["received"]
            row = self._rows[batch] | {"totalReceived": self._before + sum(r["received"] for r in self._rows.values())}
        if self.sink is not None:
            self.sink(row)

    def wait(self, query: StreamingQuery, seconds: float = 60) -> None:
        """Until the last trigger with records of a stopped query has been noted: events arrive a little after it."""
        numbers = [p["batchId"] for p in query.recentProgress if p["numInputRows"]]
        until = time.monotonic() + seconds
        while numbers and time.monotonic() < until:
            with self._lock:
                if max(numbers) in self._rows:
                    return
            time.sleep(0.05)

    def received(self, spark: SparkSession) -> DataFrame:
        """batch, received, totalReceived for each trigger seen; the total includes those no longer kept."""
        with self._lock:
            rows, total = [], self._before
            for number in sorted(self._rows):
                total += self._rows[number]["received"]
                rows.append((number, self._rows[number]["received"], total))
        return spark.createDataFrame(rows, "batch bigint, received bigint, totalReceived bigint")

    def rows(self, spark: SparkSession, table: KeyedTable) -> DataFrame:
        """batch, received, totalReceived, totalStored, difference for each trigger seen.

        Stored is the number of keys that the table held after the trigger; so the difference has the overwrites and
        the records that could not be used.
        """
        stored = stored_after(spark, table)
        # One row per trigger on either side.
        found = self.received(spark).join(stored, "batch", "left")
        in_order = Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, 0)
        total = F.coalesce(F.last("totalStored", ignorenulls=True).over(in_order), F.lit(0).cast("long"))
        return found.withColumn("totalStored", total).withColumn(
            "difference", F.col("totalReceived") - F.col("totalStored")
        ).select("batch", "received", "totalReceived", "totalStored", "difference")

    def latest(self, spark: SparkSession, summaries: Summaries) -> tuple[int, int, int]:
        """Received, stored and the difference now; stored from the table's summaries."""
        stored = summaries.total_count(spark).first()["count"]
        with self._lock:
            received = self._before + sum(r["received"] for r in self._rows.values())
        return received, stored, received - stored


def stored_after(spark: SparkSession, table: KeyedTable) -> DataFrame:
    """batch, totalStored: keys in the table after each of its batches, which must not have been compacted since.

    A key counts from the batch that first wrote it on. In periods that one batch holds alone, all keys are new and only
    the batch numbers are read; elsewhere the first batch of each key is found.
    """
    by_period: dict[int, list] = {}
    for part in table.segment_parts(spark):
        by_period.setdefault(part.period, []).append(part)
    alone = [parts[0] for parts in by_period.values() if len(parts) == 1]
    shared = [part for parts in by_period.values() if len(parts) > 1 for part in parts]
    counts = table.versions(spark, alone).groupBy(F.col(VERSION).alias("batch")).agg(F.count("*").alias("new"))
    if shared:
        first = table.versions(spark, shared).groupBy(*table.keys).agg(F.min(VERSION).alias("batch"))
        counts = counts.unionByName(first.groupBy("batch").agg(F.count("*").alias("new")))
    counts = counts.groupBy("batch").agg(F.sum("new").alias("new"))
    so_far = Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, 0)  # one row per batch
    return counts.select("batch", F.sum("new").over(so_far).alias("totalStored"))
