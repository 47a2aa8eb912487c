"""Change feeds: where the updated windows of each micro-batch are published.

A feed is a function ``(rows, batch_id)``. File feeds replace a repeated batch; a Kafka feed
delivers it again, as at-least-once producers do.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattline.operators.last_write import last_write
from wattline.restriction import DAY_MS
from wattline.schemas import WINDOWED_POWER
from wattline.sources import folders

Feed = Callable[[DataFrame, int], None]


def file_feed(folder: str, file_format: str = "parquet") -> Feed:
    """A folder per batch; a batch without rows leaves none."""

    def publish(rows: DataFrame, batch_id: int) -> None:
        if not rows.isEmpty():
            rows.write.mode("overwrite").format(file_format).save(
                f"{folder}/batch_id={batch_id}"
            )

    return publish


class RetainedFeed:
    """Updated windows in one folder per span of publishing time, removed by age.

    The number of folders depends on the spans that are kept, not on the number of batches. Publishing appends, so
    a repeated batch leaves its rows twice; every view takes a window's state of a batch once. Readers see a folder only
    until it is ``keep_ms`` old and it is removed ``grace_ms`` later, so that queries that have begun can finish.
    """

    def __init__(
        self,
        folder: str,
        *,
        span_ms: int = 3_600_000,
        keep_ms: int = 7 * DAY_MS,
        grace_ms: int = 3_600_000,
        clock: Callable[[], int] = lambda: int(time.time() * 1000),
    ) -> None:
        self.folder, self.span_ms, self.keep_ms, self.grace_ms, self.clock = folder.rstrip("/"), span_ms, keep_ms, grace_ms, clock

    def __call__(self, rows: DataFrame, batch_id: int) -> None:
        """Publish the windows that a micro-batch has changed."""
        if not rows.isEmpty():
            span = self.clock() // self.span_ms
            rows.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("append").parquet(f"{self.folder}/span={span}")

    def spans(self, spark: SparkSession, as_of_ms: int | None = None) -> list[int]:
        """The spans whose windows are visible."""
        oldest = ((self.clock() if as_of_ms is None else as_of_ms) - self.keep_ms) // self.span_ms
        return [span for span in self._all(spark) if span > oldest]

    def _all(self, spark: SparkSession) -> list[int]:
        return sorted(int(p.rsplit("=", 1)[1]) for p in folders.matching(spark, f"{self.folder}/span=*"))

    def updates(self, spark: SparkSession, as_of_ms: int | None = None) -> DataFrame:
        """Each window's state after each batch that changed it: windowed records and ``batch_id``."""
        return last_write(self._rows(spark, as_of_ms), [*_WINDOW, "batch_id"], ["count"])

    def latest(self, spark: SparkSession, as_of_ms: int | None = None) -> DataFrame:
        """The last published state of each window; copies collapse in each task before the only shuffle."""
        return last_write(self._rows(spark, as_of_ms), _WINDOW, ["batch_id"]).select(*WINDOWED_POWER.names)

    def _rows(self, spark: SparkSession, as_of_ms: int | None) -> DataFrame:
        stored = T.StructType([*WINDOWED_POWER.fields, T.StructField("batch_id", T.LongType())])
        paths = [f"{self.folder}/span={span}" for span in self.spans(spark, as_of_ms)]
        return spark.read.schema(stored).parquet(*paths) if paths else spark.createDataFrame([], stored)

    def remove_old(self, spark: SparkSession, as_of_ms: int | None = None) -> int:
        """Remove spans that no reader can still be using; returns how many."""
        now = self.clock() if as_of_ms is None else as_of_ms
        oldest = (now - self.keep_ms - self.grace_ms) // self.span_ms
        old = [span for span in self._all(spark) if span < oldest]
        for span in old:
            folders.remove(spark, f"{self.folder}/span={span}")
        return len(old)


_WINDOW = ("identifier", "startTimestamp")


# Precedes an Avro body where a schema registry is used: a zero and the number of the schema.
REGISTRY_HEADER = b"\x00\x00\x00\x00\x00"


def kafka_feed(servers: str, topic: str, avro_schema: str, *, header: bytes = REGISTRY_HEADER) -> Feed:
    """Avro values keyed by identifier, after ``header``, which is as long as the reader expects by default.

    Needs the Kafka and Avro packages.
    """

    def publish(rows: DataFrame, batch_id: int) -> None:
        from pyspark.sql.avro.functions import to_avro

        rows.select(
            F.col("identifier").alias("key"),
            F.concat(F.lit(header), to_avro(F.struct(*rows.columns), avro_schema)).alias("value"),
        ).write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()

    return publish
