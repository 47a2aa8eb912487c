"""The store as a whole: where each series lives and how to query it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattline.errors import InvalidQueryError
from wattline.resolution import Resolution, default_resolutions
from wattline.restriction import DAY_MS, UNRESTRICTED, TimeRestriction
from wattline.schemas import AGGREGATED_POWER, RAW_POWER, RECEIVED, WINDOWED_POWER
from wattline.series import Series
from wattline.sources.table import KeyedTable

# Counts of received records are kept per batch; so many batches share a folder.
BATCHES_PER_PERIOD = 1_000_000


class PowerHistory:
    """Tables below ``root``: raw, aggregated, and one per resolution.

    The series it returns go into the functions of ``wattline.operators``. Passing the query's
    restriction here as well lets the table skip whole periods before Spark lists their files.
    ``period_ms`` is the length of those periods, the same whenever a history is opened.
    """

    def __init__(
        self, root: str, resolutions: Sequence[Resolution] | None = None, *, period_ms: int = DAY_MS
    ) -> None:
        self.period_ms = period_ms
        self.root = root.rstrip("/")
        self.resolutions = list(default_resolutions() if resolutions is None else resolutions)
        self.raw_table = KeyedTable(f"{self.root}/raw", RAW_POWER, "timestamp", period_ms)
        self.aggregated_table = KeyedTable(f"{self.root}/aggregated", AGGREGATED_POWER, "timestamp", period_ms)
        self.received_table = KeyedTable(f"{self.root}/received", RECEIVED, "batch", BATCHES_PER_PERIOD)

    def windowed_table(self, resolution: Resolution) -> KeyedTable:
        return KeyedTable(f"{self.root}/windowed/{resolution.table}", WINDOWED_POWER, "startTimestamp", self.period_ms)

    def tables(self) -> list[KeyedTable]:
        return [self.raw_table, self.aggregated_table, self.received_table, *map(self.windowed_table, self.resolutions)]

    def compact(self, spark: SparkSession) -> int:
        """Merge what micro-batches have left in all tables; to be run regularly."""
        return sum(table.compact(spark) for table in self.tables())

    def vacuum(self, spark: SparkSession, as_of_ms: int) -> int:
        """Drop expired windows from storage."""
        expiring = [self.windowed_table(r) for r in self.resolutions if r.ttl_ms is not None]
        return sum(table.vacuum(spark, as_of_ms) for table in expiring)

    def received(self, spark: SparkSession) -> DataFrame:
        """Records received per identifier, for the reconciliation; repeated batches count once."""
        return self.received_table.read(spark).groupBy("identifier").agg(F.sum("received").alias("received"))

    def rejected_folder(self, source: str) -> str:
        return f"{self.root}/rejected/{source}"

    def feed_folder(self, resolution: Resolution) -> str:
        return f"{self.root}/feeds/{resolution.feed}"

    def raw(self, spark: SparkSession, restriction: TimeRestriction = UNRESTRICTED) -> Series:
        return Series.raw(self.raw_table.read(spark, restriction))

    def aggregated(self, spark: SparkSession, restriction: TimeRestriction = UNRESTRICTED) -> Series:
        return Series.aggregated(self.aggregated_table.read(spark, restriction))

    def windowed(
        self,
        spark: SparkSession,
        api: str,
        restriction: TimeRestriction = UNRESTRICTED,
        as_of_ms: int | None = None,
    ) -> Series:
        """The series published under ``api``, without the rows expired at ``as_of_ms`` (now)."""
        for resolution in self.resolutions:
            if resolution.api == api:
                return Series.windowed(self.windowed_table(resolution).read(spark, restriction, as_of_ms))
        raise InvalidQueryError(f"There is no resolution '{api}'.")

    def resolution_names(self, spark: SparkSession) -> DataFrame:
        """Public names of the resolutions; one without a name is skipped, not those after it."""
        names = [(r.api,) for r in self.resolutions if r.api is not None]
        return spark.createDataFrame(names, "resolution string")
