"""Summaries of a keyed table: counts and value ranges without reading its rows.

For every segment part (one batch's share of one period) there is a row per identifier with the number of records, the smallest and
the largest value and when records expire. Keys do not repeat inside a segment, so the summaries of a *settled* period, which one
segment holds alone, are exact. In a *contested* period several segments hold versions of the same keys: there the rows
are resolved and counted, and nowhere else. So are the two periods that a time restriction cuts, and parts of which some
records have expired.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattline.functions.numeric import nan_aware_min
from wattline.restriction import UNRESTRICTED, TimeRestriction
from wattline.sources import folders
from wattline.sources.table import EXPIRES_AT, PERIOD, KeyedTable, SegmentPart

SCHEMA = "identifier string, segment string, period bigint, records bigint, low double, high double, firstExpiry bigint, lastExpiry bigint, immortal bigint"
_FACTS = ("records", "low", "high")


@dataclass(frozen=True)
class Scope:
    """Which parts of a table summaries answer for, and which have to be read."""

    summarised: list[SegmentPart]
    read: list[SegmentPart]


class Summaries:
    """Summaries of ``table``, whose value is the column ``value``, in a folder beside the table."""

    def __init__(self, table: KeyedTable, value: str) -> None:
        self.table, self.value = table, value
        self.path = f"{table.path}-summaries"

    # -- keeping -----------------------------------------------------------------------------

    def refresh(self, spark: SparkSession) -> int:
        """Summarise segments that have no summary yet, drop those of segments that are gone; returns how many were read.

        To be called after a write or maintenance; a query works without it, by reading what is not
        summarised. A segment is read once in its life.
        """
        parts: dict[str, list[SegmentPart]] = defaultdict(list)
        for part in self.table.segment_parts(spark):
            parts[part.segment].append(part)
        known = self._known(spark)
        for segment in known - parts.keys():
            folders.remove(spark, f"{self.path}/of={segment}")
        new = sorted(parts.keys() - known)
        for segment in new:
            self._summary_of(spark, parts[segment]).write.mode("overwrite").parquet(f"{self.path}/of={segment}")
        return len(new)

    def _known(self, spark: SparkSession) -> set[str]:
        found = folders.matching(spark, f"{self.path}/of=*/_SUCCESS")
        return {path.rsplit("/", 2)[1].removeprefix("of=") for path in found}

    def _summary_of(self, spark: SparkSession, parts: Sequence[SegmentPart]) -> DataFrame:
        rows = self.table.versions(spark, parts)
        return rows.groupBy("identifier", self.table._period().alias(PERIOD)).agg(
            F.count("*").alias("records"),
            nan_aware_min(F.col(self.value)).alias("low"),
            F.max(self.value).alias("high"),
            F.min(EXPIRES_AT).alias("firstExpiry"),
            F.max(EXPIRES_AT).alias("lastExpiry"),
            F.count_if(F.col(EXPIRES_AT).isNull()).alias("immortal"),
        ).withColumn("segment", F.lit(parts[0].segment)).select(*(c.split()[0] for c in SCHEMA.split(", ")))

    # -- asking ------------------------------------------------------------------------------

    def scope(self, spark: SparkSession, restriction: TimeRestriction = UNRESTRICTED) -> Scope:
        """Decided from folder names alone."""
        by_period: dict[int, list[SegmentPart]] = defaultdict(list)
        for part in self.table.segment_parts(spark, restriction):
            by_period[part.period].append(part)
        known, size = self._known(spark), self.table.period_ms
        summarised, read = [], []
        for period, parts in by_period.items():
            first, last = period * size, (period + 1) * size - 1
            inside = (
                (restriction.from_ is None or restriction.from_ <= first)
                and (restriction.after is None or restriction.after < first)
                and (restriction.to is None or restriction.to >= last)
            )
            if inside and len(parts) == 1 and parts[0].segment in known:
                summarised += parts
            else:
                read += parts
        return Scope(summarised, read)

    def per_identifier(
        self, spark: SparkSession, restriction: TimeRestriction = UNRESTRICTED, as_of_ms: int | None = None
    ) -> DataFrame:
        """identifier, records, low, high over the latest versions in range that have not expired at ``as_of_ms`` (now)."""
        scope = self.scope(spark, restriction)
        as_of = F.unix_millis(F.current_timestamp()) if as_of_ms is None else F.lit(as_of_ms)
        facts = []
        if scope.summarised:
            rows = self._rows(spark, scope.summarised)
            dead_any, alive_any = F.col("firstExpiry") <= as_of, (F.col("immortal") > 0) | (F.col("lastExpiry") > as_of)
            whole = rows.filter(F.coalesce(~dead_any, F.lit(True)))
            facts.append(whole.select("identifier", *_FACTS))
            if self._any_expiry(rows, as_of):
                # Periods in which some records have expired and some have not: only these are read.
                mixed = {r[PERIOD] for r in rows.filter(dead_any & alive_any).select(PERIOD).distinct().collect()}
                aged = [part for part in scope.summarised if part.period in mixed]
                if aged:
                    names = rows.filter(dead_any & alive_any).select("identifier", PERIOD)
                    alive = self.table.versions(spark, aged).filter(F.col(EXPIRES_AT).isNull() | (F.col(EXPIRES_AT) > as_of))
                    alive = alive.withColumn(PERIOD, self.table._period()).join(names, ["identifier", PERIOD], "left_semi")
                    facts.append(self._facts(alive))
        if scope.read:
            rows = self.table.resolved(spark, scope.read)
            if restriction != UNRESTRICTED:
                rows = rows.filter(restriction.to_column(self.table.time))
            facts.append(self._facts(rows.filter(F.col(EXPIRES_AT).isNull() | (F.col(EXPIRES_AT) > as_of))))
        if not facts:
            return spark.createDataFrame([], "identifier string, records bigint, low double, high double")
        every = facts[0]
        for more in facts[1:]:
            every = every.unionByName(more)
        return every.groupBy("identifier").agg(
            F.sum("records").alias("records"), nan_aware_min(F.col("low")).alias("low"), F.max("high").alias("high")
        )

    def total_count(
        self, spark: SparkSession, restriction: TimeRestriction = UNRESTRICTED, as_of_ms: int | None = None
    ) -> DataFrame:
        """All records in range, as one row."""
        found = self.per_identifier(spark, restriction, as_of_ms)
        return found.agg(F.coalesce(F.sum("records"), F.lit(0).cast("long")).alias("count"))

    def _rows(self, spark: SparkSession, parts: Sequence[SegmentPart]) -> DataFrame:
        """Summary rows of the given parts; a period is settled in one segment, which names it."""
        segments = sorted({part.segment for part in parts})
        rows = spark.read.schema(SCHEMA).parquet(*(f"{self.path}/of={segment}" for segment in segments))
        # Folder names: as many as the table has parts.
        wanted = spark.createDataFrame([(p.segment, p.period) for p in parts], f"segment string, {PERIOD} bigint")
        return rows.join(F.broadcast(wanted), ["segment", PERIOD], "left_semi")

    @staticmethod
    def _any_expiry(rows: DataFrame, as_of) -> bool:
        return not rows.filter(F.col("firstExpiry") <= as_of).isEmpty()

    def _facts(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy("identifier").agg(
            F.count("*").alias("records"), nan_aware_min(F.col(self.value)).alias("low"), F.max(self.value).alias("high")
        )
