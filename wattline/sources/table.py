"""A keyed time-series table on Parquet with upsert and expiry.

Every write goes to a folder of its own and never changes another one:

    <path>/segment=batch-<id>/period=<number>/*.parquet
    <path>/segment=compact-<id>-<uuid>/period=<number>/*.parquet

A period is a fixed span of time, a day unless stated otherwise, counted from the epoch. Its
length is kept in the name of a folder beside the segments, and another length is refused.

Rows carry the batch that wrote them (``version``) and when they expire. Reading resolves
each key to its latest version. Seeing a row twice (in its batch and in a compacted copy)
cannot change that, so compaction needs no lock: it adds the copy first and removes the
originals afterwards, and a crash in between only leaves duplicates for the next run.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattline.operators.last_write import last_write, one_write
from wattline.operators.per_identifier import BROADCAST_LIMIT_BYTES, ROW_BYTES
from wattline.restriction import DAY_MS, UNRESTRICTED, TimeRestriction
from wattline.sources import folders

VERSION = "version"
EXPIRES_AT = "expiresAt"
PERIOD = "period"
TARGET_FILE_BYTES = 256 * 1024 * 1024

# Compaction rewrites a period's largest segment once the others have this share of its bytes;
# before that it only merges the others.
FOLD_SHARE = 0.25

_SEGMENT_PART = re.compile(r"/segment=(?P<segment>(?:batch|compact)-(?P<batch>\d+)[^/]*)/period=(?P<period>-?\d+)$")


def _alive(as_of: Column) -> Column:
    return F.col(EXPIRES_AT).isNull() | (F.col(EXPIRES_AT) > as_of)


@dataclass(frozen=True)
class SegmentPart:
    """One segment's share of one period: the unit that is read, compacted and removed."""

    path: str
    segment: str
    batch: int
    period: int


class KeyedTable:
    """Rows of ``schema`` keyed by (identifier, ``time``).

    Choose ``period_ms`` so that a period's share of the data fills several files.
    """

    def __init__(self, path: str, schema: T.StructType, time: str, period_ms: int = DAY_MS) -> None:
        self.path = path.rstrip("/")
        self.schema = schema
        self.time = time
        self.period_ms = period_ms
        self.keys = ("identifier", time)
        # Stored columns are nullable whatever the writer declared.
        self._stored = T.StructType(
            [*schema.fields, T.StructField(VERSION, T.LongType()), T.StructField(EXPIRES_AT, T.LongType())]
        )

    # -- writing ---------------------------------------------------------------------------

    def write_batch(
        self,
        rows: DataFrame,
        batch_id: int,
        *,
        arrival: Sequence[str] | None = None,
        unique: bool = False,
        written_at_ms: int | None = None,
        ttl_ms: int | None = None,
        range_partitions: int | None = None,
    ) -> None:
        """Upsert ``rows`` as batch ``batch_id``; repeating a batch replaces it.

        ``arrival`` orders rows of one key inside the batch, and the last one counts; without it
        different rows of one key are an error. ``unique`` states that keys do not repeat and
        skips that step. ``range_partitions`` sorts the output into that many (period, identifier,
        time) ranges: wanted for bulk loads, too expensive for small batches.
        """
        self._check_period(rows.sparkSession)
        if not unique and arrival:
            kept = list(dict.fromkeys([*self.schema.names, *arrival]))
            rows = last_write(rows.select(*kept), self.keys, list(arrival))
        elif not unique:
            rows = one_write(rows.select(*self.schema.names), self.keys)
        if ttl_ms is not None and written_at_ms is None:
            raise ValueError("Expiring rows need the time of writing.")
        expires_at = F.lit(None) if ttl_ms is None else F.lit(written_at_ms + ttl_ms)
        rows = rows.select(
            *self.schema.names,
            F.lit(batch_id).cast("long").alias(VERSION),
            expires_at.cast("long").alias(EXPIRES_AT),
        )
        self._write(rows, f"batch-{batch_id:012d}", range_partitions)

    def _write(self, rows: DataFrame, segment: str, range_partitions: int | None) -> None:
        rows = rows.withColumn(PERIOD, self._period())
        layout = [PERIOD, *self.keys]
        if range_partitions is not None:
            rows = rows.repartitionByRange(range_partitions, *layout)
        rows.sortWithinPartitions(*layout).write.mode("overwrite").partitionBy(PERIOD).parquet(
            f"{self.path}/segment={segment}"
        )

    def _check_period(self, spark: SparkSession) -> None:
        """The first write notes the length of periods; any other length would look in the wrong folders."""
        noted = [int(p.rsplit("=", 1)[1]) for p in folders.matching(spark, f"{self.path}/_period_ms=*")]
        if noted and self.period_ms not in noted:
            raise ValueError(f"{self.path} has periods of {noted[0]} ms, not of {self.period_ms} ms.")
        if not noted:
            folders.create(spark, f"{self.path}/_period_ms={self.period_ms}")

    # -- reading ---------------------------------------------------------------------------

    def segment_parts(
        self, spark: SparkSession, restriction: TimeRestriction = UNRESTRICTED
    ) -> list[SegmentPart]:
        """Folders of completed writes whose period can match. A listing of folder names only."""
        if not self.is_empty(spark):
            self._check_period(spark)
        done = {p.rsplit("/", 2)[-2] for p in folders.matching(spark, f"{self.path}/segment=*/_SUCCESS")}
        first, last = restriction.period_bounds(self.period_ms)
        found = []
        for path in folders.matching(spark, f"{self.path}/segment=*/{PERIOD}=*"):
            match = _SEGMENT_PART.search(path)
            if match is None or f"segment={match['segment']}" not in done:
                continue
            period = int(match["period"])
            if (first is None or period >= first) and (last is None or period <= last):
                found.append(SegmentPart(path, match["segment"], int(match["batch"]), period))
        return found

    def is_empty(self, spark: SparkSession) -> bool:
        return not folders.matching(spark, f"{self.path}/segment=*")

    def versions(self, spark: SparkSession, parts: Iterable[SegmentPart]) -> DataFrame:
        """Every stored version in ``parts``."""
        paths = [p.path for p in parts]
        if not paths:
            return spark.createDataFrame([], self._stored)
        return spark.read.schema(self._stored).parquet(*paths)

    def resolved(self, spark: SparkSession, parts: Sequence[SegmentPart]) -> DataFrame:
        """The latest version of every key in ``parts``.

        Keys never repeat inside one segment, so a period held by a single segment is read as
        it is, without a shuffle. Only periods with several segments are aggregated.
        """
        by_period: dict[int, list[SegmentPart]] = defaultdict(list)
        for part in parts:
            by_period[part.period].append(part)
        settled = [share[0] for share in by_period.values() if len(share) == 1]
        contested = [share for share in by_period.values() if len(share) > 1]
        rows = self.versions(spark, settled)
        if not contested:
            return rows
        sizes = self._sizes(spark)
        bases = [max(share, key=lambda part: sizes.get(part.path, 0)) for share in contested]
        changes = [part for share, base in zip(contested, bases, strict=True) for part in share if part != base]
        latest = self._with_changes(spark, bases, changes)
        return rows.unionByName(latest) if settled else latest

    def _with_changes(self, spark: SparkSession, bases: list[SegmentPart], changes: list[SegmentPart]) -> DataFrame:
        """Bases, in which keys do not repeat, overlaid with changes.

        Few changes are broadcast by their keys: base rows that none of them concerns are read as
        they are, and only the others are aggregated. Many changes are aggregated with their bases.
        """
        base, changed = self.versions(spark, bases), self.versions(spark, changes)
        size = changed.agg(
            F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length("identifier")), F.lit(0)).alias("key_bytes")
        ).first()
        if size["rows"] * ROW_BYTES + size["key_bytes"] > BROADCAST_LIMIT_BYTES:
            return last_write(base.unionByName(changed), self.keys, [VERSION])
        keys = F.broadcast(changed.select(*self.keys))
        untouched = base.join(keys, list(self.keys), "left_anti").select(*base.columns)
        touched = base.join(keys, list(self.keys), "left_semi").select(*base.columns)
        return untouched.unionByName(last_write(touched.unionByName(changed), self.keys, [VERSION]))

    def _sizes(self, spark: SparkSession) -> dict[str, int]:
        """Bytes of every segment part by its path, from one listing."""
        return folders.sizes_below(spark, f"{self.path}/segment=*/{PERIOD}=*/*")

    def read(
        self,
        spark: SparkSession,
        restriction: TimeRestriction = UNRESTRICTED,
        as_of_ms: int | None = None,
    ) -> DataFrame:
        """The table's rows: latest version per key, without those expired at ``as_of_ms`` (now).

        Expiry is checked after resolution: an expired row still hides what it overwrote.
        """
        rows = self.resolved(spark, self.segment_parts(spark, restriction))
        if restriction != UNRESTRICTED:
            rows = rows.filter(restriction.to_column(self.time))
        as_of = F.unix_millis(F.current_timestamp()) if as_of_ms is None else F.lit(as_of_ms)
        return rows.filter(_alive(as_of)).select(*self.schema.names)

    # -- maintenance -----------------------------------------------------------------------

    def compact(self, spark: SparkSession, fold_share: float = FOLD_SHARE) -> int:
        """Merge segments of periods that have several; returns how many periods were written.

        A period's largest segment stays as it is until the others have ``fold_share`` of its
        bytes; until then only those others are merged. Segments that hold nothing any more are
        removed, so their number does not follow the number of batches. Queries that are still
        reading replaced folders would miss their files: run maintenance between long queries.
        """
        by_period: dict[int, list[SegmentPart]] = defaultdict(list)
        for part in self.segment_parts(spark):
            by_period[part.period].append(part)
        folded, merged = [], []
        sizes = self._sizes(spark)
        for share in by_period.values():
            if len(share) == 1:
                continue
            base = max(share, key=lambda part: sizes.get(part.path, 0))
            others = [part for part in share if part != base]
            if sum(sizes.get(part.path, 0) for part in others) >= fold_share * sizes.get(base.path, 0):
                folded += share
            elif len(others) > 1:
                merged += others
        written = self._rewrite(spark, folded, None) + self._rewrite(spark, merged, None)
        self._drop_empty_segments(spark)
        return written

    def vacuum(self, spark: SparkSession, as_of_ms: int) -> int:
        """Drop rows expired at ``as_of_ms`` from storage; returns how many periods were changed.

        Periods in which every row has expired lose their folders without being read again.
        """
        parts = self.segment_parts(spark)
        dead = F.count_if(F.col(EXPIRES_AT) <= F.lit(as_of_ms))
        counted = self.versions(spark, parts).groupBy(self._period().alias(PERIOD)).agg(
            dead.alias("dead"), F.count("*").alias("rows")
        )
        # One row per period with expired rows: at most as many as the table has folders.
        found = {row[PERIOD]: row["dead"] == row["rows"] for row in counted.filter("dead > 0").collect()}
        self._rewrite(spark, [p for p in parts if found.get(p.period) is False], as_of_ms)
        for part in parts:
            if found.get(part.period):
                folders.remove(spark, part.path)
        self._drop_empty_segments(spark)
        return len(found)

    def _drop_empty_segments(self, spark: SparkSession) -> None:
        """Remove finished segments without periods. Periods go first and the marker of completion
        last, so an interruption leaves nothing that could be read."""
        filled = {p.rsplit("/", 2)[-2] for p in folders.matching(spark, f"{self.path}/segment=*/{PERIOD}=*")}
        for marker in folders.matching(spark, f"{self.path}/segment=*/_SUCCESS"):
            segment = marker.rsplit("/", 1)[0]
            if segment.rsplit("/", 1)[1] not in filled:
                folders.remove(spark, segment)

    def _period(self) -> Column:
        # Integer arithmetic: dividing as doubles is inexact for large times.
        start = F.col(self.time) - F.pmod(F.col(self.time), F.lit(self.period_ms))
        return F.call_function("div", start, F.lit(self.period_ms))

    def _rewrite(self, spark: SparkSession, replaced: Sequence[SegmentPart], as_of_ms: int | None) -> int:
        """Replace the given parts by one segment with their latest versions; returns the number of periods."""
        if not replaced:
            return 0
        rows = self.resolved(spark, replaced)
        if as_of_ms is not None:
            rows = rows.filter(_alive(F.lit(as_of_ms)))
        sizes = self._sizes(spark)
        stored = sum(sizes.get(part.path, 0) for part in replaced)
        segment = f"compact-{max(p.batch for p in replaced):012d}-{uuid.uuid4().hex[:8]}"
        self._write(rows, segment, max(1, -(-stored // TARGET_FILE_BYTES)))
        for part in replaced:
            folders.remove(spark, part.path)
        return len({part.period for part in replaced})
