"""Rejected records, their repair, and their return, once each.

A rejected record is known by a digest of its content, its place of arrival included, so that two deliveries of the same
values are two records and the copies that a repeated micro-batch leaves are one. Repaired records are appended to a folder of their
own together with that digest. What is visible there *is* the note of what has been replayed: files appear whole, so after a crash in
the middle of an append the records in the files that made it are done and the others are still waiting. That folder
is an input like any other, for a stream or for a batch write.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattline.operators.quality import REASON, accepted
from wattline.sources import folders

CONTENT_KEY = "contentKey"
Repair = Callable[[DataFrame], DataFrame]


def with_content_key(rows: DataFrame) -> DataFrame:
    """``rows`` with a digest of all columns but the reason; null and empty values differ."""
    columns = sorted(c for c in rows.columns if c not in (REASON, CONTENT_KEY))
    return rows.withColumn(CONTENT_KEY, F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256))


class Quarantine:
    """The records that a topology rejected below ``rejected`` (a folder per batch), and the repaired ones below ``repaired``."""

    def __init__(self, rejected: str, repaired: str, schema: T.StructType, required: Sequence[str] = ("valueInW",)) -> None:
        self.rejected, self.repaired = rejected.rstrip("/"), repaired.rstrip("/")
        self.schema, self.required = schema, tuple(required)

    def records(self, spark: SparkSession) -> DataFrame:
        """Every rejected record once, with its reason and content key."""
        paths = folders.matching(spark, f"{self.rejected}/batch_id=*")
        if not paths:
            return with_content_key(spark.createDataFrame([], T.StructType([*self.schema.fields, T.StructField(REASON, T.StringType())])))
        rows = with_content_key(spark.read.option("mergeSchema", "true").parquet(*paths))
        return rows.groupBy(CONTENT_KEY).agg(*(F.first(c).alias(c) for c in rows.columns if c != CONTENT_KEY))

    def replayed(self, spark: SparkSession) -> DataFrame:
        """Content keys of the records that have returned."""
        if not folders.matching(spark, f"{self.repaired}/*.parquet"):
            return spark.createDataFrame([], f"{CONTENT_KEY} string")
        return spark.read.schema(f"{CONTENT_KEY} string").parquet(self.repaired)

    def waiting(self, spark: SparkSession) -> DataFrame:
        """Rejected records that have not returned."""
        return self.records(spark).join(self.replayed(spark), CONTENT_KEY, "left_anti")

    def replay(self, spark: SparkSession, repair: Repair) -> int:
        """Append what ``repair`` makes usable of the waiting records; returns how many return.

        ``repair`` maps rows to rows and keeps ``contentKey``; it may leave rows out or unusable, and these keep waiting.
        Calling it again, also after a crash, brings nothing back twice. One caller at a time.
        """
        mended = accepted(repair(self.waiting(spark)).drop(REASON), required=self.required)
        mended = mended.select(*self.schema.names, CONTENT_KEY).dropDuplicates([CONTENT_KEY])
        before = self.replayed(spark).count()
        mended.write.mode("append").parquet(self.repaired)
        return self.replayed(spark).count() - before
