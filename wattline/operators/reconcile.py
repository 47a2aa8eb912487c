"""Received against stored records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reconciliation(received: DataFrame, stored: DataFrame) -> DataFrame:
    """Per identifier: records received, records stored, and the difference.

    The difference includes overwrites: a second record for a key is received but replaces
    the first. Each side is aggregated to one row per identifier before they meet.
    """
    return reconcile_counts(
        received.groupBy("identifier").agg(F.count("*").alias("received")),
        stored.groupBy("identifier").agg(F.count("*").alias("stored")),
    )


def reconcile_counts(received: DataFrame, stored: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("long")
    return received.join(stored, "identifier", "full_outer").select(
        "identifier",
        F.coalesce("received", zero).alias("received"),
        F.coalesce("stored", zero).alias("stored"),
        (F.coalesce("received", zero) - F.coalesce("stored", zero)).alias("difference"),
    )


def reconciliation_total(received: DataFrame, stored: DataFrame) -> DataFrame:
    """The same three numbers over everything, as one row: two counts, then their sum."""
    zero = F.lit(0).cast("long")
    counts = received.agg(F.count("*").alias("received")).withColumn("stored", zero)
    counts = counts.unionByName(stored.agg(F.count("*").alias("stored")).withColumn("received", zero))
    return counts.agg(F.sum("received").alias("received"), F.sum("stored").alias("stored")).withColumn(
        "difference", F.col("received") - F.col("stored")
    )
