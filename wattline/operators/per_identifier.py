"""Joining one fact per identifier back onto the rows of a series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.session import ensure_checkpoint_dir

# A broadcast side may take this much memory; per row, the hash table's share is estimated.
BROADCAST_LIMIT_BYTES = 64 * 1024 * 1024
ROW_BYTES = 160

# An identifier counts as hot from 1/HOT_SPLIT of an average shuffle partition on; there are at
# most HOT_SPLIT times as many hot identifiers as partitions.
HOT_SPLIT = 4


def durable(facts: DataFrame) -> DataFrame:
    """Compute once and keep in reliable storage, so both uses share it and survive lost executors."""
    ensure_checkpoint_dir(facts.sparkSession)
    return facts.checkpoint()


def fits_broadcast(facts: DataFrame, limit_bytes: int) -> bool:
    """Whether durable per-identifier facts are small enough, from their actual row and key sizes."""
    size = facts.agg(
        F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length("identifier")), F.lit(0)).alias("key_bytes")
    ).first()
    return size["rows"] * ROW_BYTES + size["key_bytes"] <= limit_bytes


def join_facts(
    rows: DataFrame,
    facts: DataFrame,
    totals: DataFrame,
    *,
    how: str = "inner",
    limit_bytes: int = BROADCAST_LIMIT_BYTES,
) -> DataFrame:
    """Join ``rows`` with durable ``facts`` (at most one per identifier); ``how`` is inner or left.

    Facts within the size limit are broadcast: the rows are not shuffled at all. Beyond it,
    only what concerns hot identifiers is broadcast (a few per shuffle partition, whatever the
    data), and the remaining rows, none of whose identifiers fills a partition, are shuffled.
    ``totals`` holds (identifier, rows) for every identifier.
    """
    if fits_broadcast(facts, limit_bytes):
        return rows.join(F.broadcast(facts), "identifier", how)

    everything = totals.agg(F.sum("rows")).first()[0]
    shares = HOT_SPLIT * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = totals.filter(F.col("rows") * F.lit(shares) > F.lit(everything)).select("identifier")
    hot_facts = facts.join(F.broadcast(hot), "identifier", "left_semi")
    hot_rows = rows.join(F.broadcast(hot), "identifier", "left_semi")
    other_rows = rows.join(F.broadcast(hot), "identifier", "left_anti")
    return hot_rows.join(F.broadcast(hot_facts), "identifier", how).unionByName(
        other_rows.join(facts.hint("merge"), "identifier", how)
    )
