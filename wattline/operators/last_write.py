"""Upsert semantics on immutable rows: per key, the latest write wins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_write(rows: DataFrame, keys: Sequence[str], arrival: Sequence[str]) -> DataFrame:
    """One row per key: the one with the greatest ``arrival`` columns, compared in order.

    ``arrival`` should be unique per key; otherwise list enough columns to make it so. With a
    single numeric arrival column and fixed-width values this is a hash aggregate. Copies of
    a key collapse inside each task before the shuffle, however many there are.
    """
    order = F.col(arrival[0]) if len(arrival) == 1 else F.struct(*arrival)
    payload = [c for c in rows.columns if c not in keys]
    winners = rows.groupBy(*keys).agg(*(F.max_by(c, order).alias(c) for c in payload))
    return winners.select(*rows.columns)


def one_write(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key where nothing says which was written last: copies collapse, different rows are an error."""
    payload = [c for c in rows.columns if c not in keys]
    digest = F.xxhash64(*payload)
    grouped = rows.groupBy(*keys).agg(
        F.min(digest).alias("_low"), F.max(digest).alias("_high"), *(F.max_by(c, digest).alias(c) for c in payload)
    )
    message = F.lit(f"Several rows for one key ({', '.join(keys)}) and no arrival columns to order them.")
    checked = grouped.filter(F.when(F.col("_low") == F.col("_high"), True).otherwise(F.raise_error(message).cast("boolean")))
    return checked.select(*rows.columns)
