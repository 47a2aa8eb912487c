"""Tumbling-window statistics and the projections around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattline.functions.numeric import nan_aware_min


def power_from_aggregated(aggregated: DataFrame) -> DataFrame:
    """A group record as a power record: its value is the group's sum."""
    return aggregated.select("identifier", "timestamp", F.col("sumInW").alias("valueInW"))


def combined_power(raw: DataFrame, aggregated: DataFrame) -> DataFrame:
    """Both inputs as one power series (UNION ALL; shared identifiers merge)."""
    return raw.select("identifier", "timestamp", "valueInW").unionByName(power_from_aggregated(aggregated))


def statistics(value: str) -> list[Column]:
    """Aggregates of one window. All buffers are fixed-width, so partial hash aggregation applies."""
    column = F.col(value)
    return [
        F.count(column).alias("count"),
        F.avg(column).alias("mean"),
        F.var_pop(column).alias("populationVariance"),
        nan_aware_min(column).alias("min"),
        F.max(column).alias("max"),
    ]


STATISTIC_COLUMNS = ("count", "mean", "populationVariance", "min", "max")


def tumbling_windows(
    records: DataFrame,
    size_ms: int,
    *,
    key: str = "identifier",
    time: str = "timestamp",
    value: str = "valueInW",
) -> DataFrame:
    """Windowed records of a batch series; windows are aligned to the epoch.

    Grouping on a BIGINT start keeps the shuffle key at (string, long). Partial aggregation
    runs before the only exchange, so a hot key reaches it as one row per window and task.
    """
    start = (F.col(time) - F.pmod(F.col(time), F.lit(size_ms))).alias("startTimestamp")
    return (
        records.filter(F.col(key).isNotNull())
        .groupBy(F.col(key).alias("identifier"), start)
        .agg(*statistics(value))
        .select(
            "identifier",
            "startTimestamp",
            (F.col("startTimestamp") + F.lit(size_ms)).alias("endTimestamp"),
            *STATISTIC_COLUMNS,
        )
    )
