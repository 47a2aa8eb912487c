"""The state of a running aggregation as rows: which windows are open, and with what statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattline.functions.numeric import NAN
from wattline.operators.windows import STATISTIC_COLUMNS
from wattline.resolution import Resolution
from wattline.streaming.fanout import RESOLUTION, lifetime_ms

# The buffers of the statistics in the order in which the state holds them; there their names repeat.
_BUFFERS = "struct<count: bigint, sum: double, values: bigint, n: double, avg: double, m2: double, max: double, min: double>"


def _state(spark: SparkSession, checkpoint: str, batch_id: int | None) -> DataFrame:
    reader = spark.read.format("statestore")
    if batch_id is not None:
        reader = reader.option("batchId", batch_id)
    return reader.load(checkpoint).withColumn("value", F.col("value").cast(_BUFFERS))


def _statistics(rows: DataFrame) -> DataFrame:
    value = F.col("value")
    values, n = value["values"], value["n"]
    return rows.withColumns(
        {
            "count": value["count"],
            "mean": value["sum"] / F.nullif(values, F.lit(0)),
            "populationVariance": value["m2"] / F.nullif(n, F.lit(0.0)),
            "min": F.when(F.isnan(value["max"]), F.lit(NAN)).otherwise(value["min"]),
            "max": value["max"],
        }
    )


def open_windows(spark: SparkSession, checkpoint: str, resolution: Resolution, batch_id: int | None = None) -> DataFrame:
    """Windows that still take records, from the checkpoint of a query of one resolution.

    Windowed records, and ``closesAt``: the event time (epoch ms) that closes the window. The state is that
    after the last finished micro-batch, or after ``batch_id``; reading it does not disturb a running query. Rows come from as
    many tasks as the query has state partitions.
    """
    rows = _statistics(_state(spark, checkpoint, batch_id))
    start = F.unix_millis("key.window.start")
    return rows.select(
        "key.identifier",
        start.alias("startTimestamp"),
        F.unix_millis("key.window.end").alias("endTimestamp"),
        *STATISTIC_COLUMNS,
        (start + F.lit(lifetime_ms(resolution))).alias("closesAt"),
    )


def all_open_windows(
    spark: SparkSession, checkpoint: str, resolutions: Sequence[Resolution], batch_id: int | None = None
) -> DataFrame:
    """The same from the one query of all resolutions, with ``resolution`` (its table) before the other columns."""
    rows = _statistics(_state(spark, checkpoint, batch_id))
    found = []
    for resolution in resolutions:
        closes = F.unix_millis("key._closes")
        start = closes - F.lit(lifetime_ms(resolution))
        found.append(
            F.when(
                F.col(f"key.{RESOLUTION}") == resolution.table,
                F.struct(start.alias("start"), (start + F.lit(resolution.size_ms)).alias("end"), closes.alias("closes")),
            )
        )
    rows = rows.withColumn("_window", F.coalesce(*found))
    return rows.select(
        f"key.{RESOLUTION}",
        "key.identifier",
        F.col("_window.start").alias("startTimestamp"),
        F.col("_window.end").alias("endTimestamp"),
        *STATISTIC_COLUMNS,
        F.col("_window.closes").alias("closesAt"),
    )
