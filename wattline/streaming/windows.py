"""Tumbling-window statistics on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.operators.windows import STATISTIC_COLUMNS, statistics
from wattline.resolution import Resolution


def windowed_stream(
    combined: DataFrame,
    resolution: Resolution,
    *,
    key: str = "identifier",
    event_time: str = "timestamp",
    value: str = "valueInW",
) -> DataFrame:
    """Updates of the windows of one resolution, in the shape of the batch operator.

    The watermark sits on the combined stream, so one clock covers both inputs. Spark advances
    it between micro-batches, hence a record is never dropped within the batch it arrives in.
    """
    return (
        combined.filter(F.col(key).isNotNull())
        .withColumn("_eventTime", F.timestamp_millis(F.col(event_time)))
        .withWatermark("_eventTime", f"{resolution.watermark_delay_ms} milliseconds")
        .groupBy(
            F.col(key).alias("identifier"),
            F.window("_eventTime", f"{resolution.size_ms} milliseconds").alias("_window"),
        )
        .agg(*statistics(value))
        .select(
            "identifier",
            F.unix_millis("_window.start").alias("startTimestamp"),
            F.unix_millis("_window.end").alias("endTimestamp"),
            *STATISTIC_COLUMNS,
        )
    )
