"""All resolutions from one pass over the inputs.

Each record is copied to its window of every resolution, and one shuffle by (identifier, resolution, window) serves all
of them; counting begins before the shuffle, so that a hot sensor reaches it as one row per window and task.

A window closes when event time reaches ``max(24 h, size)`` after its start, which differs between resolutions, but a query has
one watermark for all. So the watermark runs on the *closing times* of windows: a window's own one, and, in a row of no
resolution, the event time plus the longest of these spans. The watermark follows the largest closing time by that span, hence it is
the largest event time, and Spark drops and forgets a window exactly when its closing time is reached.

Against one query per resolution: inputs are read, decoded and checkpointed once, and all resolutions see the same
micro-batches; a failure stops all of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.operators.quality import MAX_TIME_MS
from wattline.operators.windows import STATISTIC_COLUMNS, statistics
from wattline.resolution import Resolution

RESOLUTION = "resolution"
_CLOSES = "_closes"


def lifetime_ms(resolution: Resolution) -> int:
    """How long after its start a window takes records."""
    return resolution.size_ms + resolution.watermark_delay_ms


def fanned_out(combined: DataFrame, resolutions: Sequence[Resolution], value: str = "valueInW") -> DataFrame:
    """identifier, resolution (its table), closing time and value: a row per record and resolution, and one for the clock."""
    time = F.col("timestamp")
    longest = max(map(lifetime_ms, resolutions))
    rows = [F.struct(F.lit(None).cast("string").alias(RESOLUTION), (time + F.lit(longest)).alias("closesMs"))]
    for resolution in resolutions:
        start = time - F.pmod(time, F.lit(resolution.size_ms))
        closes = (start + F.lit(lifetime_ms(resolution))).alias("closesMs")
        rows.append(F.struct(F.lit(resolution.table).alias(RESOLUTION), closes))
    copies = combined.select("identifier", F.col(value).alias("value"), F.explode(F.array(*rows)).alias("copy"))
    return copies.select("identifier", "value", f"copy.{RESOLUTION}", F.timestamp_millis("copy.closesMs").alias(_CLOSES))


def all_windows(combined: DataFrame, resolutions: Sequence[Resolution], value: str = "valueInW") -> DataFrame:
    """``resolution`` (its table) and the columns of a windowed record, for a stream or a batch.

    ``combined`` has identifier, timestamp (epoch ms) and the value. Times whose closing times exceed what a
    timestamp can hold (they are in the year 294247) belong to no window.
    """
    tables = [resolution.table for resolution in resolutions]
    if len(set(tables)) != len(tables):
        raise ValueError("Resolutions need different tables.")
    longest = max(map(lifetime_ms, resolutions))
    usable = F.col("identifier").isNotNull() & (F.col("timestamp") <= F.lit(MAX_TIME_MS - longest))
    rows = fanned_out(combined.filter(usable), resolutions, value)
    rows = rows.withWatermark(_CLOSES, f"{longest} milliseconds")
    # After the clock has seen them. The second half is always true; it keeps this filter from moving below the clock.
    rows = rows.filter(F.col(RESOLUTION).isNotNull() & F.col(_CLOSES).isNotNull())
    found = rows.groupBy("identifier", RESOLUTION, _CLOSES).agg(*statistics("value"))
    sizes = F.create_map(*(F.lit(x) for r in resolutions for x in (r.table, r.size_ms)))
    lifetimes = F.create_map(*(F.lit(x) for r in resolutions for x in (r.table, lifetime_ms(r))))
    start = F.unix_millis(_CLOSES) - F.element_at(lifetimes, F.col(RESOLUTION)).cast("long")
    return found.select(
        RESOLUTION,
        "identifier",
        start.alias("startTimestamp"),
        (start + F.element_at(sizes, F.col(RESOLUTION)).cast("long")).alias("endTimestamp"),
        *STATISTIC_COLUMNS,
    )
