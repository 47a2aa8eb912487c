"""Equi-width histogram of the values of every identifier."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattline.errors import InvalidQueryError
from wattline.functions.numeric import bucket_index, nan_aware_min
from wattline.operators.per_identifier import BROADCAST_LIMIT_BYTES, durable, join_facts
from wattline.restriction import UNRESTRICTED, TimeRestriction
from wattline.series import Series
from wattline.session import new_work_dir

# Up to this many buckets, counters are columns of one aggregate; beyond, rows of their own.
WIDE_LIMIT = 32


def distribution(
    series: Series,
    restriction: TimeRestriction = UNRESTRICTED,
    buckets: int = 4,
    identifiers: str | Sequence[str] | None = None,
    *,
    limit_bytes: int = BROADCAST_LIMIT_BYTES,
    keep_values: bool = False,
) -> DataFrame:
    """Rows (identifier, bucket, lower, upper, elements), empty buckets included.

    ``keep_values`` writes (identifier, value) to shared storage between the passes: right where
    the series is itself the result of a shuffle, as windows and resolved versions are.

    Two passes over (identifier, value): the value range per identifier, then the counts. The
    ranges are joined back by ``join_facts``, so rows are normally not shuffled before they
    are counted, and counting starts inside each task.
    """
    if buckets <= 0:
        raise InvalidQueryError(f"The number of buckets must be positive, got {buckets}.")
    rows = series.values(restriction, identifiers).select("identifier", "value")
    if keep_values:
        path = new_work_dir(rows.sparkSession, "values")
        rows.write.parquet(path)
        rows = rows.sparkSession.read.schema(rows.schema).parquet(path)
    ranges = durable(
        value_ranges(rows).select(
            "identifier", "low", ((F.col("high") - F.col("low")) / F.lit(buckets)).alias("width"), "rows"
        )
    )
    facts = ranges.select("identifier", "low", "width")
    totals = ranges.select("identifier", "rows")
    placed = join_facts(rows, facts, totals, limit_bytes=limit_bytes).withColumn(
        "bucket", bucket_index(F.col("value"), F.col("low"), F.col("width"), buckets)
    )
    counted = _counted_wide(placed, buckets) if buckets <= WIDE_LIMIT else _counted_long(placed, facts, buckets)
    return _with_bounds(counted).select("identifier", "bucket", "lower", "upper", "elements")


def value_ranges(rows: DataFrame) -> DataFrame:
    """Smallest and largest value and number of rows per identifier; NaN counts as both."""
    return rows.groupBy("identifier").agg(
        nan_aware_min(F.col("value")).alias("low"), F.max("value").alias("high"), F.count("*").alias("rows")
    )


def _counted_wide(placed: DataFrame, buckets: int) -> DataFrame:
    """One counter column per bucket, unfolded into rows after the aggregation."""
    counters = [F.count_if(F.col("bucket") == i) for i in range(buckets)]
    return (
        placed.groupBy("identifier")
        .agg(
            F.any_value("low").alias("low"),
            F.any_value("width").alias("width"),
            *(c.alias(f"_{i}") for i, c in enumerate(counters)),
        )
        .select(
            "identifier",
            "low",
            "width",
            F.posexplode(F.array(*(f"_{i}" for i in range(buckets)))).alias("bucket", "elements"),
        )
    )


def _counted_long(placed: DataFrame, facts: DataFrame, buckets: int) -> DataFrame:
    """One row per occupied bucket, completed with the empty ones."""
    counts = placed.groupBy("identifier", "bucket").agg(F.count("*").alias("elements"))
    skeleton = facts.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    return skeleton.join(counts, ["identifier", "bucket"], "left").withColumn(
        "elements", F.coalesce("elements", F.lit(0))
    )


def _with_bounds(counted: DataFrame) -> DataFrame:
    """Adds lower and upper. Each bound adds one width to the one before it.

    The running sum adds in bucket order, so the rounding of repeated addition is kept and
    the last upper bound may differ from the maximum in its last bits.
    """
    in_order = Window.partitionBy("identifier").orderBy("bucket")
    step = F.when(F.col("bucket") == 0, F.col("low") + F.col("width")).otherwise(F.col("width"))
    so_far = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lower = F.when(F.col("bucket") == 0, F.col("low")).otherwise(F.lag("upper").over(in_order))
    return counted.withColumn("upper", F.sum(step).over(so_far)).withColumn("lower", lower)
