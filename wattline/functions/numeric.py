"""Column expressions whose NaN, infinity and zero behaviour follows IEEE comparisons.

Spark orders NaN above every number and, under ANSI mode, raises on x/0 and on casting
NaN to an integer; these guards keep such inputs defined instead.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")
INFINITY = float("inf")


def is_positive(value: Column) -> Column:
    """``value > 0``, false for NaN."""
    return (value > F.lit(0.0)) & ~F.isnan(value)


def nan_aware_min(value: Column) -> Column:
    """Aggregate minimum that is NaN as soon as one input is (Spark's ``max`` already is)."""
    return F.when(F.isnan(F.max(value)), F.lit(NAN)).otherwise(F.min(value))


def growth_ratio(start: Column, end: Column) -> Column:
    """``end / start`` where start is positive, else 1."""
    return F.when(is_positive(start), end / start).otherwise(F.lit(1.0))


def bucket_index(value: Column, low: Column, width: Column, buckets: int) -> Column:
    """Position of ``value`` among equal slices starting at ``low``, at most ``buckets - 1``.

    A width of NaN or infinity puts everything into slice 0. A zero width leaves values at
    ``low`` in slice 0 and pushes larger ones (the width underflowed) into the last slice.
    """
    usable = is_positive(width) & (width < F.lit(INFINITY))
    # The inner `when` keeps the division undefined-free however the branch is evaluated.
    position = (value - low) / F.when(usable, width)
    return (
        F.when(usable, F.least(position, F.lit(float(buckets - 1))).cast("int"))
        .when((width == F.lit(0.0)) & (value > low), F.lit(buckets - 1))
        .otherwise(F.lit(0))
    )
