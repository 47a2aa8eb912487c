"""Distributions from stored fine counts.

Values fall into fine cells, small near zero and of constant relative width beyond; for each identifier, period and cell the
number of values and the smallest and largest one are kept. A histogram of any number of buckets places whole cells: a cell whose
smallest and largest value fall into one bucket lies in it completely, because the bucket of a value never falls when
the value grows. Only cells that a border cuts, at most one per border, identifier and period, and only the periods
that a time restriction cuts, are looked up in the records again. The result equals ``distribution`` in every row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattline.errors import InvalidQueryError
from wattline.functions.numeric import INFINITY, bucket_index, nan_aware_min
from wattline.operators.distribution import _with_bounds
from wattline.operators.per_identifier import BROADCAST_LIMIT_BYTES, ROW_BYTES, durable, join_facts
from wattline.restriction import DAY_MS, UNRESTRICTED, TimeRestriction
from wattline.series import Series

#: Cells per factor e of the value.
FINENESS = 64
CELLS = "identifier string, period bigint, cell bigint, elements bigint, low double, high double"


def cell_of(value: Column) -> Column:
    """The number of a value's cell; it never falls when the value grows. NaN and infinities have cells of their own."""
    size = F.floor(F.log1p(F.abs(value)) * F.lit(float(FINENESS)))
    signed = F.when(value < 0, -size - 1).otherwise(size)
    odd = F.when(F.isnan(value), F.lit(2**40)).when(value == F.lit(INFINITY), F.lit(2**39))
    return odd.when(value == F.lit(-INFINITY), F.lit(-(2**39))).otherwise(signed).cast("long")


def _period(time: Column, period_ms: int) -> Column:
    return F.call_function("div", time - F.pmod(time, F.lit(period_ms)), F.lit(period_ms))


def fine_counts(series: Series, period_ms: int = DAY_MS) -> DataFrame:
    """The cells of a series, to be stored; one aggregate, which begins in each task. Null values are one cell without range."""
    rows = series.values()
    return rows.groupBy("identifier", _period(F.col("time"), period_ms).alias("period"), cell_of(F.col("value")).alias("cell")).agg(
        F.count("*").alias("elements"), nan_aware_min(F.col("value")).alias("low"), F.max("value").alias("high")
    )


def merged_counts(cells: DataFrame) -> DataFrame:
    """Cells of several stores of disjoint records as one."""
    return cells.groupBy("identifier", "period", "cell").agg(
        F.sum("elements").alias("elements"), nan_aware_min(F.col("low")).alias("low"), F.max("high").alias("high")
    )


def refined_distribution(
    series: Series,
    cells: DataFrame,
    restriction: TimeRestriction = UNRESTRICTED,
    buckets: int = 4,
    identifiers: str | Sequence[str] | None = None,
    *,
    period_ms: int = DAY_MS,
    limit_bytes: int = BROADCAST_LIMIT_BYTES,
) -> DataFrame:
    """Rows (identifier, bucket, lower, upper, elements) as ``distribution``, from the stored ``cells`` of ``series``.

    ``series`` is read for what the cells leave open: a semi join with the cut cells, which are broadcast if their real
    size allows, and the periods that the restriction cuts, which reach the scan as time bounds.
    """
    if buckets <= 0:
        raise InvalidQueryError(f"The number of buckets must be positive, got {buckets}.")
    first, last = _whole_periods(restriction, period_ms)
    if identifiers is not None:
        cells = cells.filter(F.col("identifier").isin([identifiers] if isinstance(identifiers, str) else list(identifiers)))
    within = F.lit(True)
    if first is not None:
        within = within & (F.col("period") >= first)
    if last is not None:
        within = within & (F.col("period") <= last)
    known = cells.filter(within).select("identifier", "period", "cell", "elements", "low", "high")
    edges = _edges(series, restriction, identifiers, first, last, period_ms)
    every = known if edges is None else known.unionByName(edges)
    every = durable(every)
    ranges = every.groupBy("identifier").agg(
        nan_aware_min(F.col("low")).alias("_low"), F.max("high").alias("_high"), F.sum("elements").alias("rows")
    )
    ranges = durable(
        ranges.select("identifier", F.col("_low").alias("least"), ((F.col("_high") - F.col("_low")) / F.lit(buckets)).alias("width"), "rows")
    )
    facts, totals = ranges.select("identifier", "least", "width"), ranges.select("identifier", "rows")

    def bucket(value: str) -> Column:
        return bucket_index(F.col(value), F.col("least"), F.col("width"), buckets)

    placed = durable(join_facts(every, facts, totals, limit_bytes=limit_bytes).withColumns({"from": bucket("low"), "to": bucket("high")}))
    whole = placed.filter(F.col("from") == F.col("to")).select("identifier", F.col("from").alias("bucket"), "elements")
    cut = durable(placed.filter(F.col("from") != F.col("to")).select("identifier", "period", "cell", "least", "width"))
    rows = series.values(restriction, identifiers).select(
        "identifier", "value", _period(F.col("time"), period_ms).alias("period"), cell_of(F.col("value")).alias("cell")
    )
    size = cut.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length("identifier")), F.lit(0)).alias("bytes")).first()
    side = F.broadcast(cut) if size["rows"] * ROW_BYTES + size["bytes"] <= limit_bytes else cut
    split = rows.join(side, ["identifier", "period", "cell"]).select(
        "identifier", bucket("value").alias("bucket"), F.lit(1).cast("long").alias("elements")
    )
    counts = whole.unionByName(split).groupBy("identifier", "bucket").agg(F.sum("elements").alias("elements"))
    skeleton = facts.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1)))).withColumnRenamed("least", "low")
    counted = skeleton.join(counts, ["identifier", "bucket"], "left").withColumn("elements", F.coalesce("elements", F.lit(0).cast("long")))
    return _with_bounds(counted).select("identifier", "bucket", "lower", "upper", "elements")


def _whole_periods(restriction: TimeRestriction, period_ms: int) -> tuple[int | None, int | None]:
    """First and last period that lie in the restriction as a whole; None where it is open."""
    lower = [b for b in (restriction.from_, None if restriction.after is None else restriction.after + 1) if b is not None]
    first = -(-max(lower) // period_ms) if lower else None
    last = None if restriction.to is None else (restriction.to + 1) // period_ms - 1
    return first, last


def _edges(series, restriction, identifiers, first, last, period_ms) -> DataFrame | None:
    """Cells of the records in the periods that the restriction cuts; None if it cuts none."""
    time = F.col(series.time)
    outside = []
    if first is not None:
        outside.append(time < F.lit(first * period_ms))
    if last is not None:
        outside.append(time >= F.lit((last + 1) * period_ms))
    if not outside:
        return None
    predicate = outside[0] if len(outside) == 1 else outside[0] | outside[1]
    rows = series.restricted(restriction, identifiers).filter(predicate)
    return fine_counts(Series(rows, series.time, series.value, series.identifier), period_ms)
