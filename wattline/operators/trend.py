"""Growth of a series between its two ends."""

from __future__ import annotations

import logging
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from wattline.functions.numeric import growth_ratio
from wattline.operators.ends import RANKED_LIMIT, outermost, running_before, time_bucket
from wattline.operators.ranges import named
from wattline.restriction import UNRESTRICTED, TimeRestriction
from wattline.series import Series

LOGGER = logging.getLogger(__name__)

NO_TREND = -1.0

# The observed metrics that tell how many of the identifiers asked for have no records.
OBSERVED = "trendWithoutRecords"


def trend(
    series: Series,
    restriction: TimeRestriction = UNRESTRICTED,
    points_to_smooth: int = 10,
    identifiers: str | Sequence[str] | None = None,
    observation: Observation | None = None,
) -> DataFrame:
    """Mean of the newest over mean of the oldest records, per identifier.

    The two groups hold up to ``points_to_smooth`` records each and may overlap. A start that
    is not positive gives 1; an identifier asked for by name but without records gives -1 and is
    counted in the observed metric ``OBSERVED``, for a listener to warn about, or in ``observation``, for
    ``warn_of_missing`` after the result has been used.
    """
    rows = series.values(restriction, identifiers)
    trends = _ends_of(rows, points_to_smooth).select(
        "identifier", growth_ratio(F.col("start"), F.col("end")).alias("trend")
    )
    if identifiers is None:
        return trends
    asked = named(series, identifiers).join(trends, "identifier", "left")
    asked = asked.observe(observation or OBSERVED, F.count_if(F.col("trend").isNull()).alias("identifiers"))
    return asked.select("identifier", F.coalesce("trend", F.lit(NO_TREND)).alias("trend"))


def warn_of_missing(observation: Observation) -> int:
    """Warn about identifiers without records, once the trend that ``observation`` was given to has run; returns their number."""
    missing = observation.get["identifiers"]
    if missing:
        LOGGER.warning("No trend for %d identifiers without records.", missing)
    return missing


def _ends_of(rows: DataFrame, n: int) -> DataFrame:
    """Mean of the oldest (start) and of the newest (end) ``n`` values per identifier.

    Two scans, so that each can cut its input before the shuffle; the results are already
    distributed by identifier when they are joined. A single point needs one aggregate only.
    """
    if n == 1:
        return rows.groupBy("identifier").agg(
            F.min_by("value", "time").alias("start"), F.max_by("value", "time").alias("end")
        )
    if n > RANKED_LIMIT:
        return _ends_by_buckets(rows, n)
    start = _mean_of_end(rows, n, newest=False, name="start")
    return start.join(_mean_of_end(rows, n, newest=True, name="end"), "identifier")


def _mean_of_end(rows: DataFrame, n: int, *, newest: bool, name: str) -> DataFrame:
    return (
        outermost(rows, "identifier", "time", n, newest=newest)
        .groupBy("identifier")
        .agg(F.avg("value").alias(name))
    )


def _ends_by_buckets(rows: DataFrame, n: int) -> DataFrame:
    """Both means from one aggregate per identifier and time bucket, and a scan of the buckets that are cut.

    Buckets whose records all belong to an end contribute their sums; only of the bucket in which
    the n-th record lies, at most one per identifier and end, are records looked at again.
    """
    bucketed = rows.withColumn("_bucket", time_bucket("time"))
    sizes = bucketed.groupBy("identifier", "_bucket").agg(
        F.count("*").alias("_size"), F.sum("value").alias("_sum"), F.count("value").alias("_values")
    )
    sides = {"start": False, "end": True}
    placed = sizes.withColumns({f"_before_{s}": running_before("identifier", "_size", newest) for s, newest in sides.items()})

    def whole(side: str) -> Column:
        return F.col(f"_before_{side}") + F.col("_size") <= F.lit(n)

    def cut(side: str) -> Column:
        return (F.col(f"_before_{side}") < F.lit(n)) & ~whole(side)

    # One row per identifier with the sums of whole buckets and the buckets to look into again, so
    # that the aggregate above is used in one place.
    facts = placed.groupBy("identifier").agg(
        *(F.sum(F.when(whole(s), F.col("_sum"))).alias(f"_sum_{s}") for s in sides),
        *(F.sum(F.when(whole(s), F.col("_values"))).alias(f"_values_{s}") for s in sides),
        *(F.max(F.when(cut(s), F.col("_bucket"))).alias(f"_cut_{s}") for s in sides),
        *(F.max(F.when(cut(s), F.lit(n) - F.col(f"_before_{s}"))).alias(f"_quota_{s}") for s in sides),
    )
    cuts = F.array_distinct(F.array_compact(F.array(*(f"_cut_{s}" for s in sides))))
    again = facts.withColumn("_bucket", F.explode_outer(cuts)).join(bucketed, ["identifier", "_bucket"], "left")
    in_bucket = Window.partitionBy("identifier", "_bucket")
    ranked = again.withColumns(
        {
            "_rank_start": F.row_number().over(in_bucket.orderBy("time")),
            "_rank_end": F.row_number().over(in_bucket.orderBy(F.col("time").desc())),
        }
    )
    taken = {
        s: F.when((F.col("_bucket") == F.col(f"_cut_{s}")) & (F.col(f"_rank_{s}") <= F.col(f"_quota_{s}")), F.col("value"))
        for s in sides
    }
    edges = ranked.groupBy("identifier").agg(
        *(F.any_value(f"_{what}_{s}").alias(f"_{what}_{s}") for s in sides for what in ("sum", "values")),
        *(F.sum(taken[s]).alias(f"_edge_{s}") for s in sides),
        *(F.count(taken[s]).alias(f"_edges_{s}") for s in sides),
    )

    def mean(side: str) -> Column:
        total = F.coalesce(f"_sum_{side}", F.lit(0.0)) + F.coalesce(f"_edge_{side}", F.lit(0.0))
        number = F.coalesce(f"_values_{side}", F.lit(0)) + F.coalesce(f"_edges_{side}", F.lit(0))
        return F.when(number > 0, total / number).alias(side)

    return edges.select("identifier", *map(mean, sides))
