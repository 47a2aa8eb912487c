"""The newest or oldest records of every identifier."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattline.errors import InvalidQueryError
from wattline.restriction import UNRESTRICTED, TimeRestriction
from wattline.series import Series

# Up to this many records per identifier, each task first cuts its own input down to that
# many, and the final ranking sees at most RANKED_LIMIT x tasks rows of one identifier.
RANKED_LIMIT = 100

# Above it, whole time buckets are selected first; records are unique per millisecond, so a
# bucket holds at most this many records of one identifier.
BUCKET_MS = 3_600_000


def latest(
    series: Series,
    restriction: TimeRestriction = UNRESTRICTED,
    count: int = 1,
    identifiers: str | Sequence[str] | None = None,
) -> DataFrame:
    """The ``count`` newest records in range of every identifier."""
    rows = series.restricted(restriction, identifiers)
    return outermost(rows, series.identifier, series.time, count, newest=True)


def earliest(
    series: Series,
    restriction: TimeRestriction = UNRESTRICTED,
    count: int = 1,
    identifiers: str | Sequence[str] | None = None,
) -> DataFrame:
    """The ``count`` oldest records in range of every identifier."""
    rows = series.restricted(restriction, identifiers)
    return outermost(rows, series.identifier, series.time, count, newest=False)


def newest_first(rows: DataFrame, series: Series) -> DataFrame:
    """Presentation order of ``latest``."""
    return rows.orderBy(F.col(series.identifier), F.col(series.time).desc())


def outermost(rows: DataFrame, identifier: str, time: str, n: int, *, newest: bool) -> DataFrame:
    """The ``n`` outermost rows per identifier; rows without identifier or time do not take part.

    The three ways differ in their plans only; none of them runs a job before the result is used.
    """
    if n <= 0:
        raise InvalidQueryError(f"The number of records must be positive, got {n}.")
    rows = rows.filter(F.col(identifier).isNotNull() & F.col(time).isNotNull())
    if n == 1:
        return _single(rows, identifier, time, newest)
    if n <= RANKED_LIMIT:
        return _ranked(rows, [identifier], _direction(time, newest), F.lit(n))
    return _by_buckets(rows, identifier, time, n, newest)


def _direction(time: str, newest: bool) -> Column:
    return F.col(time).desc() if newest else F.col(time).asc()


def _single(rows: DataFrame, identifier: str, time: str, newest: bool) -> DataFrame:
    """No ranking needed: a partial aggregate keeps one candidate per identifier and task."""
    extreme, at = (F.max, F.max_by) if newest else (F.min, F.min_by)
    others = [c for c in rows.columns if c not in (identifier, time)]
    return (
        rows.groupBy(identifier)
        .agg(extreme(time).alias(time), *(at(c, F.col(time)).alias(c) for c in others))
        .select(*rows.columns)
    )


def _ranked(rows: DataFrame, keys: list[str], order: Column, quota: Column) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return rows.withColumn("_rank", rank).filter(F.col("_rank") <= quota).select(*rows.columns)


def time_bucket(time: str) -> Column:
    return F.col(time) - F.pmod(F.col(time), F.lit(BUCKET_MS))


def running_before(identifier: str, size: str, newest: bool) -> Column:
    """Records of the identifier in buckets further out than this row's.

    The running sum sees one row per identifier and bucket, so its length is bounded by the time
    span of the data, not by its amount.
    """
    outward = Window.partitionBy(identifier).orderBy(_direction("_bucket", newest))
    return F.sum(size).over(outward.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col(size)


def _by_buckets(rows: DataFrame, identifier: str, time: str, n: int, newest: bool) -> DataFrame:
    """Exact for any ``n``, without ever ranking a whole identifier.

    Records are counted per identifier and time bucket; buckets that begin before n records are
    reached are wanted. Rows meet them on (identifier, bucket), of which none is large however hot
    the identifier. Buckets that end before n are kept whole, only the last one is ranked.
    """
    keyed = rows.withColumn("_identifier", F.col(identifier)).withColumn("_bucket", time_bucket(time))
    sizes = keyed.groupBy("_identifier", "_bucket").agg(F.count("*").alias("_size"))
    wanted = sizes.withColumn("_beyond", running_before("_identifier", "_size", newest)).filter(
        F.col("_beyond") < F.lit(n)
    )
    placed = keyed.join(
        wanted.select("_identifier", "_bucket", (F.lit(n) - F.col("_beyond")).alias("_quota"), "_size"),
        ["_identifier", "_bucket"],
    )
    # Already distributed by (identifier, bucket): ranking inside a bucket needs no other shuffle.
    rank = F.row_number().over(Window.partitionBy("_identifier", "_bucket").orderBy(_direction(time, newest)))
    whole = placed.filter(F.col("_size") <= F.col("_quota"))
    cut = placed.filter(F.col("_size") > F.col("_quota")).withColumn("_rank", rank)
    cut = cut.filter(F.col("_rank") <= F.col("_quota"))
    return whole.select(*rows.columns).unionByName(cut.select(*rows.columns))
