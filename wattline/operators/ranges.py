"""Scans, identifier lists and counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.restriction import UNRESTRICTED, TimeRestriction
from wattline.series import Series


def identifiers(series: Series) -> DataFrame:
    """Every identifier that has a record."""
    return series.restricted().select(F.col(series.identifier).alias("identifier")).distinct()


def records(
    series: Series,
    restriction: TimeRestriction = UNRESTRICTED,
    identifiers: str | Sequence[str] | None = None,
    *,
    ordered: bool = False,
) -> DataFrame:
    """Records in range; ``ordered`` sorts by (identifier, time).

    Sorting on both columns lets Spark range-partition inside an identifier, so a hot one is
    still sorted by many tasks.
    """
    rows = series.restricted(restriction, identifiers)
    return rows.orderBy(series.identifier, series.time) if ordered else rows


def count(
    series: Series,
    restriction: TimeRestriction = UNRESTRICTED,
    identifiers: str | Sequence[str] | None = None,
) -> DataFrame:
    """Records in range per identifier; identifiers asked for by name but without records give 0."""
    counts = (
        series.restricted(restriction, identifiers)
        .groupBy(F.col(series.identifier).alias("identifier"))
        .agg(F.count("*").alias("count"))
    )
    if identifiers is None:
        return counts
    return named(series, identifiers).join(counts, "identifier", "left").select(
        "identifier", F.coalesce("count", F.lit(0).cast("long")).alias("count")
    )


def total_count(series: Series) -> DataFrame:
    """All records, as one row."""
    return series.restricted().agg(F.count("*").alias("count"))


def named(series: Series, identifiers: str | Sequence[str]) -> DataFrame:
    """The identifiers a caller asked for, one row each."""
    names = [identifiers] if isinstance(identifiers, str) else list(dict.fromkeys(identifiers))
    return series.records.sparkSession.createDataFrame([(n,) for n in names], "identifier string")
