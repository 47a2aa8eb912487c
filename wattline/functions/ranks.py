"""Ranks of values among quantiles: shares of about the same size whatever the distribution."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quantile_borders(rows: DataFrame, column: str, shares: int, *, frequent_alone: bool = False) -> list:
    """At most ``shares`` - 1 distinct values that cut a number or timestamp column into equal shares; nulls do not count.

    With ``frequent_alone`` a whole number that fills more than a share gets a share of its own, by up to half as many borders more.
    """
    steps = [i / shares for i in range(1, shares)]
    borders = rows.agg(F.percentile_approx(F.col(column), steps, 100 * shares)).first()[0] if steps else None
    borders = borders or []
    frequent = {value + 1 for value, n in Counter(borders).items() if n > 1} if frequent_alone else set()
    return sorted({*borders, *frequent})


def rank_among(value: Column, borders: list, first: int = 0) -> Column:
    """How many borders are at or below a value, as a tree of comparisons; that of a null is the largest."""
    if not borders:
        return F.lit(first)
    middle = len(borders) // 2
    below, above = borders[:middle], borders[middle + 1 :]
    return F.when(value < F.lit(borders[middle]), rank_among(value, below, first)).otherwise(
        rank_among(value, above, first + middle + 1)
    )
