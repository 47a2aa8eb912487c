"""A queryable time series: records plus the columns the query operators work on."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattline.restriction import UNRESTRICTED, TimeRestriction


@dataclass(frozen=True, eq=False)
class Series:
    """Records keyed by (identifier, time); like a keyed table, one record per key.

    ``value`` is the column (or Column expression) that trend and distribution use.
    """

    records: DataFrame
    time: str
    value: str | Column
    identifier: str = "identifier"

    @classmethod
    def raw(cls, records: DataFrame) -> Series:
        return cls(records, "timestamp", "valueInW")

    @classmethod
    def aggregated(cls, records: DataFrame) -> Series:
        """A group's value is its sum, not its average."""
        return cls(records, "timestamp", "sumInW")

    @classmethod
    def windowed(cls, records: DataFrame) -> Series:
        return cls(records, "startTimestamp", "mean")

    @property
    def value_column(self) -> Column:
        return F.col(self.value) if isinstance(self.value, str) else self.value

    def restricted(
        self,
        restriction: TimeRestriction = UNRESTRICTED,
        identifiers: str | Sequence[str] | None = None,
    ) -> DataFrame:
        """Matching records, unordered. Both filters are on stored columns and reach the scan.

        Records without identifier or time belong to no series and are left out of every query.
        """
        rows = self.records.filter(F.col(self.identifier).isNotNull() & F.col(self.time).isNotNull())
        if isinstance(identifiers, str):
            rows = rows.filter(F.col(self.identifier) == identifiers)
        elif identifiers is not None:
            rows = rows.filter(F.col(self.identifier).isin(list(identifiers)))
        if restriction != UNRESTRICTED:
            rows = rows.filter(restriction.to_column(self.time))
        return rows

    def values(
        self,
        restriction: TimeRestriction = UNRESTRICTED,
        identifiers: str | Sequence[str] | None = None,
    ) -> DataFrame:
        """Matching records cut down to (identifier, time, value)."""
        return self.restricted(restriction, identifiers).select(
            F.col(self.identifier).alias("identifier"),
            F.col(self.time).alias("time"),
            self.value_column.alias("value"),
        )
