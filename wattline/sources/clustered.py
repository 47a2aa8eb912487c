"""A stored series laid out for lookups by identifier and time.

Rows are ordered along a curve that interleaves the bits of two coordinates, the ranks of the identifier's digest and of
the time, and written as files of consecutive stretches of it. A file then holds few identifiers *and* a short span
of time, so that both filters skip files and row groups by their smallest and largest values; inside, rows are sorted
by identifier and time, and a Bloom filter on the identifier tells in which row groups one cannot be. Ranks are among
quantiles, and an identifier that fills more than one of them has a rank of its own: it is spread over as many files
as its share asks for, and is not in the way of others.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattline.functions.ranks import quantile_borders, rank_among
from wattline.restriction import UNRESTRICTED, TimeRestriction
from wattline.series import Series

#: Bits of each coordinate: 65,536 cells along the curve.
BITS = 8
ROW_GROUP_BYTES = 32 * 1024 * 1024
ROWS_PER_FILE = 10_000_000
#: Kept beside the identifier, because the order along the curve is that of digests.
DIGEST = "identifierDigest"


def interleaved(high: Column, low: Column, bits: int = BITS) -> Column:
    """Bits of two numbers below 2^bits in turn, the first number's before the second's."""
    total = F.lit(0)
    for bit in range(bits):
        for shift, value in ((2 * bit + 1, high), (2 * bit, low)):
            total = total + F.shiftleft(F.shiftright(value, bit).bitwiseAND(F.lit(1)), shift)
    return total


def digest(identifier: Column) -> Column:
    return F.xxhash64(identifier)


class ClusteredStore:
    """A series with (identifier, ``time``) in a folder of its own, written as a whole."""

    def __init__(self, path: str, schema: T.StructType, time: str = "timestamp") -> None:
        self.path, self.schema, self.time = path.rstrip("/"), schema, time

    def write(
        self, rows: DataFrame, *, files: int | None = None, row_group_bytes: int = ROW_GROUP_BYTES, distinct: int = 100_000
    ) -> None:
        """Replace the stored rows. ``distinct`` is about how many identifiers a row group may hold."""
        rows = rows.select(*self.schema.names)
        total = rows.count() if files is None else 0
        files = files or max(1, -(-total // ROWS_PER_FILE))
        with_digest = rows.withColumn(DIGEST, digest(F.col("identifier")))
        times = quantile_borders(rows, self.time, 2**BITS)
        # Half the ranks, so that there is room for the borders of frequent identifiers.
        digests = quantile_borders(with_digest, DIGEST, 2 ** (BITS - 1), frequent_alone=True)
        curve = interleaved(rank_among(F.col(DIGEST), digests), rank_among(F.col(self.time), times))
        # The identifier and time split a cell that is too large for one file.
        ordered = with_digest.withColumn("_curve", curve)
        layout = ["_curve", DIGEST, "identifier", self.time]
        ordered.repartitionByRange(files, *layout).sortWithinPartitions(*layout).drop("_curve").write.mode("overwrite").options(
            **{
                "parquet.bloom.filter.enabled#identifier": "true",
                "parquet.bloom.filter.expected.ndv#identifier": str(distinct),
                "parquet.block.size": str(row_group_bytes),
            }
        ).parquet(self.path)

    def rows(
        self, spark: SparkSession, restriction: TimeRestriction = UNRESTRICTED, identifiers: str | Sequence[str] | None = None
    ) -> DataFrame:
        """Stored rows; the filters reach the scan, with the digests of the identifiers beside them."""
        stored = T.StructType([*self.schema.fields, T.StructField(DIGEST, T.LongType())])
        found = spark.read.schema(stored).parquet(self.path)
        if identifiers is not None:
            names = [identifiers] if isinstance(identifiers, str) else list(dict.fromkeys(identifiers))
            found = found.filter(F.col("identifier").isin(names))
            if names:
                # Digests as literals, which the scan can compare with a row group's range.
                digests = spark.range(1).select(*(digest(F.lit(n)).alias(str(i)) for i, n in enumerate(names))).first()
                found = found.filter(F.col(DIGEST).isin(list(digests)))
        if restriction != UNRESTRICTED:
            found = found.filter(restriction.to_column(self.time))
        return found.select(*self.schema.names)

    def series(
        self,
        spark: SparkSession,
        value: str,
        restriction: TimeRestriction = UNRESTRICTED,
        identifiers: str | Sequence[str] | None = None,
    ) -> Series:
        return Series(self.rows(spark, restriction, identifiers), self.time, value)
