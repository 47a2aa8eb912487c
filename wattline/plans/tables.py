"""Test tables as power series.

    events    identifier = user, time = ts, value = value, arrival = event_id
              or, for dense windows, identifier = event type
    grouped   events summed per type and hour, as sensor-group records
    lineitem  identifier = supplier, time = ship date, value = extended price; keys collide;
              arrival = order, line and price in one number
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattline.restriction import UNRESTRICTED, TimeRestriction

HOUR_MS = 3_600_000
DAY_MS = 86_400_000

EVENTS_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
    ]
)

LINEITEM_ARRIVAL = "arrival"


def epoch_ms(ts: Column) -> Column:
    """Wall-clock timestamps are UTC in the test data; the session time zone must be too."""
    return F.unix_millis(ts.cast("timestamp"))


def single_precision(value: Column) -> Column:
    return value.cast("float").cast("double")


def use_utc(spark: SparkSession) -> None:
    """Wall-clock times of the tables are UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def _instant(ms: int) -> Column:
    return F.timestamp_millis(F.lit(ms)).cast("timestamp_ntz")


def in_native_time(rows: DataFrame, ts: str, restriction: TimeRestriction) -> DataFrame:
    """The restriction on the stored timestamp, which the scan can evaluate.

    Equal to comparing its epoch ms rounded down, so it never changes what a query returns.
    """
    column = F.col(ts)
    if restriction.from_ is not None:
        rows = rows.filter(column >= _instant(restriction.from_))
    if restriction.after is not None:
        rows = rows.filter(column >= _instant(restriction.after + 1))
    if restriction.to is not None:
        rows = rows.filter(column < _instant(restriction.to + 1))
    return rows


def raw_from_events(events: DataFrame, identifier: str = "user_id") -> DataFrame:
    return events.select(
        F.col(identifier).cast("string").alias("identifier"),
        epoch_ms(F.col("ts")).alias("timestamp"),
        F.col("value").alias("valueInW"),
        F.col("event_id").alias("arrival"),
    )


def events_raw(
    spark: SparkSession,
    sf_dir: str,
    restriction: TimeRestriction = UNRESTRICTED,
    identifier: str = "user_id",
) -> DataFrame:
    use_utc(spark)
    events = in_native_time(spark.read.parquet(f"{sf_dir}/events.parquet"), "ts", restriction)
    return raw_from_events(events, identifier).drop("arrival")


def events_stream(spark: SparkSession, sf_dir: str, identifier: str = "user_id") -> DataFrame:
    """The events file as a file stream."""
    from wattline.sources.readers import file_stream

    use_utc(spark)
    return raw_from_events(file_stream(spark, sf_dir, EVENTS_SCHEMA, glob="events.parquet"), identifier)


def events_grouped(spark: SparkSession, sf_dir: str, restriction: TimeRestriction = UNRESTRICTED) -> DataFrame:
    """Hourly sums per event type, as a given input: stored records have fixed values.

    Their last bits depend on the order of rows. Values have two decimals, so rounding to six
    recovers the exact sum; the average, which no query computes with, is cut to single precision.
    """
    rows = events_raw(spark, sf_dir, identifier="event_type")
    hour = (F.col("timestamp") - F.pmod(F.col("timestamp"), F.lit(HOUR_MS))).alias("timestamp")
    grouped = rows.groupBy("identifier", hour).agg(
        F.count("*").alias("count"),
        F.round(F.sum("valueInW"), 6).alias("sumInW"),
        single_precision(F.avg("valueInW")).alias("averageInW"),
    )
    return grouped if restriction == UNRESTRICTED else grouped.filter(restriction.to_column("timestamp"))


def lineitem_raw(spark: SparkSession, sf_dir: str, arrival: bool = False) -> DataFrame:
    """Line items as measurements; ``arrival`` adds the number that orders them."""
    number = (F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 100_000_000 + F.round(F.col("l_extendedprice") * 100)
    use_utc(spark)
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return lines.select(
        F.col("l_suppkey").cast("string").alias("identifier"),
        epoch_ms(F.col("l_shipdate")).alias("timestamp"),
        F.col("l_extendedprice").alias("valueInW"),
        *([number.cast("long").alias(LINEITEM_ARRIVAL)] if arrival else ()),
    )
