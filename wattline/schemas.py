"""Record schemas. All timestamps are epoch milliseconds kept as BIGINT."""

from pyspark.sql import types as T

# Names and types of the fields are a public contract.
RAW_POWER = T.StructType(
    [
        T.StructField("identifier", T.StringType()),
        T.StructField("timestamp", T.LongType()),
        T.StructField("valueInW", T.DoubleType()),
    ]
)

AGGREGATED_POWER = T.StructType(
    [
        T.StructField("identifier", T.StringType()),
        T.StructField("timestamp", T.LongType()),
        T.StructField("count", T.LongType()),
        T.StructField("sumInW", T.DoubleType()),
        T.StructField("averageInW", T.DoubleType()),
    ]
)

WINDOWED_POWER = T.StructType(
    [
        T.StructField("identifier", T.StringType()),
        T.StructField("startTimestamp", T.LongType()),
        T.StructField("endTimestamp", T.LongType()),
        T.StructField("count", T.LongType()),
        T.StructField("mean", T.DoubleType()),
        T.StructField("populationVariance", T.DoubleType()),
        T.StructField("min", T.DoubleType()),
        T.StructField("max", T.DoubleType()),
    ]
)

# Our own: records received per identifier and micro-batch.
RECEIVED = T.StructType(
    [
        T.StructField("identifier", T.StringType()),
        T.StructField("batch", T.LongType()),
        T.StructField("received", T.LongType()),
    ]
)
