"""Small inputs and plan inspection."""

from __future__ import annotations

import math

from wattline.schemas import AGGREGATED_POWER, RAW_POWER


def raw_rows(spark, rows):
    return spark.createDataFrame(rows, RAW_POWER)


def aggregated_rows(spark, rows):
    return spark.createDataFrame(rows, AGGREGATED_POWER)


def in_time_order(spark, values, identifier="s"):
    return raw_rows(spark, [(identifier, i, v) for i, v in enumerate(values)])


def same(a, b, tolerance=0.0):
    if math.isnan(a) or math.isnan(b):
        return math.isnan(a) and math.isnan(b)
    return a == b or abs(a - b) <= tolerance


def plan(rows) -> str:
    return rows._jdf.queryExecution().executedPlan().toString()


def skewed(spark, n=30_000, others=200):
    """A third of all rows belongs to one identifier; times are unique per identifier."""
    from pyspark.sql import functions as F

    rows = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot"))
        .otherwise(F.concat(F.lit("s"), (F.col("id") % others).cast("string")))
        .alias("identifier"),
        (F.col("id") * 61_000).alias("timestamp"),
        ((F.col("id") * 7919) % 1000 / F.lit(8.0)).alias("valueInW"),
    )
    return rows
