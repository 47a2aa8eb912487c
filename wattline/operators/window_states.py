"""Window statistics as stored state that later records are merged into.

A state is ``struct<count, mean, m2, min, max>``: m2 is the sum of squared differences to the mean. States of disjoint
sets of records merge exactly (Chan, Golub and LeVeque):

    mean = a + sum n_i (mean_i - a) / sum n_i      m2 = sum m2_i + sum n_i (mean_i - mean)^2

where a is one of the means, so that nothing cancels however far the values are from zero. Windows of old and new
records therefore follow from old states and the states of the new records alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wattline.errors import InvalidQueryError
from wattline.functions.numeric import INFINITY, NAN, nan_aware_min
from wattline.operators.windows import STATISTIC_COLUMNS
from wattline.sources import folders

KEYS = ("identifier", "startTimestamp")
STATE = "struct<count: bigint, mean: double, m2: double, min: double, max: double>"
STORED = "identifier string, startTimestamp bigint, " + ", ".join(
    f.replace(":", "") for f in STATE.removeprefix("struct<").removesuffix(">").split(", ")
)


def _state(count: Column, mean: Column, m2: Column, low: Column, high: Column) -> Column:
    values = {"count": count, "mean": mean, "m2": m2, "min": low, "max": high}
    return F.struct(*(column.alias(name) for name, column in values.items())).cast(STATE).alias("state")


def window_states(
    records: DataFrame, size_ms: int, *, key: str = "identifier", time: str = "timestamp", value: str = "valueInW"
) -> DataFrame:
    """identifier, startTimestamp, state: one row per window of ``records``.

    As in ``tumbling_windows``, partial aggregation runs before the only exchange. A null value does not count, and a
    window of null values only has a count of 0 and no other statistics; NaN makes all but the count NaN.
    """
    start = (F.col(time) - F.pmod(F.col(time), F.lit(size_ms))).alias("startTimestamp")
    column = F.col(value)
    return (
        records.filter(F.col(key).isNotNull() & F.col(time).isNotNull())
        .groupBy(F.col(key).alias("identifier"), start)
        .agg(
            _state(
                F.count(column), F.avg(column), F.var_pop(column) * F.count(column), nan_aware_min(column), F.max(column)
            )
        )
    )


def merged_states(states: DataFrame) -> DataFrame:
    """One state per window from any number of states, each of other records than the others.

    One exchange by window. A window has as many states as batches that touched it, each counted once, so that a
    sensor with very many records is no heavier than the others.
    """
    window = Window.partitionBy(*KEYS)
    parts = states.select(*KEYS, "state.*")
    infinite = ~(F.abs("mean") < F.lit(INFINITY))  # NaN counts as larger than infinity
    parts = parts.withColumns(
        {
            "_anchor": F.min("mean").over(window),
            "_odd": F.coalesce(F.max(infinite).over(window), F.lit(False)),
            "_total": F.nullif(F.sum("count").over(window), F.lit(0)),
        }
    )
    near = F.col("_anchor") + F.sum(F.col("count") * (F.col("mean") - F.col("_anchor"))).over(window) / F.col("_total")
    far = F.sum(F.col("count") * F.col("mean")).over(window) / F.col("_total")  # with an infinity or NaN
    parts = parts.withColumn("_mean", F.when(F.col("_odd"), far).otherwise(near))
    between = F.col("count") * (F.col("mean") - F.col("_mean")) * (F.col("mean") - F.col("_mean"))
    m2 = F.when(F.max("_odd"), F.lit(NAN)).otherwise(F.sum(F.col("m2") + between))
    return parts.groupBy(*KEYS).agg(
        _state(F.sum("count"), F.max("_mean"), m2, nan_aware_min(F.col("min")), F.max("max"))
    )


def windows_of(states: DataFrame, size_ms: int) -> DataFrame:
    """Windowed records, as ``tumbling_windows`` gives them, from one state per window."""
    return states.select(
        *KEYS,
        (F.col("startTimestamp") + F.lit(size_ms)).alias("endTimestamp"),
        F.col("state.count").alias("count"),
        F.col("state.mean").alias("mean"),
        (F.col("state.m2") / F.when(F.col("state.count") > 0, F.col("state.count"))).alias("populationVariance"),
        F.col("state.min").alias("min"),
        F.col("state.max").alias("max"),
    ).select("identifier", "startTimestamp", "endTimestamp", *STATISTIC_COLUMNS)


class StateStore:
    """Window states in a folder, one subfolder per batch of records; ``fold`` merges old batches into one.

    A repeated batch replaces its own subfolder, so that its records count once. Raw records are never read again.
    """

    def __init__(self, path: str, size_ms: int) -> None:
        self.path, self.size_ms = path.rstrip("/"), size_ms

    def add(self, records: DataFrame, batch_id: int, **columns: str) -> None:
        """Add the records of a batch, whose numbers never fall; ``columns`` as for ``window_states``."""
        folded = self._folded(records.sparkSession)
        if folded is not None and batch_id <= folded:
            raise InvalidQueryError(f"Batch {batch_id} is already part of the folded batches up to {folded}.")
        rows = window_states(records, self.size_ms, **columns)
        rows.select(*KEYS, "state.*").write.mode("overwrite").parquet(f"{self.path}/batch={batch_id:012d}")

    def states(self, spark: SparkSession, upto: int | None = None) -> DataFrame:
        """The merged state of every window, of all batches or of those up to a number that is not folded yet."""
        folded = self._folded(spark)
        if upto is not None and folded is not None and upto < folded:
            raise InvalidQueryError(f"Batches up to {folded} are folded; {upto} cannot be told apart.")
        paths = [] if folded is None else [f"{self.path}/folded={folded:012d}"]
        for number in self._numbers(spark, "batch"):
            if (folded is None or number > folded) and (upto is None or number <= upto):
                paths.append(f"{self.path}/batch={number:012d}")
        rows = spark.read.schema(STORED).parquet(*paths) if paths else spark.createDataFrame([], STORED)
        return merged_states(rows.select(*KEYS, _state(*(F.col(c) for c in ("count", "mean", "m2", "min", "max")))))

    def windows(self, spark: SparkSession) -> DataFrame:
        return windows_of(self.states(spark), self.size_ms)

    def fold(self, spark: SparkSession) -> int | None:
        """Merge all batches there are into one set of states; returns the last number, None without batches.

        The merged copy is complete before it is used, and what it replaces is removed afterwards; an interruption
        leaves folders that no reader looks at, for the next call to remove.
        """
        numbers, folded = self._numbers(spark, "batch"), self._folded(spark)
        fresh = [n for n in numbers if folded is None or n > folded]
        if fresh:
            last = max(fresh)
            self.states(spark).select(*KEYS, "state.*").write.mode("overwrite").parquet(f"{self.path}/folded={last:012d}")
            folded = last
        for kind in ("batch", "folded"):
            for number in self._numbers(spark, kind, finished=False):
                if folded is not None and (number < folded or (kind == "batch" and number == folded)):
                    folders.remove(spark, f"{self.path}/{kind}={number:012d}")
        return folded

    def _numbers(self, spark: SparkSession, kind: str, finished: bool = True) -> list[int]:
        found = folders.matching(spark, f"{self.path}/{kind}=*" + ("/_SUCCESS" if finished else ""))
        return sorted(int(p.removesuffix("/_SUCCESS").rsplit("=", 1)[1]) for p in found)

    def _folded(self, spark: SparkSession) -> int | None:
        return max(self._numbers(spark, "folded"), default=None)
