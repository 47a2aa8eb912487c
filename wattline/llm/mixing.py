"""Mix sources to target weights: complete epochs, then Efraimidis-Spirakis sampling for the rest.

A source with target T and size S gets every document floor(T / S) times; what is missing is drawn
without replacement: each document has an exponential key -ln(u) / quality, keys are sorted within
the source, and documents are taken in that order until their sizes reach the budget (the last one
is cut to fit). The order is found without sorting a source: keys fall into ranges, sizes are summed per
range, and only the range in which the budget ends is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattline.llm.common import SPACED_WORD, small_enough, stored

WEIGHTS = (3, 1, 2)
TOTAL_SHARE = 1.5
LIMIT = 2.0
#: Documents that share a range of keys, on average; the only rows that are ever sorted together.
RANGE_ROWS = 4_000
SEED = "mix"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SPACED_WORD)), F.lit(0)).cast("long")


def quality_of(text: Column) -> Column:
    """Weight of a document: the share of its characters that are no symbols, from 0.05 to 1."""
    symbols = F.regexp_count(text, F.lit(r"[#*$%&|<>!{}\[\]=\\^~]"))
    return F.greatest(F.lit(0.05), F.coalesce(1 - 5 * symbols / F.greatest(F.length(text), F.lit(1)), F.lit(0.05)))


def uniform(doc_id: Column, seed: str = SEED) -> Column:
    """A number in (0, 1) that depends on the id and the seed alone."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") + 0.5) / float(1 << 52)


def targets(sizes: DataFrame, weights=WEIGHTS, total_share=TOTAL_SHARE, limit=LIMIT) -> DataFrame:
    """source, source_size, n_docs -> with target and epochs, one row per source.

    Sources in code-point order, null last, weigh 3, 1, 2 in turn and share ``total_share`` of all
    sizes; a target stops at ``limit`` times its source's size and the excess is shared again by
    weight. The limit of that is found at once: with sources sorted by limit / weight, those before
    some place stop at their limits and the others share the rest. Two sorts of one row per source.
    """
    every = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    cap = F.col("source_size") * limit
    weighed = sizes.withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), (every % len(weights) + 1).cast("int")).cast("double")
    ).withColumn("ratio", cap / F.col("weight"))
    # Equal ratios reach their limits together, so the order among them does not matter.
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (
        F.lit(total_share) * F.sum("source_size").over(whole) - F.coalesce(F.sum(cap).over(before), F.lit(0.0))
    ) / F.sum("weight").over(after)
    levelled = weighed.withColumn("level", level)
    # The first source whose own limit is not reached fixes the level of all from there on.
    in_order = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    common = F.first(F.when(F.col("level") <= F.col("ratio"), F.col("level")), ignorenulls=True).over(in_order)
    target = F.least(cap.cast("double"), F.coalesce(common * F.col("weight"), cap.cast("double")))
    return (
        levelled.withColumn("target", target)
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
        .withColumn("budget", F.round(F.col("target")).cast("long") - F.col("epochs") * F.col("source_size"))
        .withColumn("budget", F.greatest(F.col("budget"), F.lit(0)))
        .select("source", "source_size", "n_docs", "target", "epochs", "budget")
    )


def mix(docs: DataFrame, *, seed: str = SEED, carry: bool = False) -> DataFrame:
    """doc_id, size, source_size, target, taken (and source, epochs) for each row of ``docs``.

    With ``carry`` all columns of the row come along as one struct, ``row``: sizes and keys are then computed
    again beside the text, so that no text is ever joined by its id. Null sources are a source of their own; null and empty texts have size 0 and nothing is taken of
    them. Equal rows are interchangeable: ties are broken by id and size, so reruns agree.
    """
    columns = (
        docs["doc_id"],
        docs["source"],
        size_of(docs["text"]).alias("size"),
        (-F.log(uniform(docs["doc_id"], seed)) / quality_of(docs["text"])).alias("key"),
    )
    sized = stored(docs.select(*columns), "mix-sizes")
    per_source = sized.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count("*").alias("n_docs"), F.avg("key").alias("mean_key")
    )
    per_source = stored(per_source, "mix-sources")
    plan = targets(per_source.drop("mean_key")).join(
        per_source.select(F.col("source").alias("s"), "mean_key"), F.col("source").eqNullSafe(F.col("s"))
    ).drop("s")
    plan = plan.withColumn("ranges", F.ceil(F.col("n_docs") / RANGE_ROWS))
    plan = stored(plan, "mix-plan")

    ranged = _in_ranges(_with_facts(sized, plan.select("source", "ranges", "mean_key")))

    sums = ranged.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    upto = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = sums.withColumn("upto", F.sum("range_size").over(upto))
    budgets = plan.select(F.col("source").alias("s"), "budget")
    # The range in which the budget ends: the first whose running sum exceeds it.
    cut = (
        running.join(budgets, F.col("source").eqNullSafe(F.col("s")))
        .filter(F.col("upto") > F.col("budget"))
        .groupBy("source")
        .agg(F.min("range").alias("cut"), F.min_by(F.col("upto") - F.col("range_size"), "range").alias("cut_before"))
    )
    facts = plan.select(F.col("source").alias("s"), "source_size", "target", "epochs", "budget").join(
        cut, F.col("s").eqNullSafe(F.col("source")), "left"
    ).select(F.col("s").alias("source"), "source_size", "target", "epochs", "budget", "cut", "cut_before")
    facts = stored(facts, "mix-facts")

    rows = ranged
    if carry:
        rows = _with_facts(docs.select(*columns, F.struct("*").alias("row")), plan.select("source", "ranges", "mean_key"))
        rows = _in_ranges(rows)
    told = _with_facts(rows, facts)
    inside = F.col("cut").isNull() | (F.col("range") < F.col("cut"))
    whole = told.filter(F.col("cut").isNull() | (F.col("range") != F.col("cut"))).withColumn(
        "extra", F.when(inside, F.col("size")).otherwise(0)
    )
    earlier = Window.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    partly = told.filter(F.col("range") == F.col("cut")).withColumn(
        "left", F.col("budget") - F.col("cut_before") - F.sum("size").over(earlier) + F.col("size")
    )
    partly = partly.withColumn("extra", F.greatest(F.lit(0), F.least(F.col("size"), F.col("left")))).drop("left")
    return whole.unionByName(partly).select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("epochs") * F.col("size") + F.col("extra")).cast("long").alias("taken"),
        "source",
        F.col("epochs").cast("long").alias("epochs"),
        *(["row"] if carry else []),
    )


def _in_ranges(rows: DataFrame) -> DataFrame:
    """The range of each row's key: a rising function of the key that spreads exponential keys evenly."""
    place = F.floor((1 - F.exp(-F.col("key") / F.greatest(F.col("mean_key"), F.lit(1e-300)))) * F.col("ranges"))
    return rows.withColumn("range", F.least(place, F.col("ranges") - 1)).drop("ranges", "mean_key")


def _with_facts(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """Rows with the facts of their source; facts are broadcast if their real number allows it."""
    side = facts.withColumnRenamed("source", "s")
    side = F.broadcast(side) if small_enough(facts, 200) else side
    return rows.join(side, F.col("source").eqNullSafe(F.col("s"))).drop("s")
