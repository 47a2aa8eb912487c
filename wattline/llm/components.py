"""Connected components of an edge list, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.llm.common import stored


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component for every node of ``edges`` (a, b); a component is named by its smallest node.

    Each round takes the smallest label among the neighbours and then the label of that label, so
    chains shorten by half; labels are written to the shared folder after each round. Rounds end when no label
    changes. Minima are combined before each shuffle, so a node with very many edges is no burden.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = stored(both, "edges")
    labels = stored(
        both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")),
        "labels",
    )
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("b"), "label"), "b")
            .groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        )
        better = labels.join(near, "node").select(
            "node", F.least("label", "near").alias("label"), F.col("label").alias("old")
        )
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        after = better.join(jump, "label").select("node", F.least("label", "next").alias("label"), "old")
        after = stored(after, "labels")
        changed = after.filter(F.col("label") < F.col("old")).count()
        labels = after.drop("old")
        if changed == 0:
            return labels.withColumnRenamed("label", "component")
