"""A training corpus from raw documents, in five stages.

Each stage takes the documents that the one before it kept, and its result is written and read
again. Stages that decide by document id leave rows without an id alone; rows that share an id go
together, except that near-duplicate removal leaves one of them. An empty table stays empty in every stage, and columns
other than those of documents are dropped by the first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattline.llm.common import small_enough, stored
from wattline.llm.decontaminate import contamination
from wattline.llm.mixing import mix
from wattline.llm.near_duplicates import near_duplicates
from wattline.llm.quality_qda import quality_scores
from wattline.llm.sanitise import sanitise

DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` except those with one of the ids; the ids are broadcast only if they are few."""
    ids = stored(ids.select("doc_id").distinct(), "removed")
    side = F.broadcast(ids) if small_enough(ids, 60) else ids
    return docs.join(side, "doc_id", "left_anti")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts to be good.

    Null and empty texts have the score of an empty text; very long ones count as a whole. Repeated rows have one score. Labels of
    unknown documents, null labels and repeated ones are as in ``quality_scores``.
    """
    docs = docs.select(*DOCUMENT)
    scored = quality_scores(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _without(docs, scored.filter(F.col("predicted") == 0))


def near_duplicate_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the one with the smallest id.

    Texts without words (null and empty ones) and rows without id stay. Of rows that share an id one stays.
    """
    docs = docs.select(*DOCUMENT)
    classes = near_duplicates(docs)
    kept = _without(docs, classes.filter(F.col("doc_id") != F.col("class_id")))
    counts = docs.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count("*").alias("n"))
    repeated = stored(counts.filter(F.col("n") > 1).select("doc_id"), "repeated")
    if repeated.isEmpty():
        return kept
    several = F.broadcast(repeated) if small_enough(repeated, 60) else repeated
    once = kept.join(several, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.join(several, "doc_id", "left_anti").unionByName(once)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by benchmark items.

    Texts without words are never contaminated; items that are null, empty or repeated are as in ``contamination``.
    """
    docs = docs.select(*DOCUMENT)
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(docs, found.filter("contaminated"))


def personal_data_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and terms that disclose it replaced.

    Null and empty texts stay as they are, and so do repeated rows, each changed in the same way; ``n_chars`` is that of
    the new text, null for a null text.
    """
    clean = sanitise(docs.select(*DOCUMENT))
    return clean.withColumn("n_chars", F.length("text").cast("long"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with the words taken of each and the number of whole copies.

    Texts without words are never taken. A null source is a source of its own; repeated rows are taken one by one, in the
    order of their common key and their sizes.
    """
    mixed = mix(docs.select(*DOCUMENT), carry=True).filter(F.col("taken") > 0)
    return mixed.select("row.*", "size", "taken", "epochs")


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicate_removal),
    ("decontamination", decontamination),
    ("personal_data", personal_data_removal),
    ("mixing", mixing),
]

#: SQL cannot express the classifier, the sampler and the components.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixed corpus from ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
