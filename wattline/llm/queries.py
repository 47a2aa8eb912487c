"""The registered queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattline.llm.decision_list import quality_rules
from wattline.llm.decontaminate import contamination
from wattline.llm.html_wrapper import main_text
from wattline.llm.license_index import license_scan
from wattline.llm.mixing import mix
from wattline.llm.near_duplicates import near_duplicates
from wattline.llm.periodic_runs import periodic_runs
from wattline.llm.quality_qda import quality_scores
from wattline.llm.sanitise import personal_data
from wattline.llm.token_grammar import read_token_files, write_token_files
from wattline.llm.token_prefix import prefix_counts, total_tokens
from wattline.llm.warc_revisit import ORACLE_SQL as WARC_SQL
from wattline.llm.warc_revisit import crawl_records, header_lines, resolve_revisits
from wattline.llm.whitening import whitened
from wattline.session import new_work_dir

TOKEN_LIMIT = 2048
# The id that closes a document in token files.
END_ID = 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    counted = prefix_counts(documents, public_tokenizers.path("word_bpe_49k.json"))
    return counted.select("doc_id", "n_bytes", total_tokens().alias("n_tokens")).withColumn(
        "over_limit", F.col("n_tokens") > TOKEN_LIMIT
    )


def op3_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resolve_revisits(crawl_records(table(spark, sf_dir, "pages")))
    return found.select(
        "record_id",
        "canonical_url",
        F.coalesce("refers_to", F.lit(-1)).alias("refers_to"),
        "outcome",
        F.coalesce(header_lines(F.col("headers")), F.lit("")).alias("headers"),
        F.coalesce("payload_bytes", F.lit(0)).alias("payload_bytes"),
    )


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("source", "epochs")


def op7_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))


def _with_cycles(documents: DataFrame) -> DataFrame:
    """doc_id, text: in a tenth of the documents, all words from one on repeat the first few of them in turn."""
    digest = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda word: word != "")
    parts = documents.select("doc_id", "text", F.when(digest % 10 == 0, words).alias("words"))
    n, g = F.size("words").cast("long"), F.floor(digest / 10)
    parts = parts.withColumns({"n": n, "a": F.when(n > 0, g % n), "g": g})
    p = 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))
    parts = parts.withColumn("p", p.cast("int")).withColumn("a", F.col("a").cast("int"))
    rest = F.col("n").cast("int") - F.col("a")
    cycle = F.slice("words", F.col("a") + 1, F.col("p"))
    tail = F.slice(F.flatten(F.array_repeat(cycle, F.ceil(rest / F.col("p")).cast("int"))), F.lit(1), rest)
    changed = F.concat_ws(" ", F.slice("words", F.lit(1), F.col("a")), tail)
    return parts.select("doc_id", F.when(F.col("n") > 0, changed).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(_with_cycles(table(spark, sf_dir, "documents")))
    longer = "run.length * best.period > best.length * run.period"
    best = F.expr(f"aggregate(slice(runs, 2, size(runs)), runs[0], (best, run) -> CASE WHEN {longer} THEN run ELSE best END)")
    lines = F.transform("runs", lambda run: F.concat(F.concat_ws(",", run["start"], run["length"], run["period"]), F.lit("\n")))
    return found.withColumn("best", F.when(F.size("runs") > 0, best)).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_work_dir(spark, "token-files")
    write_token_files(
        table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), folder, end_id=END_ID
    )
    return read_token_files(spark, folder).select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    query.__name__: query
    for query in (
        op1_quality_classifier,
        op2_token_counts,
        op3_revisits,
        op4_license_scan,
        op5_quality_rules,
        op6_mix_sources,
        op7_html_main_text,
        op8_decontamination,
        op9_near_duplicates,
        op10_personal_data,
        op11_periodic_runs,
        op12_token_files,
        op13_embedding_whitening,
    )
}
# Capitals are lowered by table, as the contract lowers A-Z only.
_WORDS = (
    "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
)
CONTAMINATION_SQL = f"""
    WITH d AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
    items AS (SELECT item_id, w, least(13, len(w)) AS n FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
    windows AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS g
                FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM items)),
    places AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS g
               FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
                     FROM d, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)),
    hits AS (SELECT doc_id, n, i, item_id FROM places JOIN windows USING (n, g)),
    covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit
                FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
    named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
              FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(names, '')) AS items_sha256,
           coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
    FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)"""
MIX_SQL = """
    WITH d AS (
        SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size,
               -ln((CAST('0x' || md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), ''))[1:13] AS BIGINT) + 0.5) / 4503599627370496.0::DOUBLE)
               / greatest(0.05, coalesce(1 - 5 * len(regexp_extract_all(text, '[#*$%&|<>!{}\\[\\]=\\\\^~]'))::DOUBLE
                                         / greatest(length(text), 1), 0.05)) AS key
        FROM documents),
    sources AS (
        SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
               CAST([3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight
        FROM d GROUP BY source),
    levels AS (
        SELECT *, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / weight AS ratio,
               (1.5::DOUBLE * sum(source_size) OVER ()
                - coalesce(sum(source_size * 2.0::DOUBLE) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
               / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
        FROM sources WINDOW o AS (ORDER BY source_size * 2.0::DOUBLE / weight, source NULLS LAST)),
    shares AS (
        SELECT *, least(cap, coalesce(weight * (SELECT arg_min(level, ratio) FROM levels WHERE level <= ratio), cap)) AS target FROM levels),
    plan AS (
        SELECT source, source_size, target, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs
        FROM shares),
    ordered AS (
        SELECT d.*, source_size, target, epochs, greatest(CAST(round(target) AS BIGINT) - epochs * source_size, 0) AS budget,
               sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto
        FROM d JOIN plan ON d.source IS NOT DISTINCT FROM plan.source)
    SELECT doc_id, size, source_size, target,
           CAST(epochs * size + greatest(0, least(size, budget - (upto - size))) AS BIGINT) AS taken
    FROM ordered"""
ORACLES: dict[str, str] = {
    "op3_revisits": WARC_SQL,
    "op6_mix_sources": MIX_SQL,
    "op8_decontamination": CONTAMINATION_SQL,
}
