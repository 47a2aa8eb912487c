"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for each operator and stage."""

import pytest
from pyspark.sql import functions as F

from corpus_pipeline import DOCUMENT, STAGES
from wattline.llm import (
    decision_list,
    decontaminate,
    html_wrapper,
    license_index,
    mixing,
    near_duplicates,
    periodic_runs,
    quality_qda,
    sanitise,
    token_prefix,
    warc_revisit,
)

LONG = "word other thing " * 20_000
ROWS = [
    (1, None, "a"),
    (2, "", None),
    (3, " \n\t ", "a"),
    (4, LONG, "b"),
    (5, "one", "b"),
    (5, "one", "b"),
    (None, "mail me at x@y.org now", None),
    (6, "é ß 日本 \u0000 text", "é"),
]
LABELS = "doc_id long, quality int, toxic int"
ITEMS = "item_id long, text string"


@pytest.fixture
def edge(documents):
    """All odd cases at once, with extra columns that carry names the operators use inside."""
    rows = documents(ROWS)
    for name in ("id", "key", "row", "base", "extra", "size", "range", "words", "content", "score", "position", "of"):
        rows = rows.withColumn(name, F.lit("x"))
    return rows


def operators(spark):
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 0), (5, 1, 0), (None, 1, 0), (3, None, None)], LABELS)
    items = spark.createDataFrame([(1, "one"), (2, None), (3, ""), (1, "one"), (4, "word other thing word")], ITEMS)
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    return {
        "quality": lambda d: quality_qda.quality_scores(d, labels),
        "tokens": lambda d: token_prefix.prefix_counts(d, path),
        "license": license_index.license_scan,
        "rules": lambda d: decision_list.quality_rules(d, labels),
        "mix": mixing.mix,
        "contamination": lambda d: decontaminate.contamination(d, items),
        "near": near_duplicates.near_duplicates,
        "personal": sanitise.personal_data,
        "sanitise": sanitise.sanitise,
        "runs": periodic_runs.periodic_runs,
    }


NAMES = "quality tokens license rules mix contamination near personal sanitise runs".split()


@pytest.mark.parametrize("name", NAMES)
def test_one_row_for_each_row(spark, edge, name):
    rows = operators(spark)[name](edge).collect()
    key = lambda i: (i is None, i or 0)
    assert sorted((r["doc_id"] for r in rows), key=key) == sorted((i for i, *_ in ROWS), key=key)


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, documents, name):
    assert operators(spark)[name](documents([("x")]).limit(0)).collect() == []


def by_id(rows):
    return {r["doc_id"]: r for r in rows.collect()}


def test_defined_results(spark, edge):
    all_ = operators(spark)
    tokens = by_id(all_["tokens"](edge).select("doc_id", "n_bytes", token_prefix.total_tokens().alias("n")))
    assert [tokens[i]["n"] for i in (1, 2, 3)] == [0, 0, 0] and tokens[4]["n"] == 60_000
    near = by_id(all_["near"](edge))
    assert all(near[i]["class_id"] == i for i in near)
    hits = by_id(all_["contamination"](edge))
    assert hits[5]["n_hit"] == 1 and hits[5]["n_items"] == 1 and hits[5]["contaminated"]
    assert hits[4]["n_hit"] == 59_998 and not hits[1]["contaminated"] and hits[2]["n_words"] == 0
    personal = by_id(all_["personal"](edge))
    assert personal[None]["spans"] == "email:11:18"
    clean = by_id(all_["sanitise"](edge))
    assert clean[None]["text"] == "mail me at [EMAIL] now" and clean[1]["text"] is None and clean[4]["text"] == LONG
    assert clean[4]["base"] == "x"
    mixed = by_id(all_["mix"](edge))
    assert mixed[1]["taken"] == mixed[2]["taken"] == mixed[3]["taken"] == 0
    scored = by_id(all_["quality"](edge))
    assert all(r["score"] is not None for r in scored.values())


def test_no_labels_and_no_items(spark, documents):
    docs, labels = documents(["a b c", None]), spark.createDataFrame([], LABELS)
    assert {r["score"] for r in quality_qda.quality_scores(docs, labels).collect()} == {0.5}
    assert all(r["rule"] is None for r in decision_list.quality_rules(docs, labels).collect())
    empty = spark.createDataFrame([], ITEMS)
    assert not any(r["contaminated"] for r in decontaminate.contamination(docs, empty).collect())


def test_pages(spark):
    schema = "page_id long, url string, html string, host string, content string"
    long = "<article>" + "<p>text</p>" * 30_000 + "</article>"
    pages = [
        (1, None, None, "h", "c"), (2, "", "", "h", "c"), (3, "http://x.org/", "no markup &amp; <", "h", "c"),
        (4, "http://x.org/", "<p>one<p>two</div></article", "h", "c"), (4, "http://x.org/", "<p>one<p>two</div></article", "h", "c"),
        (None, "http://y.org", long, "h", "c"), (6, "http://z.org", "<!-- never ends", "h", "c"), (7, "http://w.org", "<script>x", "h", "c"),
    ]
    frame = spark.createDataFrame(pages, schema)
    rows = [(r["page_id"], r["text"]) for r in html_wrapper.main_text(frame).collect()]
    assert len(rows) == len(pages)
    found = dict(rows)
    assert found[1] == found[2] == found[6] == found[7] == ""
    assert found[4] == "one\ntwo" and found[None].count("\n") == 29_999
    assert html_wrapper.main_text(frame.limit(0)).collect() == []


def test_revisits(spark):
    schema = "record_id long, kind string, url string, ts long, headers map<string,string>, payload_bytes long, part int"
    rows = [
        (1, "response", "http://www.X.org/a/", 10, {"ETag": '"1"', "Date": "d1"}, 5, 0),
        (1, "response", "http://www.X.org/a/", 10, {"ETag": '"1"', "Date": "d1"}, 5, 0),
        (2, "response", "https://x.org:443/a#f", 20, {"ETag": '"2"'}, 6, 0),
        (3, "revisit", "http://x.org/a?utm_source=q", 15, {"etag": 'W/"1"', "date": "d3", "Content-Type": "no"}, None, 0),
        (4, "revisit", "http://x.org/a", 20, None, None, 0),
        (5, "revisit", "http://x.org/a", 21, {"etag": '"1"'}, None, 0),
        (6, "revisit", "http://x.org/a", 5, {}, None, 0),
        (7, "revisit", None, 5, {}, None, 0),
        (8, "revisit", "http://x.org/a", None, {}, None, 0),
        (None, "other", "u", 1, None, None, 0),
    ]
    frame = spark.createDataFrame(rows, schema)
    found = {r["record_id"]: r for r in warc_revisit.resolve_revisits(frame).collect()}
    outcome = {i: (r["outcome"], r["refers_to"]) for i, r in found.items()}
    assert outcome == {
        3: ("resolved", 1), 4: ("resolved", 1), 5: ("changed", 2), 6: ("unknown", None), 7: ("no url", None), 8: ("unknown", None)
    }
    assert found[3]["headers"] == {"etag": 'W/"1"', "date": "d3"} and found[3]["payload_bytes"] == 5
    assert found[4]["headers"] == {"etag": '"1"', "date": "d1"}
    assert warc_revisit.resolve_revisits(frame.limit(0)).collect() == []


@pytest.mark.parametrize("name,stage", STAGES)
def test_stages(spark, edge, documents, name, stage, tmp_path):
    spark.createDataFrame([(4, 1, 0), (5, 0, 0)], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(9, "one"), (8, None)], ITEMS).write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = stage(spark, edge, str(tmp_path))
    assert tuple(kept.columns[:5]) == DOCUMENT
    rows = kept.collect()
    if name == "near_duplicates":
        assert [r["doc_id"] for r in rows].count(5) == 1 and len(rows) == len(ROWS) - 1
    if name == "decontamination":
        assert 5 not in [r["doc_id"] for r in rows] and len(rows) == len(ROWS) - 2
    if name == "personal_data":
        assert len(rows) == len(ROWS)
    if name == "mixing":
        assert all(r["taken"] > 0 for r in rows)
    assert stage(spark, edge.limit(0), str(tmp_path)).collect() == []
