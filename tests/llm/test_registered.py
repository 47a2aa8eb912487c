"""Registered queries on the small test tables, against plain versions of their contracts."""

import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from corpus_pipeline import DOCUMENT, STAGES, run
from tests.compare import assert_same, connect
from tests.llm import brute
from wattline.llm import decision_list as rules
from wattline.llm import quality_qda as qda
from wattline.llm.queries import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts():
    return {r["doc_id"]: r for r in pq.read_table(f"{SF_DIR}/documents.parquet").to_pylist()}


@pytest.fixture(scope="module")
def labels():
    return {r["doc_id"]: r["quality"] for r in pq.read_table(f"{SF_DIR}/labels.parquet").to_pylist()}


def result(spark, name):
    return {row[0]: row for row in QUERIES[name](spark, SF_DIR).collect()}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name):
    assert_same(QUERIES[name](spark, SF_DIR).toPandas(), connect(SF_DIR).sql(ORACLES[name]).df())


def test_quality_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"  # the smallest table has some ten documents of class 0
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{folder}/labels.parquet").to_pylist()}
    rows = {r["doc_id"]: r for r in QUERIES["op1_quality_classifier"](spark, folder).collect()}
    assert rows.keys() == set(pq.read_table(f"{folder}/documents.parquet")["doc_id"].to_pylist())
    held = [i for i in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {i for i, r in rows.items() if r["held_out"]} == set(held)
    judged = [i for i in held if i in labels]
    assert sum(rows[i]["predicted"] == labels[i] for i in judged) >= 0.95 * len(judged)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows.values())


def test_token_counts(spark, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = result(spark, "op2_token_counts")
    for i, r in texts.items():
        expected = len(tokenizer.encode(r["text"], add_special_tokens=False).ids)
        assert rows[i][1:] == (len(r["text"].encode()), expected, expected > 2048)


def test_license_scan(spark, texts):
    rows = result(spark, "op4_license_scan")
    for i, r in texts.items():
        assert rows[i][1:6] == brute.license_row(r["text"])
        assert set(rows[i]["labels"].split(",")) >= set(rows[i]["base_labels"].split(",")) - {""}


def test_quality_rules(spark, texts, labels):
    rows = result(spark, "op5_quality_rules")
    for i, r in texts.items():
        assert rows[i][1:7] == brute.rules_row(r["text"])
        assert not (rows[i]["base_failed"] and rows[i]["kept"])
    good = [i for i in labels if labels[i] and not rows[i]["base_failed"]]
    bad = [i for i in labels if not labels[i]]
    assert sum(rows[i]["kept"] for i in good) >= 0.97 * len(good)
    assert sum(rows[i]["kept"] for i in bad) <= 0.5 * len(bad)


def test_mix(spark, texts):
    rows = result(spark, "op6_mix_sources")
    sizes, taken = {}, {}
    for i, r in texts.items():
        assert rows[i]["size"] == len(brute.SPACED.findall(r["text"] or ""))
        assert 0 <= rows[i]["taken"] <= 2 * rows[i]["size"]
        sizes[r["source"]] = sizes.get(r["source"], 0) + rows[i]["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + rows[i]["taken"]
    for source, target in brute.targets(sizes).items():
        assert taken[source] == pytest.approx(target, abs=1)
    assert {(i, r["taken"]) for i, r in rows.items()} == {(i, r["taken"]) for i, r in result(spark, "op6_mix_sources").items()}


def test_decontamination(spark, texts):
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{SF_DIR}/benchmark.parquet").to_pylist()]
    rows = result(spark, "op8_decontamination")
    ids = list(texts)
    for i, expected in zip(ids, brute.contamination_rows([texts[i]["text"] for i in ids], items), strict=True):
        assert rows[i][1:] == expected


def test_personal_data(spark, texts):
    from hashlib import sha256

    rows = result(spark, "op10_personal_data")
    for i, r in texts.items():
        *counts, spans = brute.personal_row(r["text"])
        assert list(rows[i][1:5]) == counts
        assert rows[i]["base_sha256"] == sha256(spans.encode()).hexdigest()
        assert rows[i]["spans"].startswith(spans)


def test_pages(spark):
    import html
    import re

    rows = result(spark, "op7_html_main_text")
    for page in pq.read_table(f"{SF_DIR}/pages.parquet").to_pylist():
        article = page["html"].split("<article>")[1].split("</article>")[0].replace("<br>", " ")
        blocks = [html.unescape(re.sub("<[^>]*>", "", b)) for b in re.split("</?(?:p|h1)>", article)]
        expected = "\n".join(t for b in blocks if (t := " ".join(b.split())))
        assert rows[page["page_id"]]["text"] == expected
        assert rows[page["page_id"]]["n_chars"] == len(expected)


def test_pipeline(spark, texts):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    ids = set(texts)
    for name, stage in STAGES[:-1]:
        docs = stage(spark, docs, SF_DIR).checkpoint()
        assert tuple(docs.columns) == DOCUMENT, name
        kept = [row["doc_id"] for row in docs.select("doc_id").collect()]
        assert len(kept) == len(set(kept)) and set(kept) <= ids, name
        ids = set(kept)
        if name == "personal_data":
            for row in docs.collect():
                assert brute.personal_row(row["text"])[:4] == (0, 0, 0, 0)
                assert row["n_chars"] == len(row["text"])
    final = run(spark, SF_DIR).collect()
    assert {r["doc_id"] for r in final} <= ids
    assert all(r["taken"] > 0 for r in final)


def test_scores_equal_the_formula(spark):
    """Log densities by inverse and determinant of the covariances, for every document."""
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    featured = qda.with_features(qda.document_statistics(docs)).checkpoint()
    training = featured.join(qda.training_labels(labels), "id")
    model = qda.fit(training)
    rows = training.toPandas()
    x = {k: rows.loc[rows["label"] == k, list(qda.FEATURES)].to_numpy() for k in (0, 1)}
    pooled = sum(np.cov(x[k].T, bias=True) * len(x[k]) for k in (0, 1)) / len(rows)
    identity = np.diag(np.maximum(np.diag(pooled), 1e-4))
    all_rows = featured.toPandas()
    every, odds = all_rows[list(qda.FEATURES)].to_numpy(), np.log(len(x[1]) / len(x[0]))
    for k, sign in ((0, -1), (1, 1)):
        own = (1 - qda.TOWARDS_POOLED) * np.cov(x[k].T, bias=True) + qda.TOWARDS_POOLED * pooled
        covariance = (1 - qda.TOWARDS_IDENTITY) * own + qda.TOWARDS_IDENTITY * identity
        away = every - x[k].mean(axis=0)
        distance = np.einsum("ij,jk,ik->i", away, np.linalg.inv(covariance), away)
        odds = odds + sign * (-0.5 * distance - 0.5 * np.linalg.slogdet(covariance)[1])
    expected = dict(zip(all_rows["id"], 1 / (1 + np.exp(-np.clip(odds / model.temperature, -700, 700))), strict=True))
    found = {r["doc_id"]: r["score"] for r in QUERIES["op1_quality_classifier"](spark, folder).collect()}
    assert found.keys() == expected.keys()
    assert all(found[i] == pytest.approx(expected[i], abs=1e-6) for i in found)


def test_verdicts_equal_the_rules_by_hand(spark):
    docs, labels = (spark.read.parquet(f"{SF_DIR}/{t}.parquet") for t in ("documents", "labels"))
    statistics = rules.document_statistics(docs).checkpoint()
    learnt = rules.learn(*rules.labelled_sample(statistics, labels))
    columns = rules.rule_statistics()
    values = statistics.select("id", *(c.alias(n) for n, c in columns.items())).toPandas()
    x = {name: values[name].to_numpy(float) for name in columns}
    hit = np.zeros(len(values), bool)
    for rule in learnt:
        hit |= np.logical_and.reduce([(x[t.statistic] > t.cut) == t.above for t in rule.tests])
    bad = dict(zip(values["id"], hit, strict=True))
    for row in QUERIES["op5_quality_rules"](spark, SF_DIR).collect():
        assert row["kept"] == (not row["base_failed"] and not bad[row["doc_id"]])


def test_mix_takes_documents_in_the_order_of_their_keys(spark):
    """Python's own hash, logarithm and sorting."""
    import math
    import re
    from hashlib import md5

    docs = pq.read_table(f"{SF_DIR}/documents.parquet").to_pylist()
    rows = {r["doc_id"]: r for r in QUERIES["op6_mix_sources"](spark, SF_DIR).collect()}
    sizes = {d["doc_id"]: len(brute.SPACED.findall(d["text"] or "")) for d in docs}
    sources = {}
    for d in docs:
        u = (int(md5(f"mix:{d['doc_id']}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        symbols, chars = len(re.findall(r"[#*$%&|<>!{}\[\]=\\^~]", d["text"] or "")), max(len(d["text"] or ""), 1)
        weight = max(0.05, 1 - 5 * symbols / chars) if d["text"] is not None else 0.05
        sources.setdefault(d["source"], []).append((-math.log(u) / weight, d["doc_id"]))
    targets = brute.targets({s: sum(sizes[i] for _, i in keys) for s, keys in sources.items()})
    for source, keys in sources.items():
        whole = sum(sizes[i] for _, i in keys)
        epochs = int(targets[source] // whole) if whole else 0
        left = max(0, round(targets[source]) - epochs * whole)
        for _, i in sorted(keys):
            extra = min(sizes[i], left)
            assert rows[i]["taken"] == epochs * sizes[i] + extra
            left -= extra
