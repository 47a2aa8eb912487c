"""What is particular to each method."""

import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpus_pipeline import near_duplicate_removal
from tests.llm import brute
from wattline.llm import html_wrapper as hw
from wattline.llm import license_index
from wattline.llm import near_duplicates as nd
from wattline.llm import sanitise, token_prefix
from wattline.llm.common import WORD, WORD_ANY_CASE, word_list
from wattline.llm.components import connected_components
from wattline.llm.decision_list import expression, learn
from wattline.llm.decontaminate import PositionalIndex, phrase_places, phrases, proximity_matches
from wattline.llm.license_index import license_scan
from wattline.llm.mixing import targets
from wattline.llm.quality_qda import FEATURES, Model, fit
from wattline.llm.sanitise import with_spans
from wattline.llm.token_prefix import bytes_within, prefix_counts, tokens_before
from wattline.llm.warc_revisit import resolve_revisits


def test_density_difference_equals_formula(spark):
    rng = np.random.default_rng(1)
    x = [rng.normal(k, 1 + k, (200, len(FEATURES))) for k in (0, 1)]
    rows = [(k, *map(float, r)) for k in (0, 1) for r in x[k]]
    model = fit(spark.createDataFrame(rows, ["label", *FEATURES]), towards_pooled=0.0, towards_identity=0.0, temperature=1.0)
    for k in (0, 1):
        np.testing.assert_allclose(model.means[k], x[k].mean(axis=0))
        np.testing.assert_allclose(model.factors[k] @ model.factors[k].T, np.cov(x[k].T, bias=True), atol=1e-9)
    assert isinstance(model, Model)
    assert (model.scores(x[1]) > 0.5).mean() > 0.9 and (model.scores(x[0]) < 0.5).mean() > 0.9


def test_every_prefix(spark, documents):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    text = "It's  naïve<|endoftext|>x, 12 Größen end"
    table = prefix_counts(documents([text]), path, inside=True)
    for i in range(len(text) + 1):
        offset = len(text[:i].encode())
        expected = len(tokenizer.encode(text[:i], add_special_tokens=False).ids)
        assert table.select(tokens_before(F.lit(offset)).alias("n")).first()["n"] == expected or text[i - 1].isspace()
    words = prefix_counts(documents(["aa bb cc"]), path)
    assert words.select(bytes_within(F.lit(2)).alias("n")).first()["n"] == 5
    assert words.select(bytes_within(F.lit(0)).alias("n")).first()["n"] == 0


@pytest.fixture(scope="module")
def bpe():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    return path, Tokenizer.from_file(path)


def test_counts_at_every_prefix_of_many_texts(spark, documents, bpe):
    path, tokenizer = bpe
    rng = random.Random(31)
    letters = "abcdefghiklmnoprstuvwyz" * 3 + "éßäñ日本のü'.,!-1２😂🇺🇸 ́<>|İ" + "  \n"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(196)]
    texts += ["we'll don't 're 'tis it's --'ve", "hahahahahahaha aaaaaaaaaaaaaaaaaaaaa", "😂" * 30, "<|endoftext|>x <|startoftext|> a<b"]
    for row in prefix_counts(documents(texts), path, inside=True).collect():
        text = texts[row["doc_id"]]
        stored = dict(zip(row["ends"], row["counts"], strict=True))
        for i in range(1, len(text) + 1):
            if text[i - 1] not in " \t\n\r\x0b\x0c":
                assert stored[len(text[:i].encode())] == len(tokenizer.encode(text[:i], add_special_tokens=False).ids), text[:i]


def test_one_word_of_twenty_thousand_letters(bpe):
    path, tokenizer = bpe
    rng = random.Random(32)
    text = "".join(chr(rng.choice([rng.randrange(0x3042, 0x3093), rng.randrange(0x4E00, 0x9FA0)])) for _ in range(20_000))
    counts = token_prefix.prefix_counter(path).inside(text)
    assert len(counts) == 19_999
    for i in [*range(1, 200), *range(200, 20_000, 1237), 19_999]:
        assert counts[i - 1] == len(tokenizer.encode(text[:i], add_special_tokens=False).ids)


def test_whole_licence_texts(documents):
    whole = {t.label: t.text for t in license_index.WHOLE_TEXTS}
    assert len(whole) >= 5 and min(len(t.split()) for t in whole.values()) > 80
    rng, prose = random.Random(41), "nothing to see here at all " * 5
    texts, expected = [], []
    for label, text in whole.items():
        words = text.split()
        edited = list(words)
        for at in rng.sample(range(12, len(words)), 2):  # two words more, as names of holders are
            edited.insert(at, "inc")
        parts = (words, edited, words[: len(words) // 2], rng.sample(words, len(words)))
        texts += [prose + " ".join(part).title() + ". " + prose for part in parts]
        expected += [True, True, False, False]
    rows = {r["doc_id"]: r for r in license_scan(documents(texts)).collect()}
    for i, found in enumerate(expected):
        label = list(whole)[i // 4]
        assert (label in rows[i]["labels"].split(",")) == found, (label, i % 4)
        assert rows[i]["n_base"] == 0
        if i % 4 == 0:
            assert rows[i]["score"] == 1.0


def test_rare_words_of_equal_idf_go_by_the_alphabet():
    templates = (license_index.Template("x", "delta alpha charlie bravo echo foxtrot", ("alpha charlie",)),)
    index = license_index.RareWordIndex(templates, dict.fromkeys((w.encode() for w in templates[0].text.split()), 1.0))
    assert index.rarest == [(b"alpha", b"bravo", b"charlie", b"delta")]


def test_tokens_of_the_table_are_those_of_the_library(bpe):
    path, tokenizer = bpe
    merges, rng = token_prefix.prefix_counter(path).merges, random.Random(33)
    assert all(merges.is_whole(token) for token in merges.vocabulary.values())
    for alphabet in ("ab", "eitnsrh", "abcdefghijklmnopqrstuvwxyz"):
        for _ in range(400):
            word = "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 30)))
            ids = tokenizer.encode(word, add_special_tokens=False).ids
            assert merges.tokens(word) == ids
            count, ended, _ = merges.table(word)
            assert ended[-1] == len(ids)


def test_chunk_ends_of_slices_and_odd_texts():
    texts = pa.array(["skipped one", "a b", None, "", " \n ", "x", "\té é\v", "end"]).slice(1)
    ends, number = token_prefix.chunk_ends(texts)
    assert number.tolist() == [0, 2, 2, 2, 2, 3, 5, 6]
    assert ends.tolist() == [1, 3, 1, 3, 6, 3]


def test_as_of_of_a_hot_url(spark):
    rng = random.Random(2)
    rows = [
        (i, rng.choice(["response", "revisit"]), "http://hot.org/" if i % 3 else f"http://x.org/{i % 7}", rng.randrange(400), {}, i)
        for i in range(1500)
    ]
    frame = spark.createDataFrame(rows, "record_id long, kind string, url string, ts long, headers map<string,string>, payload_bytes long")
    found = {r["record_id"]: r["refers_to"] for r in resolve_revisits(frame).collect()}
    for i, kind, url, ts, _, _ in rows:
        if kind == "revisit":
            earlier = [(t, j) for j, k, u, t, _, _ in rows if k == "response" and u == url and t < ts]
            assert found[i] == (max(earlier)[1] if earlier else None)


def test_license_templates(documents):
    texts = [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the Software), to deal",
        "permission granted to any person obtaining a copy of this software and documentation files",  # no key phrase
        "x Licensed under the GNU General Public License, version 3. y CC BY-NC z cc-by-nc",
        "license apache version 2",
    ]
    labels = {r["doc_id"]: (r["labels"], r["n_base"], r["score"]) for r in license_scan(documents(texts)).collect()}
    assert labels[0] == ("mit-text", 0, 1.0)
    assert labels[1] == ("", 0, 0.0)
    assert labels[2] == ("cc-by-nc,gpl-3", 2, 1.0)
    assert labels[3] == ("", 0, 0.0)


def test_decision_list_finds_thresholds(spark):
    rng = np.random.default_rng(3)
    x = {"a": rng.random(900), "b": rng.random(900), "c": rng.random(900)}
    sought = ((x["a"] > 0.7) & (x["b"] < 0.4)) | (x["c"] > 0.93)
    rules = learn(x, sought)
    covered = np.logical_or.reduce([rule.mask(x) for rule in rules])
    assert (covered & ~sought).sum() <= 0.02 * covered.sum() and (covered & sought).sum() >= 0.85 * sought.sum()
    frame = spark.createDataFrame([tuple(map(float, r)) for r in zip(*x.values(), strict=True)], list(x))
    numbers = [r[0] for r in frame.select(expression(rules)).collect()]
    for i, number in enumerate(numbers):
        holds = [k for k, rule in enumerate(rules) if rule.mask(x)[i]]
        assert number == (holds[0] if holds else None)
    assert learn({"a": np.zeros(0)}, np.zeros(0, bool)) == []


def test_targets_equal_repeated_sharing(spark):
    rng = random.Random(4)
    for _ in range(4):
        sizes = {s: rng.choice([0, 1, 10, 1000, 30_000]) for s in [None, "", "é", "a", "b", "Z", "zz"]}
        frame = spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "source string, source_size long, n_docs long")
        found = {r["source"]: r["target"] for r in targets(frame).collect()}
        assert found == pytest.approx(brute.targets(sizes))


def places_of(pages):
    found = hw.Places()
    for page in pages:
        found.add(hw.Places.of(page, hw.Reader(page)))
    return found


def test_wrapper_is_a_union_free_expression():
    pages = [
        "<ul><li>a</li><li>b</li></ul><h2>x</h2><p>y</p><h2>z</h2><p>w</p><footer>same</footer>",
        "<ul><li>c</li></ul><h2>q</h2><p>r</p><img><footer>same</footer>",
        "<div class=ad>buy</div><ul><li>c</li></ul><h2>q</h2><p>r</p><footer>same</footer>",
    ]
    whole = hw.merge(hw.merge(hw.page_wrapper(pages[0]), hw.page_wrapper(pages[1])), hw.page_wrapper(pages[2]))
    text = "".join(map(str, whole.children))
    assert text == (
        "(<div class=ad>#same</div>)?<ul>(<li>#text</li>)+</ul>(<h2>#text</h2><p>#text</p>)+<footer>#same</footer>"
    )
    assert hw.page_text(pages[0], places_of(pages)) == "a\nb\nx\ny\nz\nw"


def test_main_region_without_its_surroundings():
    page = (
        "<body><header>site</header><nav><a>menu</a></nav><main><article><header><h1>Title &amp; more</h1></header>"
        "<p>one <b>two</b>\n three<p>four<aside>side</aside><div class='share-buttons'>share</div>"
        "<section id=comments><p>me too</p></section><form><label>mail</label></form><script>x='</p>'</script></article></main>"
        "<div class='cookie-notice'>cookies</div><footer>foot</footer></body>"
    )
    assert hw.page_text(page, places_of([page])) == "Title & more\none two three\nfour"


def test_constant_text_outside_a_main_region_is_no_content():
    pages = [f"<div><p>Welcome to our site</p></div><div><h1>{t}</h1><p>{t} text</p></div>" for t in "abc"]
    # Both paragraphs have one path here; only the line that all pages have is no content.
    assert hw.page_text(pages[0], places_of(pages)) == "a\na text"


def test_a_host_with_and_without_main_regions(spark):
    bare = "<body><nav><a>menu</a></nav><div class=top><p>Site</p></div><div class=body><h1>{0}</h1><p>{0} text</p></div></body>"
    main = "<body><nav><a>menu</a></nav><div class=top><p>Site</p></div><article><h1>{0}</h1><p>{0} text</p></article></body>"
    pages = [(f"{kind}{t}", f"https://h.org/{t}", page.format(t)) for kind, page in (("b", bare), ("m", main)) for t in "abc"]
    pages += [("lone", "https://l.org/x", bare.format("x")), *((f"l{t}", "https://l.org/y", main.format(t)) for t in "yz")]
    pages += [("empty", "https://h.org/e", "<body><div class=body><p>note</p></div><main></main></body>")]
    rows = hw.main_text(spark.createDataFrame(pages, "page_id string, url string, html string")).collect()
    found = {r["page_id"]: r["text"] for r in rows}
    for t in "abc":
        assert found[f"b{t}"] == found[f"m{t}"] == f"{t}\n{t} text"
    assert found["lone"] == "x\nx text"
    assert found["ly"] == "y\ny text" and found["empty"] == ""


def test_attributes_beyond_long_class_lists():
    many = " ".join(f"u-{c}" for c in "abcdefghijklmnopqrstuvwxyz" * 2)
    page = (
        f"<body><div class='{many}' id='sidebar'>side</div><div class='{many}' role=navigation>go</div>"
        f"<div class='{many}' role=main><div class='{many} x'>one</div><div class='{many} y promo'>buy</div></div>outside</body>"
    )
    keys = {event[1] for event in hw.walk(page) if event[0] == "open"}
    assert len(keys) == 6 and max(map(len, keys)) <= 120
    assert hw.page_text(page, places_of([page])) == "one"


@pytest.mark.parametrize(
    "page, text",
    [
        ("<div class='content with-sidebar'><article><h1>T</h1><p>a</p></article></div><div class=sidebar>s</div>", "T\na"),
        ("<div class='page header-fixed'><article><p>a</p></article></div>", "a"),
        ("<div class=sidebar><article><p>only here</p></article></div><p>x</p>", "only here"),
        ("<div class=sidebar><article><p>teaser</p></article></div><main><p>a</p></main>", "a"),
        ("<form action=/><div id=wrap><main><p>a</p><form><label>mail</label></form></main></div></form>", "a"),
        ("<article><header class='entry-header'><h1>T</h1></header><p>a</p></article><footer>f</footer>", "T\na"),
        ("<article><h1 class='article-header'>T</h1><p>a</p><h2 class=search>S</h2></article>", "T\na\nS"),
        ("<main><p>a</p><section class='related-work'><p>earlier papers</p></section><p id='search-methods'>m</p></main>", "a\nearlier papers\nm"),
        ("<main><p>a</p><div class='comment-list'><p>me</p></div><ul class='share-buttons'><li>s</li></ul></main>", "a"),
    ],
)
def test_names_do_not_swallow_articles(page, text):
    assert hw.page_text(page, places_of([page, page])) == text


def test_a_suspect_name_needs_evidence_of_the_host():
    page = "<main><p>{0}</p><div class='search-tips'>{1}</div><div class='login-story'>{2}</div></main>"
    pages = [page.format(t, "Type a word", f"<a href=/{t}>more {t}</a>") for t in "abc"]
    assert hw.page_text(pages[0], places_of(pages)) == "a"  # the same on all pages; mostly links
    pages = [page.format(t, f"Tip {t}", f"Story {t} <a href=/>x</a>") for t in "abc"]
    assert hw.page_text(pages[0], places_of(pages)) == "a\nTip a\nStory a x"


@pytest.mark.parametrize("n", [10, 11, 12, 24, 25, 60])
def test_fixed_lines_are_no_content_however_many(n):
    """Paragraphs that all pages have, each followed by a block of its own."""
    pages = ["<body>" + "".join(f"<p>fixed {i}</p><div class=b{chr(97 + i % 26)}{'x' * (i // 26)}>{t} {i}</div>" for i in range(n)) + "</body>" for t in "abc"]
    places = places_of(pages)
    for t, page in zip("abc", pages, strict=True):
        assert hw.page_text(page, places) == "\n".join(f"{t} {i}" for i in range(n))


def test_the_order_of_pages_does_not_matter(spark):
    rng = random.Random(3)
    blocks = ["<p>same</p>", "<p>{0} one</p>", "<div class=x><p>{0} two</p><p>same</p></div>", "<div class='search-tips'>{0}</div>", "<section><h2>head</h2><p>{0}</p></section>"]
    pages = ["<body>" + "".join(rng.sample(blocks, rng.randint(2, 5))).format(t) + "</body>" for t in "abcde"]
    results = set()
    for order in itertools.permutations(range(5)):
        places = places_of([pages[i] for i in order])
        results.add((places.pack(), tuple(hw.page_text(p, places) for p in pages)))
    assert len(results) == 1
    halves = places_of(pages[:2]).add(hw.Places.unpack(places_of(pages[2:]).pack()))
    assert halves.pack() == places_of(pages).pack()


def test_very_deep_pages(spark):
    deep = ["<div>" * 20_000 + f"<p>{t} text</p><p>same</p>" + "</div>" * 20_000 for t in "ab"]
    deep.append("<main>" + "<b>" * 20_000 + "inside" + "</b>" * 20_000 + "</main>")
    rows = spark.createDataFrame([(i, "https://d.org/", p) for i, p in enumerate(deep)], "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in hw.main_text(rows).collect()} == {0: "a text", 1: "b text", 2: "inside"}
    whole = hw.merge(hw.page_wrapper(deep[0]), hw.page_wrapper(deep[1]))
    text = "".join(map(str, whole.children))
    assert "".join(map(str, hw.Element.unpack(whole.pack()).children)) == text and text.count("<div>") == 20_000


def test_repeated_pages_are_one(spark):
    page = "<body><h1>T</h1><p>text</p></body>"
    rows = spark.createDataFrame([(i, "https://r.org/", page) for i in range(4)], "page_id long, url string, html string")
    assert {r["text"] for r in hw.main_text(rows).collect()} == {"T\ntext"}


def test_phrases_and_proximity(spark, documents):
    rng = random.Random(5)
    vocabulary = ["a", "b", "c", "D", "é", "É"]
    texts = [" ".join(rng.choices(vocabulary, k=60)) for _ in range(40)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 9])))) for i in range(12)]
    docs = documents(texts)
    wanted = phrases(spark.createDataFrame(items, "item_id long, text string"))
    wanted = wanted.checkpoint()
    index = PositionalIndex(docs, wanted.select(F.explode("words").alias("term")).distinct())
    found = {(r["doc_id"], r["start"], r["length"]) for r in phrase_places(docs, wanted, 4, index).collect()}
    expected = set()
    for (_, item), (d, text) in itertools.product(items, enumerate(texts)):
        own, doc = brute.words(item), brute.words(text)
        n = min(4, len(own))
        for i, j in itertools.product(range(len(own) - n + 1), range(len(doc) - n + 1)):
            if own[i : i + n] == doc[j : j + n]:
                expected.add((d, j, n))
    assert found == expected
    pairs = spark.createDataFrame([(1, "a", "é"), (2, "b", "b")], "pair_id long, first_term string, second_term string")
    near = {tuple(r) for r in proximity_matches(index, pairs, 3).collect()}
    assert near == {
        (d, p, i, j)
        for d, text in enumerate(texts)
        for p, x, y in ((1, "a", "é"), (2, "b", "b"))
        for i, v in enumerate(brute.words(text))
        for j, w in enumerate(brute.words(text))
        if v == x and w == y and 0 < abs(i - j) <= 3
    }


def test_draws_collide_as_often_as_sets_are_similar():
    rng = np.random.default_rng(6)
    sampler = nd.Sampler(bands=1000, rows=1)
    base = np.unique(rng.integers(0, 1 << 63, 300).astype(np.uint64))
    weights = rng.uniform(0.5, 3, len(base))
    other = weights * rng.uniform(0.6, 1.4, len(base))
    a, b = (base[:250], weights[:250]), (base[30:], other[30:])
    same = (sampler.draws(*a) == sampler.draws(*b)).mean()
    assert same == pytest.approx(nd.weighted_jaccard(a, b), abs=0.05)


def test_words_are_runs_of_the_contracts_characters_without_ranges(spark):
    """Every ASCII character, and some others, alone between two letters; Java reads ranges in a class much more slowly."""
    texts = [f"a{chr(c)}b" for c in [*range(128), 0x80, 0xE9, 0xFF, 0x130, 0x2028, 0xFFFD, 0x1F600]]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for pattern, plain in ((WORD, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), (WORD_ANY_CASE, r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")):
        found = rows.select("doc_id", F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("words")).collect()
        assert {r["doc_id"]: r["words"] for r in found} == {i: re.findall(plain, t) for i, t in enumerate(texts)}
        assert "-" not in pattern


def test_near_duplicates_equal_brute_force(documents):
    rng = random.Random(7)
    texts = []
    for _ in range(25):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([3, 40, 200]))]
        texts.append(" ".join(base))
        for _ in range(rng.randrange(6)):
            edited = list(base)
            for _ in range(rng.randrange(4)):
                edited[rng.randrange(len(edited))] = f"x{rng.randrange(9999)}"
            texts.append(" ".join(edited))
    rng.shuffle(texts)
    found = {r["doc_id"]: r["class_id"] for r in nd.near_duplicates(documents(texts)).collect()}
    shingler, frequency = nd.Shingler(), np.zeros(nd.BUCKETS, np.int64)
    counted = [shingler.counted(word_list(t.encode())) for t in texts]
    for shingles, _ in counted:
        np.add.at(frequency, (shingles % np.uint64(nd.BUCKETS)).astype(int), 1)
    weights = nd.Weights.from_frequencies(frequency, len(texts))
    weighed = [(s, weights.of(s, c)) for s, c in counted]
    label = list(range(len(texts)))
    for _ in texts:
        for i, j in itertools.combinations(range(len(texts)), 2):
            if label[i] != label[j] and nd.weighted_jaccard(weighed[i], weighed[j]) >= 0.8:
                low = min(label[i], label[j])
                label = [low if x in (label[i], label[j]) else x for x in label]
        break
    assert found == dict(enumerate(label))


def test_members_outside_the_main_class_are_compared(documents):
    """A chain of texts each similar to the next only; the ends have nothing to do with each other."""
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words[k : k + 300]) for k in range(0, 100, 10)]
    found = nd.near_duplicates(documents(texts)).collect()
    assert {r["class_id"] for r in found} == {0}


def test_edited_copies_whose_original_has_the_largest_id(documents):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(304)]
    texts = []
    for c in range(220):
        edited = list(base)
        for at in rng.sample(range(5, 299, 6), 5):
            edited[at] = f"x{c}y{at}"
        texts.append(" ".join(edited))
    found = nd.near_duplicates(documents([*texts, " ".join(base)])).collect()
    assert {r["class_id"] for r in found} == {0}


def test_pairs_among_texts_that_share_a_passage(documents):
    """Each pair is similar, all texts share most of their words, and no leader is of the same pair."""
    passage = [f"p{i}" for i in range(200)]
    texts = {}
    for c in range(60):
        own = [f"o{c}w{i}" for i in range(100)]
        texts[c] = " ".join(passage + own)
        texts[100 + c] = " ".join(passage + own[:-8] + [f"e{c}w{i}" for i in range(8)])
    rows = [(i, t, "s") for i, t in texts.items()]
    frame = documents([t for _, t, _ in sorted(rows)])
    found = {r["doc_id"]: r["class_id"] for r in nd.near_duplicates(frame).collect()}
    assert found == {i: i % 60 for i in range(120)}


def _edited(rng, words, n):
    out = list(words)
    for at in rng.sample(range(len(out)), n):
        out[at] = f"e{rng.randrange(10**9)}"
    return out


def _half_alike(rng, n, edits):
    base = [f"w{i}" for i in range(300)]
    return [_edited(rng, base, edits) for _ in range(n)]


def test_comparisons_grow_with_the_texts_not_with_their_pairs(documents, monkeypatch):
    """Texts that are all about 0.5 alike and no duplicates of each other."""
    compared, verified = [], nd.verified
    monkeypatch.setattr(nd, "verified", lambda pairs, *more: compared.append(pairs.count()) or verified(pairs, *more))
    totals = []
    for n in (150, 300, 600):
        compared.clear()
        found = nd.near_duplicates(documents([" ".join(t) for t in _half_alike(random.Random(n), n, 11)])).collect()
        assert len({r["class_id"] for r in found}) == n
        totals.append(sum(compared))
    assert totals[1] <= 2.4 * totals[0] and totals[2] <= 2.4 * totals[1]


@pytest.mark.parametrize("exact", [False, True])
def test_recall_of_pairs_hidden_among_half_alike_texts(documents, exact):
    rng = random.Random(12)
    family = _half_alike(rng, 400 if not exact else 60, 11)
    pairs = [(rng.randrange(len(family)), rng.randrange(1, 7)) for _ in range(100 if not exact else 20)]
    texts = [" ".join(t) for t in family] + [" ".join(_edited(rng, family[k], m)) for k, m in pairs]
    found = {r["doc_id"]: r["class_id"] for r in nd.near_duplicates(documents(texts), exact=exact).collect()}
    weights = nd.Weights.from_frequencies(*nd.shingle_frequencies(documents(texts)))
    counted = [nd.Shingler().counted(word_list(t.encode())) for t in texts]
    weighed = [(s, weights.of(s, c)) for s, c in counted]
    linked = [found[k] == found[len(family) + i] for i, (k, _) in enumerate(pairs)]
    similar = [nd.weighted_jaccard(weighed[k], weighed[len(family) + i]) >= 0.8 for i, (k, _) in enumerate(pairs)]
    assert sum(similar) >= 15
    assert sum(a for a, b in zip(linked, similar, strict=True) if b) >= (1.0 if exact else 0.95) * sum(similar)
    assert not any(a for a, b in zip(linked, similar, strict=True) if not b)


def _linked(texts):
    """Class ids by comparing every pair of the texts."""
    shingler, frequency = nd.Shingler(), np.zeros(nd.BUCKETS, np.int64)
    counted = [shingler.counted(word_list(t.encode())) for t in texts]
    for shingles, _ in counted:
        np.add.at(frequency, (shingles % np.uint64(nd.BUCKETS)).astype(int), 1)
    weights = nd.Weights.from_frequencies(frequency, len(texts))
    weighed = [(s, weights.of(s, c)) for s, c in counted]
    label = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        if label[i] != label[j] and nd.weighted_jaccard(weighed[i], weighed[j]) >= 0.8:
            low = min(label[i], label[j])
            label = [low if x in (label[i], label[j]) else x for x in label]
    return dict(enumerate(label))


def _just_below(rng, pairs):
    """Pairs of texts that are 0.81 alike, all others being up to 0.79 alike: edits are in ten of thirteen places."""
    base = [f"w{i}" for i in range(574)]
    texts = []
    for places in rng.sample(list(itertools.combinations(range(9, 139, 10), 10)), pairs):
        for _ in range(2):
            edited = list(base)
            for at in places:
                edited[at] = f"e{rng.randrange(10**12)}"
            texts.append(" ".join(edited))
    rng.shuffle(texts)
    return texts


def test_no_link_is_lost_among_many_texts_just_below_the_threshold(documents):
    """More texts are nearly as near as the partner than any number of neighbours would cover."""
    texts = _just_below(random.Random(5), 150)
    found = {r["doc_id"]: r["class_id"] for r in nd.near_duplicates(documents(texts)).collect()}
    expected = _linked(texts)
    assert len(set(expected.values())) == 150
    assert found == expected


def test_pipeline_removes_every_copy_among_texts_just_below_the_threshold(spark, documents):
    texts = _just_below(random.Random(5), 150)
    kept = near_duplicate_removal(spark, documents(texts), "").select("doc_id").collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(_linked(texts).values()))


def test_pipeline_removes_a_copy_that_misses_every_band(spark, documents):
    """Two texts that are 0.8003 alike, found by trial among 72,000 such pairs: none of their 14 bands is the same."""
    base = [f"b431152x{i}" for i in range(52)]
    texts = [" ".join(base), " ".join([*base[:25], "e431152", *base[26:]])]
    assert set(_linked(texts).values()) == {0}
    kept = near_duplicate_removal(spark, documents(texts), "").select("doc_id").collect()
    assert [r["doc_id"] for r in kept] == [0]


def test_exact_join_takes_each_text_once_if_ids_or_texts_repeat(documents, monkeypatch):
    """Without bands in common; an id has two texts, a text has two ids, some have neither words nor id."""
    words = [f"w{i}" for i in range(100)]
    one, two = " ".join(words), " ".join(words[:99])
    other, near = " ".join(f"v{i}" for i in range(100)), " ".join(f"v{i}" for i in range(98))
    rows = [(5, one, "s"), (5, other, "s"), (2, other, "s"), (9, two, "s"), (8, near, "s"), (7, "apart", "s"), (6, None, "s"), (None, one, "s")]
    monkeypatch.setattr(nd.Sampler, "band_keys", lambda self, shingles, weights: shingles[:1].view(np.int64))
    found = sorted((r["doc_id"] or -1, r["class_id"]) for r in nd.near_duplicates(documents(rows)).collect())
    assert found == [(-1, None), (2, 2), (5, 2), (5, 2), (6, 6), (7, 7), (8, 2), (9, 2)]


def test_every_pair_is_found_that_can_reach_the_threshold(documents, monkeypatch):
    """Without bands in common, links between texts of different lengths come from the join of rare shingles alone."""
    rng = random.Random(21)
    texts = []
    for k in range(12):
        base = [f"w{k}x{i}" for i in range(120)]
        for n in (99, 104, 109, 114, 119):
            texts.append(" ".join(_edited(rng, base[:n], rng.randrange(3))))
    monkeypatch.setattr(nd.Sampler, "band_keys", lambda self, shingles, weights: shingles[:1].view(np.int64))
    found = {r["doc_id"]: r["class_id"] for r in nd.near_duplicates(documents(texts), exact=True).collect()}
    assert found == _linked(texts)


def test_texts_are_opened_only_for_pairs_that_cells_leave(documents, monkeypatch):
    """Texts that are some 0.3 alike share rare shingles and bands; five pairs of them are duplicates."""
    opened, stored = [], nd.stored
    monkeypatch.setattr(nd, "stored", lambda rows, purpose: (out := stored(rows, purpose), purpose == "near-texts" and opened.append(out.count()))[0])
    rng = random.Random(31)
    family = _half_alike(rng, 120, 20)
    texts = [" ".join(t) for t in [*family, *(_edited(rng, family[k], 2) for k in range(5))]]
    found = {r["doc_id"]: r["class_id"] for r in nd.near_duplicates(documents(texts)).collect()}
    assert found == _linked(texts) and len(set(found.values())) == 120
    assert 10 <= sum(opened) <= 20


def test_pipeline_stores_only_texts_that_cells_leave(spark, documents, monkeypatch):
    """What near-duplicate removal stores stays on disk in the stages after it."""
    opened, stored = [], nd.stored
    monkeypatch.setattr(nd, "stored", lambda rows, purpose: (out := stored(rows, purpose), purpose == "near-texts" and opened.append(out.count()))[0])
    rng = random.Random(32)
    family = _half_alike(rng, 100, 20)
    texts = [" ".join(t) for t in [*family, *(_edited(rng, family[k], 2) for k in range(4))]]
    kept = near_duplicate_removal(spark, documents(texts), "").select("doc_id").collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(_linked(texts).values())) == list(range(100))
    assert 8 <= sum(opened) <= 16


def test_rare_shingles_of_all_texts_are_shuffled_once(spark, documents, monkeypatch):
    """If no table may be broadcast, and if the table of bits is full, too."""
    plans, stored, before = [], nd.stored, spark.conf.get("spark.sql.autoBroadcastJoinThreshold")

    def spied(rows, purpose):
        if purpose == "rare-shingles":
            plans.append(rows._jdf.queryExecution().executedPlan().toString())
        return stored(rows, purpose)

    monkeypatch.setattr(nd, "stored", spied)
    monkeypatch.setattr(nd, "small_enough", lambda *_: False)
    monkeypatch.setattr(nd.Sampler, "band_keys", lambda self, shingles, weights: shingles[:1].view(np.int64))
    texts = _just_below(random.Random(6), 20)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for bits_of in (nd._bits, lambda keys: (64 - 15, np.full(1 << 12, 255, np.uint8))):
            monkeypatch.setattr(nd, "_bits", bits_of)
            assert {r["doc_id"]: r["class_id"] for r in nd.near_duplicates(documents(texts)).collect()} == _linked(texts)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(plans) == 2 and not any("hashpartitioning(key" in plan for plan in plans)


def test_bits_are_those_of_the_keys(spark):
    keys = [0, 1, -1, 2**63 - 1, -(2**63), *(random.Random(3).randrange(-(2**63), 2**63) for _ in range(3000))]
    shift, table = nd._bits(spark.createDataFrame([(k,) for k in keys], "key long"))
    places = {(k % 2**64) >> shift for k in keys}
    assert set(np.unpackbits(table, bitorder="little").nonzero()[0].tolist()) == places
    assert len(table) * 8 >= nd.KEY_BITS * len(keys)


def test_cells_never_hide_a_similar_pair():
    rng = np.random.default_rng(4)
    far = 0
    for n in (1, 5, 30, 300, 3000):
        for changed in (0.0, 0.05, 0.1, 0.2, 0.6, 1.0):
            shingles = np.unique(rng.integers(0, 2**64, n, np.uint64))
            other = np.where(rng.random(len(shingles)) < changed, rng.integers(0, 2**64, len(shingles), np.uint64), shingles)
            other = np.unique(np.append(other, rng.integers(0, 2**64, n // 7, np.uint64)))
            for high in (2, 10**8):
                a, b = ((s, 1.2 * (1 + np.log((s >> np.uint64(20)) % np.uint64(high) + np.uint64(1)))) for s in (shingles, other))
                most = nd._most_alike(nd._cells(*a), nd._cells(*b), a[1].sum(), b[1].sum())
                assert most >= nd.weighted_jaccard(a, b) - 1e-9
                far += changed == 1 and most < 0.8
    assert far >= 4


@pytest.mark.parametrize("words", [[b"a"], [b"a", b"b"], [b"%d" % (i % 7) for i in range(40)], [b"x" * 50_000, *[b"yz%d" % i for i in range(9000)]]])
def test_shingles_are_alike_if_and_only_if_their_words_are(words):
    hashes = nd.Shingler().hashes(words)
    places = [tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))]
    assert len(hashes) == len(places) and len(set(hashes.tolist())) == len(set(places))
    assert len({(h, p) for h, p in zip(hashes.tolist(), places, strict=True)}) == len(set(places))


def test_ties_between_central_texts_do_not_depend_on_order(documents):
    texts = [" ".join(["w%d" % (j + 3 * k) for j in range(90)]) for k in range(12)]
    first, again = (sorted(tuple(r) for r in nd.near_duplicates(frame).collect()) for frame in (documents(texts), documents(texts).orderBy(F.col("doc_id").desc()).repartition(5)))
    assert first == again and {c for _, c in first} == {0}


def test_components(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(60)]
    found = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = {n: n for e in edges for n in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    assert found == label


def test_terms_that_disclose_an_entity(documents):
    openings = ["yesterday came", "we heard of", "some say that", "this morning", "nobody knows"]
    texts = [f"{o} captain Zebulon of the fleet, reach {i} him at zeb@ships.org {o} again" for i, o in enumerate(openings)]
    texts += [f"the fleet of number {i} came again yesterday with a captain" for i in range(40)]
    texts += ["one odd mention of Quirinus near lone@ships.org"] * 6  # copies of one mention prove nothing
    rows = {r["row"]["doc_id"]: r for r in with_spans(documents(texts)).collect()}
    for i, o in enumerate(openings):
        words = {s["value"]: s["kind"] for s in rows[i]["extra"]}
        assert words.get("Zebulon") == "removed", o
        assert "fleet" not in words and "the" not in words
    assert all(rows[i]["extra"] == [] for i in range(5, len(texts)))
    assert [s["kind"] for s in rows[50]["base"]] == ["email"]


def test_a_signature_does_not_make_letters_copies(documents):
    """Independent letters that end in the same line with a name and an address."""
    rng = random.Random(21)
    end = "yours sincerely captain Zebulon Quirk of the harbour office zeb@ships.org"
    prose = lambda n: " ".join(f"v{rng.randrange(900)}" for _ in range(n))
    texts = [f"{prose(80)} {end}" for _ in range(300)] + [prose(90) for _ in range(700)]
    extra = {r["row"]["doc_id"]: {s["value"] for s in r["extra"]} for r in with_spans(documents(texts)).collect()}
    assert all({"Zebulon", "Quirk"} <= extra[i] for i in range(300))
    assert all(extra[i] == set() for i in range(300, 1000))


def test_two_independent_documents_suffice_and_one_does_not(documents):
    rng = random.Random(22)
    prose = lambda n: " ".join(f"v{rng.randrange(300)}" for _ in range(n))
    texts = [f"{prose(40)} Ozymandias ozy@sand.org {prose(40)}" for _ in range(2)]
    texts += [f"{prose(40)} Quirinus lone@ships.org {prose(40)}"]
    texts += [prose(80) for _ in range(300)]
    extra = {r["row"]["doc_id"]: {s["value"] for s in r["extra"]} for r in with_spans(documents(texts)).collect()}
    assert "Ozymandias" in extra[0] and "Ozymandias" in extra[1] and extra[2] == set()


def test_disclosures_equal_brute_force(documents, spark):
    """On a corpus without copies, where every document is a witness of its own."""
    import math

    rng = random.Random(23)
    people = [f"p{i}@x.org" for i in range(6)]
    hints = {e: [f"hint{i}{j}" for j in range(3)] for i, e in enumerate(people)}
    texts = []
    for _ in range(250):
        words = [f"v{rng.randrange(200)}" for _ in range(30)]
        for e in rng.sample(people, rng.choice([0, 0, 0, 1, 2])):
            words += [e, *(h for h in hints[e] if rng.random() < 0.7)]
        words += [rng.choice(hints[rng.choice(people)])] * (rng.random() < 0.05)
        texts.append(" ".join(words))
    docs = documents(texts).select(F.struct("doc_id").alias("key"), "text")
    _, found = sanitise.disclosing_terms(docs)
    sets = [set(brute.words(t)) for t in texts]
    expected = {}
    for e in people:
        own = {i for i, t in enumerate(texts) if e in t.split()}
        for term in set().union(*(sets[i] for i in own)) if own else ():
            n_term, both = sum(term in s for s in sets), sum(term in sets[i] for i in own)
            if both < 2:
                continue
            z, share = 1.28, both / n_term
            low = (share + z * z / (2 * n_term) - z * math.sqrt(share * (1 - share) / n_term + z * z / (4 * n_term**2))) / (1 + z * z / n_term)
            value = math.log(low * len(texts) / len(own)) / math.log(len(texts) / len(own))
            rate, rest = len(own) / len(texts), 1 - share
            likely = n_term * (share * math.log(share / rate) + (rest * math.log(rest / (1 - rate)) if rest else 0)) if share > rate else 0
            if value >= 0.6 and likely >= math.log(10_000):
                expected[f"email:{e}", term] = value
    got = {(r["entity"], r["term"]): r["disclosure"] for r in found.collect()}
    assert got.keys() == expected.keys() and len(got) > 10
    assert all(got[k] == pytest.approx(expected[k]) for k in got)


def test_many_edited_copies_do_not_hide_independent_mentions(documents):
    rng = random.Random(10)
    prose = lambda n: " ".join(f"v{rng.randrange(5000)}" for _ in range(n))
    texts = [f"{prose(20)} Zebulon {prose(9)} zeb@ships.org {prose(20)}" for _ in range(6)]
    words = f"{prose(30)} Zebulon {prose(9)} zeb@ships.org {prose(30)}".split()
    lone = f"{prose(30)} Quirinus {prose(9)} lone@ships.org {prose(30)}".split()
    for template in (words, lone):
        for c in range(60):
            edited = list(template)
            edited[rng.choice([3, 15, 24, 50, 65])] = f"x{c}"
            texts.append(" ".join(edited))
    texts += [prose(60) for _ in range(200)]
    extra = {r["row"]["doc_id"]: {s["value"] for s in r["extra"]} for r in with_spans(documents(texts)).collect()}
    assert all("Zebulon" in extra[i] for i in range(66))
    assert all(extra[i] == set() for i in range(66, len(texts)))


def test_words_of_an_entity_disclose_it_elsewhere(documents):
    rng = random.Random(11)
    prose = lambda n: " ".join(f"v{rng.randrange(5000)}" for _ in range(n))
    texts = [f"{prose(20)} John {prose(9)} john.smith@x.org {prose(20)} Smith {prose(3)}" for _ in range(6)]
    texts += [prose(60) for _ in range(200)]
    rows = with_spans(documents(texts)).collect()
    for r in rows:
        expected = {"John", "Smith"} if r["row"]["doc_id"] < 6 else set()
        assert {s["value"] for s in r["extra"] if s["kind"] == "removed"} == expected
