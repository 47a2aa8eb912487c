"""Periodic runs, token files and whitening, against plain versions and exact round trips."""

import math
import random
import zlib
from fractions import Fraction
from hashlib import sha256

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm import brute
from wattline.llm import periodic_runs as pr
from wattline.llm import token_grammar as tg
from wattline.llm import whitening as wh
from wattline.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
BPE = public_tokenizers.path("word_bpe_49k.json")


# -- periodic runs ---------------------------------------------------------------------------


def runs_by_definition(words):
    found, n = [], len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            smaller = any(all(words[k] == words[k + r] for k in range(i, i + length - r)) for r in range(1, q))
            if length >= max(6, 4 * q) and not smaller:
                found.append((i, length, q))
            i = j
    return sorted(found, key=lambda run: (run[0], run[2]))


def patchwork(rng):
    words = []
    for _ in range(rng.randint(0, 7)):
        base = [b"%d" % rng.randrange(rng.choice([1, 2, 3, 50])) for _ in range(rng.randint(1, rng.choice([3, 9, 40])))]
        words += (base * rng.choice([1, 1, 3, 4, 5, 9]))[: max(1, len(base) * 4 - rng.randint(0, len(base)))]
    return words


def test_runs_equal_definition():
    rng = random.Random(11)
    for _ in range(150):
        texts = [patchwork(rng) for _ in range(rng.randint(1, 6))]
        assert pr.search_texts(texts) == [runs_by_definition(text) for text in texts]


@pytest.mark.parametrize("period", [1, 2, 63, 64, 65, 700, 1023, 1024])
def test_long_periods_at_every_place(period):
    rng = random.Random(period)
    base = [b"%d" % i for i in range(period)]
    for before in (0, 1, period // 2, 77):
        words = [b"x%d" % rng.randrange(30) for _ in range(before)] + base * 5 + base[: period // 3] + [b"end"]
        expected = (before, 5 * period + period // 3, period)
        if expected[1] >= 6:
            assert expected in pr.search_texts([words])[0]


def test_transform_is_exact_convolution():
    rng = np.random.default_rng(3)
    for prime in pr.PRIMES:
        for length in (2, 8, 64):
            transform = pr.Transform(length, prime)
            x, y = rng.integers(0, prime, (2, length, 3)).astype(np.uint64)
            product = transform.inverse(transform.forward(x.copy()) * transform.forward(y.copy()) % np.uint64(prime))
            for column in range(3):
                for d in range(length):
                    exact = sum(int(x[i, column]) * int(y[(d - i) % length, column]) for i in range(length))
                    assert int(product[d, column]) == exact % prime


def test_further_primes_exclude_chance_zeros():
    # Differences whose squares add up to a multiple of the first prime, but not to 0.
    p = pr.PRIMES[0]
    a = next(a for a in range(math.isqrt(p), 0, -1) if math.isqrt(p - a * a) ** 2 == p - a * a)
    b = math.isqrt(p - a * a)
    words = np.array([0, 0, 1, 1, 1 + a, 1 + b, 0, 0], np.int64)
    search = pr.BlockSearch(words, 4)
    assert search._zero(np.array([2]), 2, p)[0, 0] and not len(search.places(np.array([2]), 2)[0])


def test_whole_text_of_one_word_and_long_texts():
    assert pr.search_texts([[b"a"] * 200_000, [b"a"] * 5, [b"a"] * 6, [b"a", b"b"] * 4]) == [[(0, 200_000, 1)], [], [(0, 6, 1)], [(0, 8, 2)]]
    rng = random.Random(5)
    base = [b"%d" % rng.randrange(10**6) for _ in range(20_000)]
    assert pr.search_texts([base * 4])[0] == [(0, 80_000, 20_000)]


def planted(doc_id, text):
    words = brute.SPACED.findall(text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    return words


def runs_row(words):
    runs = pr.search_texts([[w.encode() for w in words]])[0] if len(words) > 1500 else runs_by_definition(words)
    drop = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in drop)
    digests = [sha256(t.encode()).hexdigest() for t in (lines, kept)]
    return len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, *digests


def test_registered_runs(spark):
    rows = {r[0]: r for r in QUERIES["op11_periodic_runs"](spark, SF_DIR).collect()}
    docs = pq.read_table(f"{SF_DIR}/documents.parquet").to_pylist()
    assert rows.keys() == {d["doc_id"] for d in docs}
    for d in docs:
        assert tuple(rows[d["doc_id"]][1:]) == runs_row(planted(d["doc_id"], d["text"]))
    assert sum(r["n_runs"] > 0 for r in rows.values()) >= 10


# -- token files -----------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(6))
def test_grammar_round_trip_and_random_access(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 6000))
    ids = rng.integers(0, [3, 40, 500][seed % 3], n)
    ids = np.concatenate([ids, np.tile(ids[: n // 5], 6), np.full(999, 7)])
    data = tg.Shard.pack(ids, np.array([5, len(ids)]), 600)
    shard = tg.Shard(data)
    assert (shard.ids() == ids).all() and shard.ends.tolist() == [5, len(ids)]
    assert len(shard.rules) and len(shard.symbols) < len(ids)
    for _ in range(40):
        first, last = sorted(rng.integers(0, len(ids) + 1, 2).tolist())
        assert (shard.ids(first, last) == ids[first:last]).all()


def test_rules_replace_only_what_is_frequent():
    rules, rest = tg.compress(np.array([1, 2] * 20 + [3] * 41), 10, least=12)
    expansions = {i: [i] for i in range(10)}
    for i, (a, b) in enumerate(rules.tolist()):
        expansions[10 + i] = expansions[a] + expansions[b]
    assert [x for s in rest.tolist() for x in expansions[s]] == [1, 2] * 20 + [3] * 41
    assert not len(tg.compress(np.arange(5000) % 700, 700, least=12)[0])
    assert [len(x) for x in tg.compress(np.zeros(0, np.int64), 5)] == [0, 0]


def test_many_terminals_use_wide_symbols():
    ids = np.tile(np.array([70_000, 3, 99_999]), 500)
    shard = tg.Shard(tg.Shard.pack(ids, np.array([len(ids)]), 100_000))
    assert shard.symbols.itemsize == 4 and (shard.ids() == ids).all()


ODD = ["It's 'tis dogs' don't, x's", "<|endoftext|>, <|endoftext|>x", "İstanbul. Größe, naïve! ÀÉ", "a…. …b, ≮ ≮", "'s 't've", "日本。語, 12,3.4", "a b c \x1cd", "", "###word***", "ﬁne, K K. ñ."]


@pytest.mark.parametrize("remembered", [3, 40, 600_000])
def test_chunks_give_the_tokens_of_the_library(remembered):
    tokenizer, chunks = Tokenizer.from_file(BPE), tg.ChunkIds(BPE, remembered)
    rng = random.Random(4)
    letters = "abcßéÉ 'İ.,!<|>1２日…̸ \t "
    texts = ODD + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(1500)]
    for begin in range(0, len(texts), 50):
        part = [*texts[begin : begin + 50], None]
        ids, ends = chunks.encode(pa.array(["not seen", *part]).slice(1))
        for text, first, last in zip(part, [0, *ends], ends, strict=False):
            assert ids[first:last].tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids, text


def test_strings_are_copied_in_blocks_and_batches_are_looked_up_at_once(monkeypatch):
    """Ids of known strings do not depend on the size of a block; a usual batch of Spark's is one piece."""
    rng = np.random.default_rng(4)
    pool, lengths = tg.IdPool(), rng.integers(0, 5, 50)
    ids = rng.integers(0, 1 << 30, int(lengths.sum())).astype(np.uint32)
    pool.add(pa.array([f"s{i}" for i in range(50)]), ids, lengths)
    numbers, begins = rng.integers(0, 50, 1000), np.cumsum(lengths) - lengths
    expected = np.concatenate([ids[begins[n] : begins[n] + lengths[n]] for n in numbers])
    monkeypatch.setattr(tg, "TAKEN", 7)
    found, sizes = pool.take(numbers)
    assert (found == expected).all() and (sizes == lengths[numbers]).all()
    assert len(pool.take(numbers[:0])[0]) == 0
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * 2500] * 9000)], ["text"])
    assert len(list(tg.pieces_of(batch, limit=tg.ENCODE_BYTES))) == 1


def test_texts_are_encoded_in_pieces_of_bounded_size():
    batch = pa.record_batch({"text": pa.array(["a" * n if n else None for n in (5, 0, 3, 30, 1, 1, 9)])})
    parts = [p.num_rows for p in tg.pieces_of(batch, limit=10)]
    assert sum(parts) == 7 and len(parts) > 2
    assert [p for p in tg.pieces_of(batch.slice(0, 0))] == []


def test_registered_token_files(spark):
    tokenizer, start = Tokenizer.from_file(BPE), 0
    rows = {r["doc_id"]: r for r in QUERIES["op12_token_files"](spark, SF_DIR).collect()}
    for d in sorted(pq.read_table(f"{SF_DIR}/documents.parquet").to_pylist(), key=lambda d: d["doc_id"]):
        ids = [*tokenizer.encode(d["text"] or "", add_special_tokens=False).ids, 2]
        assert tuple(rows[d["doc_id"]])[1:] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_token_files_of_odd_tables(spark, documents, tmp_path):
    rows = [(3, "b b", "s"), (None, "null id", "s"), (1, None, "s"), (2, "", "s"), (1, "same id", "s"), (1, "same id", "s")]
    docs = documents(rows).withColumn("data", F.lit("x")).withColumn("id", F.lit("x")).withColumn("shard", F.lit(1))
    folder = f"{tmp_path}/odd"
    tg.write_token_files(docs, BPE, folder, end_id=2, shard_tokens=4)
    got = tg.read_token_files(spark, folder).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, 1, 1, 1, 2, 3]
    encode = lambda t: [*Tokenizer.from_file(BPE).encode(t or "", add_special_tokens=False).ids, 2]
    assert sorted(np.frombuffer(r["ids"], "<u4").tolist() for r in got) == sorted(encode(t) for _, t, _ in rows)
    every = np.concatenate([np.frombuffer(r["ids"], "<u4") for r in got])
    places = {r["position"]: r["token_id"] for r in tg.read_range(spark, folder, 3, 9).collect()}
    assert places == {i: int(every[i]) for i in range(3, 9)}
    tg.write_token_files(docs.limit(0), BPE, f"{tmp_path}/empty", end_id=2)
    assert tg.read_token_files(spark, f"{tmp_path}/empty").collect() == []


# -- whitening -------------------------------------------------------------------------------


@pytest.mark.parametrize("bits", [1, 12, 17, 31, 63])
def test_scatter_is_exact(bits):
    rng = np.random.default_rng(bits)
    x = rng.integers(-(2 ** (bits - 1)), 2 ** (bits - 1), (4500 if bits < 40 else 70, 5))
    s = wh.Scatter(5)
    s.add(x)
    exact = x.astype(object)
    assert s.n == len(x) and s.sums.tolist() == exact.sum(axis=0).tolist()
    assert s.products.tolist() == (exact.T @ exact).tolist()


def test_registered_whitening(spark):
    vectors = {r["vec_id"]: r["embedding"] for r in pq.read_table(f"{SF_DIR}/embeddings.parquet").to_pylist()}
    x = {i: [math.floor(1024 * c) + 100_000 for c in v] for i, v in vectors.items()}
    n, all_x = len(x), np.array(list(x.values()), float)
    values, axes = np.linalg.eigh(np.cov(all_x.T, bias=True))
    rows = QUERIES["op13_embedding_whitening"](spark, SF_DIR).collect()
    assert len(rows) == 8 * n and {r["n"] for r in rows} == {n}
    sums = [sum(v[k] for v in x.values()) for k in range(64)]
    own = np.zeros((8, n))
    place = {i: k for k, i in enumerate(x)}
    for r in rows:
        assert r["deviation"] == sum((n * a - s) ** 2 for a, s in zip(x[r["vec_id"]], sums, strict=True))
        assert r["explained"] == pytest.approx(values[-r["component"]] / values.sum(), rel=1e-9)
        own[r["component"] - 1, place[r["vec_id"]]] = r["whitened"]
    measured = np.abs(np.cov(own, bias=True) - np.eye(8)).max()
    assert measured < 1e-9 and max(r["identity_error"] for r in rows) < 1e-9
    for k in range(8):
        expected = (all_x - all_x.mean(axis=0)) @ axes[:, -1 - k] / math.sqrt(values[-1 - k])
        assert np.allclose(own[k], expected, atol=1e-7) or np.allclose(own[k], -expected, atol=1e-7)


def vectors_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def test_unusable_vectors_give_no_rows(spark):
    good = [(i, [float(i % 3), float(i % 5), 1.0]) for i in range(30)]
    bad = [(90, None), (91, []), (92, [1.0, None, 2.0]), (93, [1.0, math.nan, 2.0]), (94, [math.inf, 1.0, 2.0]), (95, [1.0, 2.0]), (96, [3e38, 1.0, 1.0])]
    rows = vectors_of(spark, [*good, *bad, (None, [0.0, 1.0, 1.0]), (5, [2.0, 0.0, 1.0])])
    rows = rows.withColumns({c: F.lit("x") for c in ("id", "vector", "n", "component", "length", "i")})
    got = wh.whitened(rows).collect()
    assert {r["vec_id"] for r in got} == {None, *range(30)}
    assert {r["component"] for r in got} == {1, 2} and {r["n"] for r in got} == {32}  # the third dimension does not vary
    assert sum(r["vec_id"] == 5 for r in got) == 4


def test_too_little_to_whiten(spark):
    assert wh.whitened(vectors_of(spark, [])).collect() == []
    assert wh.whitened(vectors_of(spark, [(1, [1.0, 2.0])])).collect() == []
    assert wh.whitened(vectors_of(spark, [(1, [1.0]), (2, [1.0]), (3, None)])).collect() == []
    two = wh.whitened(vectors_of(spark, [(1, [1.0]), (2, [3.0])])).collect()
    assert sorted(r["whitened"] for r in two) == pytest.approx([-1.0, 1.0])


def test_vectors_of_several_batches():
    x = pa.array([[1.0, 2.0], None, [0.5, -0.5], [3.0]], pa.list_(pa.float32())).slice(1)
    assert [(rows.tolist(), found.tolist()) for rows, found in wh.integer_vectors(x)] == [([2], [[103072]]), ([1], [[100512, 99488]])]
