"""Near duplicates: improved consistent weighted sampling over TF-IDF weighted word shingles.

Each text is a set of five-word shingles with weights (1 + ln tf) * idf. Improved consistent weighted sampling
draws from it so that two texts draw the same with a probability equal to their weighted Jaccard
similarity; draws are grouped in bands, texts that share a band are candidates, and a pair becomes a
link only if its weighted Jaccard similarity, computed from the whole texts, reaches the threshold.

Equal texts are one node. Within a band bucket every text is first compared with the bucket's most
central one, the text whose buckets are largest: of edited copies that is the original, whatever its id.
Links are joined to classes. What the bands leave - other members of a bucket, and pairs that miss every band - an exact join
finds: every pair of different classes that can reach the threshold, so that none is lost. All shingles have one order, the
rarest first, and what two texts have in common lies behind the first shingle they share. It must weigh
``similarity / (1 + similarity)`` of both texts together, so that shingle is among the rarest ninth (at 0.8) of one text's weight
and the rarest fifth of the other's. Texts that are only half alike differ in their rarest shingles and do not meet. Within a
class nothing is compared again. Before whole texts meet, their weights per cell of a small table do: what two texts have in common
is at most what both have in each cell, so that pairs that are far apart are dropped without opening a text. A group whose texts are all a little below the threshold may cost as many comparisons as it has
pairs. ``exact=False`` lets only members of *open* buckets take part in that join, those whose other members are still in several
classes - texts that share a passage or a form, say; pairs that miss every band are lost then.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattline.llm.common import slices, small_enough, stored, text_bytes, word_list
from wattline.llm.components import connected_components

SHINGLE = 5
SIMILARITY = 0.8
#: A pair at the threshold misses all bands with probability (1 - 0.8 ** 3) ** 14 = 4e-5.
BANDS, ROWS = 14, 3
#: Document frequencies are counted per hash bucket of shingles: the table has this fixed size
#: whatever the corpus, so that it can be given to every task.
BUCKETS = 1 << 18
#: How much more a shingle of one document weighs than one of all: idf runs from 1 to 1 + this.
#: It is small so that edits of a much-copied text do not outweigh what the copies share.
IDF_GAIN = 0.25
#: Most bits of the table of shingles that several classes have, for each task; it has ``KEY_BITS`` per shingle until then.
MIXED_BITS, KEY_BITS = 1 << 27, 128
#: Bits on one page of that table, as Spark's bitmap functions have them.
PAGE_BITS = 1 << 15
#: Steps in which cells count the weight of a text.
CELL_STEPS = 16

_P = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2, _M3 = (np.uint64(m) for m in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Hashes of the shingles of a text: polynomials of its bytes, words apart by one space, mixed."""

    #: Words worked on at a time: their numbers stay in a core's cache.
    PLACES = 4096

    def __init__(self, width: int = SHINGLE):
        self.width = width
        self.of_byte = _mix(np.arange(1, 257, dtype=np.uint64) * _M3)
        self._powers(1 << 15)

    def _powers(self, n: int) -> None:
        steps = np.full(n, _P)
        steps[0] = 1
        self.powers = np.cumprod(steps)
        steps[1:] = np.uint64(pow(int(_P), -1, 1 << 64))
        self.inverse = np.cumprod(steps)

    def hashes(self, words: list[bytes]) -> np.ndarray:
        """One hash per place; a text of fewer words is one shingle."""
        width = min(self.width, len(words))
        total = np.empty(len(words) - width + 1, np.uint64)
        for begin in range(0, len(total), self.PLACES):
            part = words[begin : begin + self.PLACES + width - 1]
            text = np.frombuffer(b" ".join(part), np.uint8)
            if len(text) > len(self.powers):
                self._powers(2 * len(text))
            run = np.zeros(len(text) + 1, np.uint64)
            np.cumsum(self.of_byte[text] * self.powers[: len(text)], out=run[1:])
            gaps = (text == 0x20).nonzero()[0]
            first = np.append(0, gaps + 1)[: len(part) - width + 1]
            last = np.append(gaps, len(text))[width - 1 :]
            total[begin : begin + len(first)] = (run[last] - run[first]) * self.inverse[first]
        return _mix(total)

    def counted(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(self.hashes(words), return_counts=True)


@dataclass(frozen=True)
class Weights:
    """Weights of shingles, from document frequencies per hash bucket."""

    idf: np.ndarray

    @staticmethod
    def from_frequencies(frequency: np.ndarray, documents: int) -> Weights:
        rarity = np.log((documents + 1) / (np.minimum(frequency, documents) + 1)) / np.log(documents + 2)
        return Weights((1 + IDF_GAIN * rarity).astype(np.float32))

    def idf_of(self, shingles: np.ndarray) -> np.ndarray:
        return self.idf[(shingles % np.uint64(len(self.idf))).astype(np.int64)]

    def of(self, shingles: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return (1 + np.log(counts)) * self.idf_of(shingles)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of minima over sum of maxima of two weighted sets (sorted shingles, weights)."""
    _, in_a, in_b = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = float(np.minimum(a[1][in_a], b[1][in_b]).sum())
    total = float(a[1].sum() + b[1].sum()) - common
    return common / total if total > 0 else 0.0


def _cells(shingles: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Weight in each of 2^k cells of shingles by hash, about one per shingle, in steps, rounded up; 255 stands for more, too."""
    n = max(8, 1 << len(shingles).bit_length() - 1)
    summed = np.bincount((shingles % np.uint64(n)).astype(np.int64), weights, minlength=n)
    return np.minimum(np.ceil(summed * CELL_STEPS), 255).astype(np.uint8)


def _most_alike(a: np.ndarray, b: np.ndarray, weight_a: float, weight_b: float) -> float:
    """The weighted Jaccard similarity is at most this, by the cells of two texts and their weights."""
    n = min(len(a), len(b))
    a, b = (x.reshape(-1, n) for x in (a, b))
    least = np.minimum(a.sum(axis=0, dtype=np.int64), b.sum(axis=0, dtype=np.int64)).sum() / CELL_STEPS
    # A full cell may hold more than it says; then the weights alone decide.
    common = min(weight_a, weight_b, least if max(a.max(), b.max()) < 255 else np.inf)
    return common / (weight_a + weight_b - common)


def _halves(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return values.astype(np.uint32), (values >> np.uint64(32)).astype(np.uint32)


class Sampler:
    """Improved consistent weighted sampling: for each of K draws, the shingle that has the smallest

        a = c / (y exp(r)),  y = exp(r (t - beta)),  t = floor(ln w / r + beta),

    with r, c from Gamma(2, 1) and beta from U(0, 1), fixed by (draw, shingle); the draw is (shingle, t).
    """

    #: (draw, shingle) pairs worked on at a time: their numbers stay in a core's cache.
    PLACES = 30_000

    def __init__(self, bands: int = BANDS, rows: int = ROWS):
        self.bands, self.rows = bands, rows
        draws = bands * rows
        self.block = max(64, self.PLACES // draws)
        seeds = _mix(np.arange(1, draws + 1, dtype=np.uint64) * _M3)
        self.low, self.high = (half[:, None] for half in _halves(seeds))
        # Numbers are written where others were: new memory for each step would cost more than the step.
        self.room = [np.empty(draws * self.block, np.uint32) for _ in range(7)]

    def draws(self, shingles: np.ndarray, weights: np.ndarray) -> np.ndarray:
        n = len(self.low)
        best, drawn = np.full(n, np.inf, np.float32), np.zeros(n, np.uint64)
        row, log_w = np.arange(n), np.log(weights).astype(np.float32)
        low, high = _halves(shingles)
        for begin in range(0, len(shingles), self.block):
            end = min(begin + self.block, len(shingles))
            x, y, bits, other, *floats = (own[: n * (end - begin)].reshape(n, end - begin) for own in self.room)
            r, log_c, t = (own.view(np.float32) for own in floats)

            def stir(value: np.ndarray, factor: int, shift: int) -> None:
                np.multiply(value, np.uint32(factor), out=value)
                np.right_shift(value, np.uint32(shift), out=bits)
                np.bitwise_xor(value, bits, out=value)

            def gamma(value: np.ndarray, out: np.ndarray) -> None:
                """-ln(u v), u and v being the halves of ``value``, made odd, over 2^16; overwrites ``t``."""
                np.bitwise_or(value, np.uint32(0x10001), out=bits)
                np.right_shift(bits, np.uint32(16), out=other)
                np.bitwise_and(bits, np.uint32(0xFFFF), out=bits)
                np.copyto(out, bits.view(np.int32))
                np.copyto(t, other.view(np.int32))
                np.multiply(out, t, out=out)
                np.log(out, out=out)
                np.subtract(np.float32(32 * np.log(2)), out, out=out)

            np.bitwise_xor(low[begin:end], self.low, out=x)
            stir(x, 0x7FEB352D, 15)
            np.bitwise_xor(x, high[begin:end], out=x)
            np.add(x, self.high, out=x)
            stir(x, 0x846CA68B, 16)
            np.copyto(y, x)
            stir(y, 0x9E3779B1, 15)
            stir(y, 0x85EBCA77, 13)
            gamma(x, r)
            gamma(y, log_c)
            np.log(log_c, out=log_c)
            np.bitwise_xor(x, y, out=x)
            np.multiply(x, np.uint32(0xC2B2AE3D), out=x)
            np.right_shift(x, np.uint32(8), out=x)
            log_a = y.view(np.float32)  # beta at first
            np.copyto(log_a, x.view(np.int32))
            np.multiply(log_a, np.float32(2**-24), out=log_a)
            np.divide(log_w[begin:end], r, out=t)
            np.add(t, log_a, out=t)
            np.floor(t, out=t)
            np.subtract(log_a, t, out=log_a)
            np.subtract(log_a, np.float32(1), out=log_a)
            np.multiply(log_a, r, out=log_a)
            np.add(log_a, log_c, out=log_a)
            at = log_a.argmin(axis=1)
            smallest = log_a[row, at]
            better = smallest < best
            here = _mix(shingles[begin:end][at] ^ _mix(t[row, at].astype(np.int64).astype(np.uint64) + _P))
            best[better], drawn[better] = smallest[better], here[better]
        return drawn

    def band_keys(self, shingles: np.ndarray, weights: np.ndarray) -> np.ndarray:
        drawn = self.draws(shingles, weights).reshape(self.bands, self.rows)
        keys = np.arange(1, self.bands + 1, dtype=np.uint64)
        for i in range(self.rows):
            keys = _mix(keys * _P + drawn[:, i])
        return keys.view(np.int64)


def shingle_frequencies(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, int]:
    """In how many documents a shingle of each hash bucket occurs (counted over all of them), and their number."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, totals, documents = Shingler(), np.zeros(BUCKETS, np.int64), 0
        for batch in slices(batches):
            found = []
            for value in text_bytes(batch, "text"):
                if words := word_list(value):
                    distinct = np.unique(shingler.hashes(words))
                    found.append((distinct % np.uint64(BUCKETS)).astype(np.int64))
                    documents += 1
            if found:
                totals += np.bincount(np.concatenate(found), minlength=BUCKETS)
        if documents:
            used = totals.nonzero()[0]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(used, -1).astype(np.int32)), pa.array(np.append(totals[used], documents))],
                ["bucket", "n"],
            )

    partial = docs.select(docs[text].alias("text")).mapInArrow(count, "bucket int, n long")
    # At most BUCKETS + 1 rows.
    rows = partial.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    bucket, n = rows.column("bucket").to_numpy(), rows.column("n").to_numpy()
    frequency = np.zeros(BUCKETS, np.int64)
    frequency[bucket[bucket >= 0]] = n[bucket >= 0]
    return frequency, int(n[bucket < 0].sum())


def signatures(docs: DataFrame, weights, similarity: float | None = None) -> DataFrame:
    """doc_id, content (digest of the word sequence, null without words), bands, for each row of ``docs``.

    With a similarity also what ``_rarest`` gives for each text: weight, keys, lefts.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, sampler, known = Shingler(), Sampler(), {}
        for batch in slices(batches):
            contents, bands, rare = [], [], []
            for value in text_bytes(batch, "text"):
                words = word_list(value)
                if not words:
                    contents.append(None)
                    bands.append(None)
                    rare.append((None, None, None))
                    continue
                content = hashlib.md5(b" ".join(words), usedforsecurity=False).digest()
                counted = None
                if content not in known:
                    if len(known) > 20_000:
                        known.clear()
                    counted = shingler.counted(words)
                    known[content] = sampler.band_keys(counted[0], weights.value.of(*counted))
                contents.append(content)
                bands.append(known[content])
                if similarity:
                    rare.append(_rarest(*(counted or shingler.counted(words)), weights.value, similarity))
            columns = [batch.column("doc_id"), pa.array(contents, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
            if similarity:
                kinds = (pa.float32(), pa.list_(pa.int64()), pa.list_(pa.float32()))
                columns += [pa.array(column, kind) for column, kind in zip(zip(*rare, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", "content", "bands", *(["weight", "keys", "lefts"] if similarity else [])]
    kind = docs.schema["doc_id"].dataType.simpleString()
    kinds = [kind, "binary", "array<long>", "float", "array<long>", "array<float>"]
    return docs.select("doc_id", "text").mapInArrow(sign, ", ".join(f"{n} {k}" for n, k in zip(names, kinds)))


def _rarest(shingles: np.ndarray, counts: np.ndarray, weights: Weights, similarity: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Weight of a text, its rarest shingles as keys, and what remains of the weight from each of them on.

    Shingles are in one order for all texts, by frequency, then by hash. What two texts of the similarity have in common weighs
    at least ``similarity`` times either text; so where it begins, that much is left of each. Weights are rounded to single
    precision, which errs by less than the 1e-6 that comparisons leave.
    """
    weight = weights.of(shingles, counts).astype(np.float64)
    # idf falls with frequency, so that the rarest come first.
    order = np.lexsort((shingles, -weights.idf_of(shingles)))
    left = np.cumsum(weight[order][::-1])[::-1]
    keep = (left >= (similarity - 1e-6) * left[0]).nonzero()[0]
    return np.float32(left[0]), shingles[order[keep]].view(np.int64), left[keep].astype(np.float32)


def verified(pairs: DataFrame, docs: DataFrame, weights, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) of document ids whose whole texts are at least so similar."""
    pairs = _close(stored(pairs, "near-pairs"), docs, weights, similarity)
    texts = stored(_needed(pairs, docs), "near-texts")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, last, vector = Shingler(), None, None

        def weighed(value: bytes):
            shingles, counts = shingler.counted(word_list(value))
            return shingles, weights.value.of(shingles, counts)

        for batch in slices(batches, 64):
            keep = []
            for left, right in zip(text_bytes(batch, "text_a"), text_bytes(batch, "text_b"), strict=True):
                if left != last:
                    last, vector = left, weighed(left)
                keep.append(weighted_jaccard(vector, weighed(right)) >= similarity)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a").join(
        texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b"
    )
    kind = pairs.schema["a"].dataType.simpleString()
    found = both.select("a", "b", "text_a", "text_b").mapInArrow(compare, f"a {kind}, b {kind}")
    return stored(found.distinct(), "near-links")


def _needed(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """id, text of the documents in the pairs."""
    needed = stored(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "near-needed")
    side = F.broadcast(needed) if small_enough(needed, 60) else needed
    return docs.select(F.col("doc_id").alias("id"), "text").join(side, "id")


def _close(pairs: DataFrame, docs: DataFrame, weights, similarity: float) -> DataFrame:
    """The pairs that can be so similar by their cells, a tenth of the size of their texts."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in slices(batches):
            totals, cells = [], []
            for value in text_bytes(batch, "text"):
                shingles, counts = shingler.counted(word_list(value))
                weight = weights.value.of(shingles, counts)
                totals.append(weight.sum())
                cells.append(_cells(shingles, weight).tobytes())
            columns = [batch.column("id"), pa.array(totals, pa.float64()), pa.array(cells, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "weight", "cells"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            cells = ([np.frombuffer(c, np.uint8) for c in batch.column(name).to_pylist()] for name in ("cells_a", "cells_b"))
            weight = (batch.column(name).to_numpy() for name in ("weight_a", "weight_b"))
            most = [_most_alike(*both) for both in zip(*cells, *weight, strict=True)]
            keep = pa.array([m >= similarity - 1e-6 for m in most], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(keep)

    kind = pairs.schema["a"].dataType.simpleString()
    found = stored(_needed(pairs, docs).mapInArrow(weigh, f"id {kind}, weight double, cells binary"), "near-cells")
    both = pairs
    for end in ("a", "b"):
        both = both.join(found.select(*(F.col(c).alias(name) for c, name in (("id", end), ("weight", f"weight_{end}"), ("cells", f"cells_{end}")))), end)
    return stored(both.mapInArrow(compare, f"a {kind}, b {kind}").distinct(), "near-close")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, *, exact: bool = True) -> DataFrame:
    """doc_id, class_id for each row of ``docs``: the smallest id of the documents it is linked with.

    Texts with equal words are linked; so are texts of a similarity of at least ``similarity``, and
    whatever is connected through links. A text without words (null and empty ones) is alone. A
    text of fewer than five words is one shingle. Rows that share a doc_id count as one document;
    a null id is left alone. Only doc_id and text are read. Ties between central texts go to the smallest id.
    All pairs that can reach the threshold are compared, whether they share a band or not; only those that share one
    if ``exact`` is false.
    """
    docs = docs.select("doc_id", "text")
    frequency, documents = shingle_frequencies(docs)
    weights = docs.sparkSession.sparkContext.broadcast(Weights.from_frequencies(frequency, documents))
    signed = stored(signatures(docs, weights, similarity if exact else None), "signatures")

    contents = signed.filter(F.col("content").isNotNull() & F.col("doc_id").isNotNull())
    texts = stored(contents.groupBy("content").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")), "contents")
    bands = texts.select("rep", "bands")
    keyed = stored(bands.select("rep", F.explode("bands").alias("key")), "band-keys")

    # Texts without a link are classes of their own.
    classes = stored(bands.select(F.col("rep").alias("node"), F.col("rep").alias("component")).limit(0), "classes")
    keyed = stored(_central(keyed), "band-ranks")
    seen = stored(_with_leaders(keyed, classes), "leader-pairs")
    links = verified(seen, docs, weights, similarity)
    if not links.isEmpty():
        classes = connected_components(links)

    if exact:
        rare = _rare_of_all(contents, texts, keyed.select("rep", "central").distinct(), classes)
    else:
        members = stored(_open(keyed, classes).select("rep", "central").distinct(), "open")
        rare = stored(_rare_shingles(members, docs, weights, similarity), "rare-shingles")
        rare = stored(_mixed(rare, classes), "mixed-rare")
    links, classes = _every_pair(docs, weights, similarity, rare, seen, links, classes)

    same = stored(_within(texts, contents), "same-id")
    if not same.isEmpty():
        classes = connected_components(links.union(same))

    named = texts.join(classes.withColumnRenamed("node", "rep"), "rep", "left").select(
        "content", F.coalesce("component", "rep").alias("class")
    )
    # Documents without words or id stay out of the join: their null keys would all meet in one task.
    usable = F.col("content").isNotNull() & F.col("doc_id").isNotNull()
    alone = signed.filter(~usable).select("doc_id", F.col("doc_id").alias("class_id"))
    found = signed.filter(usable).select("doc_id", "content").join(named, "content")
    return found.select("doc_id", F.col("class").alias("class_id")).unionByName(alone)


def _every_pair(docs, weights, similarity, rare, seen, links, classes) -> tuple[DataFrame, DataFrame]:
    """Links and classes after comparing every pair of texts with a rare shingle in common, if it can reach the threshold.

    Pairs within a class are left out.
    """
    if rare.isEmpty():
        return links, classes
    for pairs_of in (_with_leaders, _all_pairs):
        new = stored(pairs_of(rare, classes, similarity).join(seen, ["a", "b"], "left_anti"), "rare-pairs")
        if new.isEmpty():
            continue
        found = verified(new, docs, weights, similarity)
        seen, links = seen.union(new), links.union(found)
        if not found.isEmpty():
            classes = connected_components(links)
    return links, classes


def _leaders(named: DataFrame, columns: list[Column]) -> DataFrame:
    """key, leader: the most central text of each bucket."""
    return named.groupBy("key").agg(F.min_by(F.struct(*columns), F.struct(-F.col("central"), "rep")).alias("leader"))


def _open(keyed: DataFrame, classes: DataFrame) -> DataFrame:
    """The rows of buckets in which texts of different classes have not been compared: all but the leader's, with whom all were."""
    named = _named(keyed, classes)
    others = named.join(_leaders(named, [F.col("rep")]), "key").filter(F.col("rep") != F.col("leader.rep"))
    several = others.groupBy("key").agg(F.min("of").alias("low"), F.max("of").alias("high")).filter("low <> high")
    return others.join(several.select("key"), "key").select(*keyed.columns)


def _central(keyed: DataFrame) -> DataFrame:
    """``keyed`` with ``central``: how many texts a text shares its buckets with, over all its bands."""
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > 1)
    shared = stored(keyed.join(sizes, "key").select("rep", "key", "n"), "bucket-sizes")
    central = shared.groupBy("rep").agg(F.sum("n").alias("central"))
    return shared.select("rep", "key").join(central, "rep")


def _reach(similarity: float) -> Column:
    """Whether two texts that have no shingle in common before this one can be similar; a little is left for rounding."""
    both = F.col("weight_a") + F.col("weight_b")
    return F.least("left_a", "left_b") * (1 + similarity) >= both * (similarity - 1e-6)


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _with_leaders(keyed: DataFrame, classes: DataFrame, similarity: float | None = None) -> DataFrame:
    """Pairs (a, b), a < b, of a bucket's most central text and each member of another class."""
    named = _named(keyed, classes)
    weight = ["weight", "left"] if similarity else []
    leaders = _leaders(named, [F.col(c) for c in ("rep", "of", *weight)])
    met = named.join(leaders, "key").filter(F.col("leader.of") != F.col("of"))
    both = met.select(
        F.col("leader.rep").alias("a"), F.col("rep").alias("b"),
        *(F.col(f"leader.{c}").alias(f"{c}_a") for c in weight), *(F.col(c).alias(f"{c}_b") for c in weight),
    )
    return _ordered(both.filter(_reach(similarity)) if similarity else both)


def _all_pairs(keyed: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b), a < b, of different classes with a rare shingle in common that can reach the similarity.

    Of such a pair one text, the lighter, has the shingle among its very rarest, so that only those rows look for others.
    The rows of a shingle's largest class do not meet each other.
    """
    named = _named(keyed, classes)
    early = F.col("left") * (1 + similarity) >= 2 * F.col("weight") * (similarity - 1e-6)
    sizes = named.groupBy("key", "of").agg(F.count("*").alias("n"), F.max(early).alias("early"))
    largest = sizes.groupBy("key").agg(
        F.max_by("of", F.struct("n", "of")).alias("largest"), F.max("early").alias("early"), F.count("*").alias("classes")
    )
    largest = largest.filter(F.col("early") & (F.col("classes") > 1)).select("key", "largest")
    rows = named.join(largest, "key").withColumn("side", (F.col("of") == F.col("largest")).cast("int"))
    early = rows.filter(early)
    left = early.select("key", "side", *(F.col(c).alias(f"{c}_a") for c in ("rep", "of", "weight", "left")))
    meets = F.explode(F.when(F.col("side") == 1, F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1))))
    right = rows.select("key", meets.alias("side"), *(F.col(c).alias(f"{c}_b") for c in ("rep", "of", "weight", "left")))
    met = left.join(right, ["key", "side"]).filter((F.col("of_a") != F.col("of_b")) & _reach(similarity))
    return _ordered(met.select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")))


def _mixed(keyed: DataFrame, classes: DataFrame) -> DataFrame:
    """The rows of buckets that hold several classes."""
    named = _named(keyed, classes)
    mixed = named.groupBy("key").agg(F.min("of").alias("low"), F.max("of").alias("high")).filter(F.col("low") != F.col("high"))
    return keyed.join(mixed.select("key"), "key")


def _named(keyed: DataFrame, classes: DataFrame) -> DataFrame:
    side = F.broadcast(classes) if small_enough(classes, 60) else classes
    named = keyed.join(side.withColumnRenamed("node", "rep"), "rep", "left")
    return named.select(*keyed.columns, F.coalesce("component", "rep").alias("of"))


def _rare_shingles(reps: DataFrame, docs: DataFrame, weights, similarity: float) -> DataFrame:
    """rep, central, weight, left, key for each shingle (key) among the rarest of a text (see ``_rarest``)."""
    side = F.broadcast(reps) if small_enough(reps, 60) else reps
    texts = docs.withColumnRenamed("doc_id", "rep").join(side, "rep").select("rep", "central", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in slices(batches, 64):
            at, totals, rests, keys = [], [], [], []
            for i, value in enumerate(text_bytes(batch, "text")):
                if not (words := word_list(value)):
                    continue
                weight, rarest, left = _rarest(*shingler.counted(words), weights.value, similarity)
                at.append(np.full(len(left), i))
                totals.append(np.full(len(left), weight, np.float32))
                rests.append(left)
                keys.append(rarest)
            if keys:
                place = pa.array(np.concatenate(at))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("rep").take(place), batch.column("central").take(place),
                     *(pa.array(np.concatenate(column)) for column in (totals, rests, keys))],
                    ["rep", "central", "weight", "left", "key"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(cut, f"rep {kind}, central long, weight float, left float, key long")


def _rare_of_all(contents: DataFrame, texts: DataFrame, central: DataFrame, classes: DataFrame) -> DataFrame:
    """What ``_rare_shingles`` gives for all texts, from their signatures; only shingles that several classes have, and few others.

    Nearly all shingles are in one text only, so that few rows are left to be joined. Those in several classes are told to all
    tasks as a table of bits of limited size, so that no text's other shingles are shuffled again; a bit that is set by another
    shingle costs a row and no pair.
    """
    copies = stored(contents.select("doc_id", "content").join(texts.select("content", "rep"), "content").filter("doc_id <> rep"), "copies")
    other = F.broadcast(copies) if small_enough(copies, 60) else copies
    own = contents.withColumnRenamed("doc_id", "rep").join(
        other.select(F.col("doc_id").alias("rep"), "content"), ["rep", "content"], "left_anti"
    )
    named = classes.withColumnRenamed("node", "rep")
    named = F.broadcast(named) if small_enough(classes, 60) else named
    of = own.select("rep", "keys").join(named, "rep", "left").select(F.coalesce("component", "rep").alias("of"), F.explode("keys").alias("key"))
    several = of.groupBy("key").agg(F.min("of").alias("low"), F.max("of").alias("high")).filter("low <> high")
    several = stored(several.select("key"), "mixed-keys")
    shift, table = _bits(several)
    table = own.sparkSession.sparkContext.broadcast(table)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024):
            keys, lefts = (batch.column(name).flatten() for name in ("keys", "lefts"))
            place = keys.to_numpy().view(np.uint64) >> np.uint64(shift)
            keep = (table.value[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
            row = np.repeat(np.arange(batch.num_rows), batch.column("keys").value_lengths().to_numpy())[keep]
            ends = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32))
            lists = (pa.ListArray.from_arrays(ends, column.filter(pa.array(keep))) for column in (keys, lefts))
            found = pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("weight"), *lists], ["rep", "weight", "keys", "lefts"])
            yield found.filter(pa.array(np.diff(ends.to_numpy()) > 0))

    kind = contents.schema["doc_id"].dataType.simpleString()
    rows = own.select("rep", "weight", "keys", "lefts").mapInArrow(cut, f"rep {kind}, weight float, keys array<long>, lefts array<float>")
    rows = rows.join(central, "rep", "left").select(
        "rep", F.coalesce("central", F.lit(0)).alias("central"), "weight", F.explode(F.arrays_zip("keys", "lefts")).alias("at")
    )
    return stored(rows.select("rep", "central", "weight", F.col("at.lefts").alias("left"), F.col("at.keys").alias("key")), "rare-shingles")


def _bits(keys: DataFrame) -> tuple[int, np.ndarray]:
    """By how much to shift a key, and a table of bits: that of a key is set, and few others; at most ``MIXED_BITS`` of any number of keys.

    Places are the first bits of keys: rare shingles are much alike in the last ones, which are their bucket's.
    """
    bits = min(MIXED_BITS, max(PAGE_BITS, 1 << (KEY_BITS * keys.count()).bit_length()))
    shift = 64 - (bits.bit_length() - 1)
    place = F.shiftrightunsigned("key", shift)
    pages = keys.groupBy(F.floor(place / PAGE_BITS).alias("page")).agg(F.bitmap_construct_agg(place % PAGE_BITS).alias("bits")).toArrow()
    table = np.zeros((bits // PAGE_BITS, PAGE_BITS // 8), np.uint8)
    for page, found in zip(pages.column("page").to_pylist(), pages.column("bits").to_pylist(), strict=True):
        table[page] = np.frombuffer(found, np.uint8)
    return shift, table.ravel()


def _within(exact: DataFrame, contents: DataFrame) -> DataFrame:
    """Edges between the nodes that rows sharing a doc_id belong to; there are none if ids are unique."""
    several = contents.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("content").alias("c")).filter(F.col("n") > 1)
    rows = contents.join(several.select("doc_id"), "doc_id").select("doc_id", "content").distinct()
    nodes = rows.join(exact.select("content", "rep"), "content")
    return nodes.filter(F.col("doc_id") != F.col("rep")).select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).distinct()
