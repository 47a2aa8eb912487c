"""Periodic runs of words, found by block convolution.

A run is a maximal stretch of words with smallest period q that is at least ``LEAST_EXPONENT`` periods
and ``LEAST_LENGTH`` words long. At the dyadic scale B (1, 2, 4, ...) the text is cut into blocks of B words. A
run with B <= q < 2 B holds at least two neighbouring blocks that occur again q words later, and each such
place lies in the window of the 2 B - 1 words that follow the block. The sum of squared differences

    sum (x[i] - y[i + d])^2 = sum x^2 + sum y^2 - 2 sum x[i] y[i + d]

of word numbers is zero exactly where the block occurs; the last term is one cyclic convolution per
block, computed for all blocks of a scale at once by a number-theoretic transform. Modulo one prime, zero is
necessary; it is certain modulo so many primes that their product exceeds the largest possible sum, and the
further primes are only asked for blocks that have a zero. Neighbouring blocks with the same distance
form a chain, whose ends are extended word by word.

Nothing is searched twice: a block that lies with its window in a run of smaller period is passed over, because a stretch
of period d that holds d + q words of a run of period q < d has a period smaller than d. A block with a word
that does not come again within the window cannot occur there, so that no convolution is made for it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from wattline.llm.common import slices, text_bytes

LEAST_LENGTH, LEAST_EXPONENT = 6, 4
#: Primes k 2^m + 1 with m >= 23 and primitive root 3: transforms of up to 2^23 places.
PRIMES, ROOT = (998_244_353, 469_762_049, 167_772_161), 3
#: Texts are searched together until they have so many words; a longer text is searched alone.
GROUP_WORDS = 1 << 16
#: Places transformed at a time: bounds memory, whatever the number of blocks.
CHUNK = 1 << 17

_FAR = np.iinfo(np.int64).max


class Transform:
    """Number-theoretic transforms of one length modulo one prime, over columns.

    The forward transform leaves its result in bit-reversed order, in which the inverse takes it.
    """

    def __init__(self, length: int, prime: int):
        self.length, self.prime = length, np.uint64(prime)
        root = pow(ROOT, (prime - 1) // length, prime)
        self.roots = self._powers(root, length // 2, prime)
        self.inverse_roots = self._powers(pow(root, -1, prime), length // 2, prime)
        self.scale = np.uint64(pow(length, -1, prime))

    @staticmethod
    def _powers(root: int, n: int, prime: int) -> np.ndarray:
        powers = np.ones(max(n, 1), np.uint64)
        have = 1
        while have < n:
            powers[have : 2 * have] = powers[:have] * np.uint64(pow(root, have, prime)) % np.uint64(prime)
            have *= 2
        return powers[:n]

    def _sum(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        total = a + b
        return np.minimum(total, total - self.prime)  # unsigned: a negative value is a large one

    def forward(self, values: np.ndarray) -> np.ndarray:
        half = self.length // 2
        while half:
            pairs = values.reshape(-1, 2, half, values.shape[1])
            a, b = pairs[:, 0], pairs[:, 1]
            turn = self.roots[:: len(self.roots) // half][None, :, None]
            difference = (a + (self.prime - b)) * turn % self.prime
            pairs[:, 0] = self._sum(a, b)
            pairs[:, 1] = difference
            half //= 2
        return values

    def inverse(self, values: np.ndarray) -> np.ndarray:
        half = 1
        while half < self.length:
            pairs = values.reshape(-1, 2, half, values.shape[1])
            turn = self.inverse_roots[:: len(self.inverse_roots) // half][None, :, None]
            a, b = pairs[:, 0], pairs[:, 1] * turn % self.prime
            difference = self._sum(a, self.prime - b)
            pairs[:, 0] = self._sum(a, b)
            pairs[:, 1] = difference
            half *= 2
        return values * self.scale % self.prime


class BlockSearch:
    """Zero-mismatch places of blocks in their windows. ``words`` holds numbers from 1; 0 ends a text."""

    def __init__(self, words: np.ndarray, largest_block: int):
        # Windows may reach beyond the end, where nothing matches.
        self.words = np.concatenate([words, np.zeros(4 * largest_block, np.int64)]).astype(np.uint64)
        self.largest = int(words.max(initial=0))
        self.squares: dict[int, np.ndarray] = {}
        self.transforms: dict[tuple[int, int], Transform] = {}

    def _squares(self, prime: int) -> np.ndarray:
        if prime not in self.squares:
            p = np.uint64(prime)
            each = (self.words % p) ** np.uint64(2) % p
            self.squares[prime] = np.concatenate([[np.uint64(0)], np.cumsum(each, dtype=np.uint64)])
        return self.squares[prime]

    def _zero(self, starts: np.ndarray, block: int, prime: int) -> np.ndarray:
        """For each distance from ``block`` on (rows) and each block (columns), whether the sum is 0 modulo the prime."""
        length, p = 2 * block, np.uint64(prime)
        if (length, prime) not in self.transforms:
            self.transforms[length, prime] = Transform(length, prime)
        transform = self.transforms[length, prime]
        x = np.zeros((length, len(starts)), np.uint64)
        x[(-np.arange(block)) % length] = self.words[starts + np.arange(block)[:, None]] % p
        y = self.words[starts + block + np.arange(length)[:, None]] % p
        product = transform.inverse(transform.forward(x) * transform.forward(y) % p)[:block]
        sums = self._squares(prime)
        at = starts + block + np.arange(block)[:, None]
        both = (sums[starts + block] - sums[starts]) + (sums[at + block] - sums[at])
        return both % p == (product + product) % p

    def places(self, starts: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
        """(start, distance) for every block of ``starts`` and every distance in [block, 2 block) at which it occurs again."""
        found: list[tuple[np.ndarray, np.ndarray]] = []
        step = max(1, CHUNK // (2 * block))
        for begin in range(0, len(starts), step):
            part = starts[begin : begin + step]
            zero, bound = self._zero(part, block, PRIMES[0]), PRIMES[0]
            for prime in PRIMES[1:]:
                hit = zero.any(axis=0)
                part, zero = part[hit], zero[:, hit]
                if bound > block * self.largest**2 or not len(part):
                    break
                zero &= self._zero(part, block, prime)
                bound *= prime
            distance, column = zero.nonzero()
            start, distance = part[column], distance + block
            if bound <= block * self.largest**2:  # texts of billions of words: compare what is left
                same = [np.array_equal(self.words[s : s + block], self.words[s + d : s + d + block]) for s, d in zip(start, distance, strict=True)]
                start, distance = start[same], distance[same]
            found.append((start, distance))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([s for s, _ in found]), np.concatenate([d for _, d in found])


class Covered:
    """Stretches that are known; whether a stretch lies in one of them."""

    def __init__(self, runs: list[tuple[int, int, int]]):
        ordered = sorted(runs)
        self.starts = np.array([-1, *(s for s, _, _ in ordered)])
        self.ends = np.maximum.accumulate(np.array([-1, *(s + n for s, n, _ in ordered)]))

    def holds(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        return self.ends[np.searchsorted(self.starts, first, "right") - 1] >= end


def next_same(words: np.ndarray) -> np.ndarray:
    """Distance from each word to the next place of the same word; far for none and for the ends of texts."""
    order = np.argsort(words, kind="stable")
    distance = np.full(len(words), _FAR)
    follows = words[order[1:]] == words[order[:-1]]
    distance[order[:-1][follows]] = (order[1:] - order[:-1])[follows]
    distance[words == 0] = _FAR
    return distance


def runs_of(words: np.ndarray, longest: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs in texts of numbers from 1, each preceded and followed by a 0."""
    runs: list[tuple[int, int, int]] = []
    largest_block = 1 << max(0, (longest // LEAST_EXPONENT).bit_length() - 1)
    search = None
    reach, block = next_same(words), 1
    while LEAST_EXPONENT * block <= longest:
        live = reach < 2 * block
        both = live[:-1] & live[1:]  # the blocks of a run come in pairs at least
        starts = (np.append(both, False) | np.append(False, both)).nonzero()[0] * block
        covered = Covered(runs)
        starts = starts[~covered.holds(starts, starts + 3 * block)]
        if len(starts):
            search = search or BlockSearch(words, largest_block)
            start, distance = search.places(starts, block)
            new = ~covered.holds(start, start + block + distance)
            runs += extended(search.words, start[new], distance[new], block)
        reach = np.maximum(reach[: len(reach) // 2 * 2 : 2], reach[1::2])
        block *= 2
    return sorted(runs, key=lambda run: (run[0], run[2]))


def extended(words: np.ndarray, start: np.ndarray, distance: np.ndarray, block: int) -> list[tuple[int, int, int]]:
    """Runs from the places of one scale: chains of neighbouring blocks with one distance, extended at both ends."""
    order = np.lexsort((start, distance))
    start, distance = start[order], distance[order]
    first = np.append(True, (np.diff(distance) != 0) | (np.diff(start) != block))[: len(start)].nonzero()[0]
    blocks = np.diff(np.append(first, len(start)))
    begin, period = start[first], distance[first]
    most = blocks * block + 2 * (block - 1) + period
    far_enough = most >= np.maximum(LEAST_LENGTH, LEAST_EXPONENT * period)
    found = []
    for b, n, d in zip(begin[far_enough].tolist(), blocks[far_enough].tolist(), period[far_enough].tolist(), strict=True):
        left = words[b - block : b] == words[b - block + d : b + d]
        end = b + n * block
        right = words[end : end + block] == words[end + d : end + d + block]
        if left.all() or right.all():
            continue  # the neighbour matches too but was passed over: the period is no smallest one
        before = int(left[::-1].argmin())
        after = int(right.argmin())
        length = before + n * block + after + d
        if length >= max(LEAST_LENGTH, LEAST_EXPONENT * d):
            found.append((b - before, length, d))
    return found


class _Numbers(dict):
    """Numbers of words, from 1 in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self) + 1
        return number


def search_texts(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """Runs of each of some texts (lists of words), searched together."""
    numbers, parts, offsets, at = _Numbers(), [np.zeros(1, np.int64)], [], 1
    for own in texts:
        offsets.append(at)
        parts.append(np.fromiter(map(numbers.__getitem__, own), np.int64, len(own)))
        parts.append(np.zeros(1, np.int64))
        at += len(own) + 1
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    longest = max(map(len, texts), default=0)
    if longest >= LEAST_LENGTH:
        for start, length, period in runs_of(np.concatenate(parts), longest):
            text = int(np.searchsorted(offsets, start, "right")) - 1
            found[text].append((start - offsets[text], length, period))
    return found


def kept_words(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run contains after its first period."""
    if not runs:
        return words
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return [words[i] for i in keep.nonzero()[0].tolist()]


RUNS = "array<struct<start: long, length: long, period: long>>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def groups(batch: pa.RecordBatch) -> Iterator[tuple[int, list[list[bytes]]]]:
    """Neighbouring rows with together some ``GROUP_WORDS`` words: the number of the first one, and their words."""
    begin, own, words = 0, [], 0
    for i, text in enumerate(text_bytes(batch, "text")):
        own.append(text.split())  # bytes are split at \x20 and \x09-\x0D
        words += len(own[-1])
        if words >= GROUP_WORDS:
            yield begin, own
            begin, own, words = i + 1, [], 0
    if own:
        yield begin, own


def periodic_runs(docs: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_words, ``runs`` (start, length, period; by start, then period) and ``collapsed`` for each row.

    Words stand between white space. ``collapsed`` has the words that no run contains after its first period, joined
    by one space. A null text counts as empty and has no words; rows are taken one by one, so that repeated rows and
    null ids have results of their own; an empty table gives none. Only ``id`` and ``text`` are read. No row
    is shuffled, and the memory of a task is that of its longest text.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for begin, texts in groups(batch):
                found = search_texts(texts)
                sizes = np.cumsum([0, *map(len, found)])
                flat = [dict(zip(("start", "length", "period"), run, strict=True)) for runs in found for run in runs]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").slice(begin, len(texts)),
                        pa.array(map(len, texts), pa.int64()),
                        pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(flat, _RUN)),
                        pa.array([b" ".join(kept_words(*both)) for both in zip(texts, found, strict=True)], pa.binary()).cast(pa.string()),
                    ],
                    ["id", "n_words", "runs", "collapsed"],
                )

    pair = docs.select(docs[id].alias("id"), docs[text].alias("text"))
    kind = pair.schema["id"].dataType.simpleString()
    return pair.mapInArrow(search, f"id {kind}, n_words long, runs {RUNS}, collapsed string").withColumnRenamed("id", id)
