"""Token files compressed by Re-Pair grammars.

A file holds shards, each some ``SHARD_TOKENS`` token ids of whole documents in ascending order of document id. Re-Pair
replaces frequent pairs of neighbouring ids by nonterminals, again and again, until no pair is frequent; a shard
stores the rules, how many ids each rule expands to, and the remaining sequence. With the lengths, the
symbols that hold any range of positions are found by bisection and only they are expanded.

The layout of a shard, all numbers little-endian:

    "RPG1", width of a symbol in bytes (u32), first nonterminal (u32), rules, symbols, documents (u32 each), ids (u64)
    rules x (left u32, right u32), rules x length (u64), documents x end position (u64), symbols x (u16 or u32)

Shards are rows of Parquet files, which Spark writes and commits, so that any store will do and a lost executor only repeats its
task. Beside the bytes, a row has the ids of the documents, the place of the shard (range partition, number in it) and the
number of token ids before it in its partition.
"""

from __future__ import annotations

import itertools
import os
import re
import struct
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattline.llm.common import slices

MAGIC = b"RPG1"
_HEADER = struct.Struct("<4sIIIIIQ")
SHARD_TOKENS = 1 << 18
#: A pair that occurs less often is not worth a rule (which costs 16 bytes, and saves one symbol for each occurrence).
LEAST_COUNT = 12
#: In one round, pairs at least this share as frequent as the most frequent one are replaced together.
ROUND_SHARE = 0.25
#: Symbols, terminals included, if the terminals leave room for rules: so that a symbol takes two bytes.
SYMBOLS = 1 << 16
#: Distinct chunks of a generation; with the next one they are forgotten unless they are met again (results do not change).
REMEMBERED = 600_000
#: Pieces of letters that are encoded as one text.
JOINED = 500
#: Text encoded at a time.
BATCH_BYTES = 8 << 20
#: The same for token files: each lookup goes over all known chunks, so that few large ones take less time than many.
ENCODE_BYTES = 24 << 20
#: Strings whose ids are copied at a time.
TAKEN = 1 << 18
ROW_GROUP_BYTES = 16 << 20


# -- grammar ---------------------------------------------------------------------------------


def pair_keys(left: np.ndarray, right: np.ndarray, shift: int) -> np.ndarray:
    """left * 2^shift + right, in the smallest type that holds it."""
    kind = np.uint32 if shift <= 16 else np.uint64
    return (left.astype(kind) << kind(shift)) | right.astype(kind)


def frequent_pairs(sequence: np.ndarray, least: int, shift: int) -> np.ndarray:
    """Keys of the most frequent pairs of neighbours, most frequent first."""
    keys = np.sort(pair_keys(sequence[:-1], sequence[1:], shift))
    if not len(keys):
        return keys
    first = np.append(True, keys[1:] != keys[:-1]).nonzero()[0]
    counts = np.diff(np.append(first, len(keys)))
    chosen = (counts >= max(least, ROUND_SHARE * counts.max())).nonzero()[0]
    return keys[first[chosen[np.lexsort((keys[first[chosen]], -counts[chosen]))]]]


def compatible(keys: np.ndarray, room: int, shift: int) -> np.ndarray:
    """The first of ``keys`` that can be replaced at once: no symbol ends one pair and begins another."""
    lefts, rights, taken = set(), set(), []
    for key in keys.tolist():
        if len(taken) == room:
            break
        left, right = key >> shift, key & ((1 << shift) - 1)
        if left in rights or right in lefts or (left == right and (left in lefts or right in rights)):
            continue
        lefts.add(left)
        rights.add(right)
        taken.append(key)
    return np.array(sorted(taken), keys.dtype)


def replaced(sequence: np.ndarray, pairs: np.ndarray, keys: np.ndarray, first_symbol: int, shift: int) -> np.ndarray:
    """``sequence`` with compatible ``pairs`` (whose ``keys`` are sorted) replaced by symbols from ``first_symbol`` on."""
    # For each symbol, whether it begins a pair (1) and ends one (2): one look at each place.
    roles = np.zeros(first_symbol, np.uint8)
    roles[pairs[:, 0]], roles[pairs[:, 1]] = 1, 2
    roles[pairs[pairs[:, 0] == pairs[:, 1], 0]] = 3
    role = roles.take(sequence)
    at = ((role[:-1] & (role[1:] >> 1)).view(bool)).nonzero()[0]
    here = pair_keys(sequence[at], sequence[at + 1], shift)
    rank = np.minimum(np.searchsorted(keys, here), len(keys) - 1)
    right = keys[rank] == here
    at, rank = at[right], rank[right]
    # Only pairs of equal symbols overlap, in stretches of that symbol: every second one counts.
    follows = np.append(False, np.diff(at) == 1)[: len(at)]
    if follows.any():
        begin = np.maximum.accumulate(np.where(follows, 0, np.arange(len(at))))
        even = (np.arange(len(at)) - begin) % 2 == 0
        at, rank = at[even], rank[even]
    result = sequence.copy()
    result[at] = (first_symbol + rank).astype(sequence.dtype)
    keep = np.ones(len(sequence), bool)
    keep[at + 1] = False
    return result[keep]


def compress(ids: np.ndarray, first_symbol: int, least: int = LEAST_COUNT) -> tuple[np.ndarray, np.ndarray]:
    """Rules (left, right), numbered from ``first_symbol``, and the sequence that is left of ``ids``."""
    sequence, rules = ids.astype(np.uint32), [np.zeros((0, 2), np.uint32)]
    room = (SYMBOLS if first_symbol < SYMBOLS else 2 * first_symbol) - first_symbol
    shift = (first_symbol + room - 1).bit_length()
    while room:
        keys = compatible(frequent_pairs(sequence, least, shift), room, shift)
        if not len(keys):
            break
        pairs = np.stack([keys >> keys.dtype.type(shift), keys & keys.dtype.type((1 << shift) - 1)], axis=1)
        sequence = replaced(sequence, pairs, keys, first_symbol, shift)
        rules.append(pairs.astype(np.uint32))
        first_symbol, room = first_symbol + len(keys), room - len(keys)
    return np.concatenate(rules), sequence


class Shard:
    """A shard as it lies in a file: ``pack`` makes its bytes, the constructor reads them."""

    @staticmethod
    def pack(ids: np.ndarray, ends: np.ndarray, terminals: int, least: int = LEAST_COUNT) -> bytes:
        """``ids`` of documents that end at ``ends``; all ids are below ``terminals``."""
        rules, sequence = compress(ids, terminals, least)
        lengths = np.ones(terminals + len(rules), np.uint64)
        for i, (left, right) in enumerate(rules.tolist()):
            lengths[terminals + i] = lengths[left] + lengths[right]
        width = 2 if len(lengths) <= SYMBOLS else 4
        header = _HEADER.pack(MAGIC, width, terminals, len(rules), len(sequence), len(ends), len(ids))
        parts = (rules.astype("<u4"), lengths[terminals:].astype("<u8"), ends.astype("<u8"), sequence.astype(f"<u{width}"))
        return header + b"".join(part.tobytes() for part in parts)

    def __init__(self, data: bytes):
        magic, width, self.terminals, rules, symbols, documents, self.n_ids = _HEADER.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("These bytes are no shard of token ids.")
        at = _HEADER.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            part = np.frombuffer(data, kind, n, at)
            at += part.nbytes
            return part

        self.rules = take("<u4", 2 * rules).reshape(rules, 2)
        self.lengths = np.concatenate([np.ones(self.terminals, np.int64), take("<u8", rules).astype(np.int64)])
        self.ends = take("<u8", documents).astype(np.int64)
        self.symbols = take(f"<u{width}", symbols)
        self.positions = np.concatenate([[0], np.cumsum(self.lengths[self.symbols])])
        self._pool: np.ndarray | None = None

    def _expansions(self) -> tuple[np.ndarray, np.ndarray]:
        """All terminals and then the expansion of each rule, and where each symbol's begins."""
        if self._pool is None:
            begins = np.concatenate([[0], np.cumsum(self.lengths)])[:-1]
            pool = np.empty(int(self.lengths.sum()), np.uint32)
            pool[: self.terminals] = np.arange(self.terminals)
            places = list(zip(begins.tolist(), (begins + self.lengths).tolist(), strict=True))
            at = self.terminals
            for i, (left, right) in enumerate(self.rules.tolist()):
                for begin, end in (places[left], places[right]):
                    pool[at : at + end - begin] = pool[begin:end]
                    at += end - begin
            self._pool, self._begins = pool, begins
        return self._pool, self._begins

    def ids(self, first: int = 0, last: int | None = None) -> np.ndarray:
        """Token ids at the positions from ``first`` to before ``last``; only symbols that hold them are expanded."""
        last = self.n_ids if last is None else min(last, self.n_ids)
        if first >= last:
            return np.zeros(0, np.uint32)
        low = int(np.searchsorted(self.positions, first, "right")) - 1
        high = int(np.searchsorted(self.positions, last, "left"))
        symbols, (pool, begins) = self.symbols[low:high], self._expansions()
        lengths, start = self.lengths[symbols], self.positions[low:high]
        inside = np.arange(self.positions[low], self.positions[high]) - np.repeat(start, lengths)
        expanded = pool[np.repeat(begins[symbols], lengths) + inside]
        return expanded[first - self.positions[low] : last - self.positions[low]]


# -- tokenizer -------------------------------------------------------------------------------


class IdPool:
    """Token ids of distinct strings, numbered in order of appearance."""

    def __init__(self):
        self.known = pa.array([], pa.string())
        self.ids, self.begins = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64)

    def numbers(self, texts: pa.Array) -> np.ndarray:
        """The number of each text, -1 for one that is not known."""
        return np.asarray(pc.index_in(texts, value_set=self.known).fill_null(-1)).astype(np.int64)

    def add(self, texts: pa.Array, ids: np.ndarray, lengths: np.ndarray) -> None:
        """New texts, the ids of all of them, one after the other, and how many each has."""
        at = len(self.known)
        ends = self.begins[at] + np.cumsum(lengths)
        self.begins = _with_room(self.begins, at + len(ends) + 1)
        self.ids = _with_room(self.ids, int(ends[-1]))
        self.ids[self.begins[at] : ends[-1]] = ids
        self.begins[at + 1 : at + 1 + len(ends)] = ends
        self.known = pa.concat_arrays([self.known, texts])

    def take(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some strings, joined, and how many each has."""
        lengths = self.begins[numbers + 1] - self.begins[numbers]
        ids, at = np.empty(int(lengths.sum()), np.uint32), 0
        for first in range(0, len(numbers), TAKEN):
            own = lengths[first : first + TAKEN]
            ends = np.cumsum(own)
            places = np.arange(ends[-1])
            places += np.repeat(self.begins[numbers[first : first + TAKEN]] - ends + own, own)
            self.ids.take(places, out=ids[at : at + len(places)], mode="clip")
            at += len(places)
        return ids, lengths


def _with_room(values: np.ndarray, needed: int) -> np.ndarray:
    """``values``, made longer by half at least if it has not the room."""
    if needed <= len(values):
        return values
    return np.concatenate([values, np.zeros(max(needed - len(values), len(values) // 2), values.dtype)])


# ASCII marks before and after what begins and ends with a letter that has always been one (A-Z, a-z, and Latin to
# U+024F, without the dotted I, whose small form ends with a mark). A chunk may be cut there; not after
# an apostrophe, which may belong to the letters, nor inside a special token.
_MARKS, _LETTERS = "!-/:-@\\[-`{-~", "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f"
_ALL_LETTERS = re.compile(rf"[{_LETTERS}]+")
_BEFORE_LETTERS = _MARKS.replace("!-/", "!-&(-/")
_PIECES = (
    rf"\A(?P<before>(?:[{_MARKS}]*[{_BEFORE_LETTERS}])?)(?P<letters>[{_LETTERS}](?:.*[{_LETTERS}])?)(?P<after>[{_MARKS}]*)\z"
)


class ChunkIds:
    """Token ids of texts from those of their chunks (what stands between white space), each encoded once.

    A new chunk is cut into marks, letters and marks, so that a word with and without a comma is
    encoded once. Right for tokenizers that drop white space, join nothing across it, split letters from marks and
    do not tell capitals from small letters. Chunks that have not been met for ``remembered`` others are forgotten.
    """

    def __init__(self, tokenizer_file: str, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.remembered = remembered
        self.chunks, self.older, self.pieces = IdPool(), IdPool(), IdPool()
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ends_word = np.zeros(self.tokenizer.get_vocab_size(), bool)
        if suffix:
            self.ends_word[[number for token, number in self.tokenizer.get_vocab().items() if token.endswith(suffix)]] = True

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts, one after the other, and where each text's end; a null has none."""
        self._forget()
        split = pc.ascii_split_whitespace(texts.fill_null(""))
        ids, lengths = self.chunks.take(_numbered(split.flatten(), self.chunks, self._learn))
        chunk_ends = np.asarray(split.offsets)[1:] - split.offsets[0].as_py()
        return ids, np.concatenate([[0], np.cumsum(lengths)])[chunk_ends]

    def chunk_counts(self, texts: pa.Array) -> np.ndarray:
        """Number of token ids of each chunk of all texts, one text after the other."""
        self._forget()
        chunks = pc.ascii_split_whitespace(texts.fill_null("")).flatten()
        # White space at either end of a text leaves an empty string there.
        numbers = _numbered(chunks.filter(pc.not_equal(chunks, "")), self.chunks, self._learn)
        return np.diff(self.chunks.begins)[numbers]

    def _forget(self) -> None:
        if len(self.chunks.known) > self.remembered:
            self.chunks, self.older, self.pieces = IdPool(), self.chunks, IdPool()

    def _learn(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        before = self.older.numbers(chunks)
        seen = before >= 0
        return _merged(seen, self.older.take(before[seen]), self._by_pieces(chunks.filter(pa.array(~seen))))

    def _by_pieces(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of chunks, one after the other, and how many each has."""
        cut = pc.extract_regex(pc.if_else(pc.match_substring(chunks, "<|"), None, chunks), _PIECES)
        whole = cut.is_null()
        parts = [
            pc.if_else(whole, "", pc.struct_field(cut, "before")),
            pc.if_else(whole, chunks, pc.ascii_lower(pc.struct_field(cut, "letters"))),
            pc.if_else(whole, "", pc.struct_field(cut, "after")),
        ]
        numbers = _numbered(pa.concat_arrays(parts), self.pieces, lambda new: self._encoded(new.to_pylist()))
        ids, lengths = self.pieces.take(numbers.reshape(3, -1).T.ravel())
        return ids, lengths.reshape(-1, 3).sum(axis=1)

    def _encoded(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for pieces, by the tokenizer.

        Pieces of letters are encoded many in one text, if each has one id that ends a word; then these ids part them.
        """
        found = []
        for begin in range(0, len(pieces), JOINED):
            part = pieces[begin : begin + JOINED]
            letters = np.fromiter((_ALL_LETTERS.fullmatch(p) is not None for p in part), bool, len(part))
            joined = self._ids([" ".join(itertools.compress(part, letters))])[0]
            places = self.ends_word[joined].nonzero()[0] + 1
            if len(places) != letters.sum() or (len(places) and places[-1] != len(joined)):
                letters[:], joined, places = False, joined[:0], places[:0]
            other = self._ids(list(itertools.compress(part, ~letters)))
            sizes = np.array([len(own) for own in other], np.int64)
            found.append(_merged(letters, (joined, np.diff(places, prepend=0)), (np.concatenate([joined[:0], *other]), sizes)))
        return np.concatenate([ids for ids, _ in found]), np.concatenate([lengths for _, lengths in found])

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def _numbered(texts: pa.Array, pool: IdPool, learn: Callable[[pa.Array], tuple]) -> np.ndarray:
    """Numbers in ``pool`` of some texts; each distinct text is looked up once, and ``learn`` gives the ids of new ones."""
    coded = texts.dictionary_encode()
    numbers = pool.numbers(coded.dictionary)
    new = numbers < 0
    if new.any():
        fresh, at = coded.dictionary.filter(pa.array(new)), len(pool.known)
        pool.add(fresh, *learn(fresh))
        numbers[new] = at + np.arange(len(fresh))
    return numbers[np.asarray(coded.indices)]


def _merged(first: np.ndarray, these: tuple, others: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Two sequences of strings of ids (ids, lengths), merged: where ``first``, the next one comes from ``these``."""
    lengths = np.zeros(len(first), np.int64)
    lengths[first], lengths[~first] = these[1], others[1]
    ids, of_these = np.empty(int(lengths.sum()), np.uint32), np.repeat(first, lengths)
    ids[of_these], ids[~of_these] = these[0], others[0]
    return ids, lengths


@lru_cache(maxsize=2)
def chunk_ids(tokenizer_file: str) -> ChunkIds:
    """One for all tasks that a Python worker runs."""
    return ChunkIds(tokenizer_file)


def pieces_of(batch: pa.RecordBatch, text: str = "text", limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with texts of some ``limit`` bytes together, or a single longer text."""
    if not batch.num_rows:
        return
    sizes = np.asarray(pc.binary_length(batch.column(text)).fill_null(0))
    share = np.cumsum(sizes) // limit
    first = np.append(True, share[1:] != share[:-1]).nonzero()[0]
    for begin, end in zip(first, [*first[1:], len(sizes)], strict=True):
        yield batch.slice(begin, end - begin)


# -- files -----------------------------------------------------------------------------------


def write_token_files(
    docs: DataFrame,
    tokenizer_file: str,
    folder: str,
    *,
    end_id: int | None = None,
    id: str = "doc_id",
    text: str = "text",
    shard_tokens: int = SHARD_TOKENS,
) -> None:
    """Encode every whole text and write the ids, each document's followed by ``end_id``, in ascending order of id.

    Rows are dealt out by ranges of (id, digest of the text), so that null ids (which come first) and repeated ids with different
    texts are split as well; rows equal in both are next to each other. A null text counts as empty: only its
    end is written. An empty table gives files without shards. Only ``id`` and ``text`` are read. A task holds one shard, and the whole
    of its longest text; texts are never cut.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks, partition = chunk_ids(tokenizer_file), TaskContext.get().partitionId()
        terminals = max(chunks.tokenizer.get_vocab_size(), 0 if end_id is None else end_id + 1)
        tail = np.array([] if end_id is None else [end_id], np.uint32)
        pending, doc_ids, held, before, number = [], [], 0, 0, 0

        def shard() -> pa.RecordBatch:
            data = Shard.pack(np.concatenate(pending), np.cumsum([len(p) for p in pending]), terminals)
            row = [[partition], [number], [before], [held], [pa.concat_arrays(doc_ids)], [data]]
            return pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(row, kinds, strict=True)], names)

        for whole in batches:
            for batch in pieces_of(whole, limit=ENCODE_BYTES):
                ids, ends = chunks.encode(batch.column("text"))
                for i, (begin, end) in enumerate(zip([0, *ends.tolist()], ends.tolist(), strict=False)):
                    pending.append(np.concatenate([ids[begin:end], tail]))
                    doc_ids.append(batch.column("id").slice(i, 1))
                    held += len(pending[-1])
                    if held >= shard_tokens:
                        yield shard()
                        pending, doc_ids, before, held, number = [], [], before + held, 0, number + 1
        if pending:
            yield shard()

    pair = docs.select(docs[id].alias("id"), docs[text].alias("text"))
    kind = pair.schema["id"].dataType.simpleString()
    names = ["partition", "shard", "before", "n_ids", "doc_ids", "data"]
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(to_arrow_type(pair.schema["id"].dataType)), pa.binary()]
    ordered = pair.repartitionByRange("id", F.xxhash64("text")).sortWithinPartitions("id", F.xxhash64("text"))
    shards = ordered.mapInArrow(
        encode, f"partition int, shard int, before long, n_ids long, doc_ids array<{kind}>, data binary"
    )
    shards.write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(folder)


def shard_starts(shards: DataFrame) -> DataFrame:
    """``shards`` with ``start``: the number of token ids in all files before each shard."""
    spark = shards.sparkSession
    # One row per range partition, however many documents there are.
    totals = sorted(shards.groupBy("partition").agg(F.sum("n_ids").alias("n")).collect())
    offsets, start = [], 0
    for row in totals:
        offsets.append((row["partition"], start))
        start += row["n"]
    offset = spark.createDataFrame(offsets, "partition int, offset long")
    return shards.join(F.broadcast(offset), "partition").withColumn("start", F.col("offset") + F.col("before")).drop("offset")


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, ``start`` (token ids of all documents before it) and ``ids`` (little-endian u32) of each document."""
    shards = shard_starts(spark.read.parquet(folder)).select("start", "doc_ids", "data")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            shard = Shard(batch.column("data")[0].as_py())
            ids, ends = shard.ids().astype("<u4"), shard.ends
            begins = np.concatenate([[0], ends[:-1]])
            if ids.nbytes < 2**31:
                offsets = pa.py_buffer((np.append(begins, ends[-1]) * 4).astype(np.int32))
                bodies = pa.Array.from_buffers(pa.binary(), len(ends), [None, offsets, pa.py_buffer(ids)])
            else:  # a single huge document
                bodies = pa.array([ids[b:e].tobytes() for b, e in zip(begins, ends, strict=True)], pa.large_binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_ids").flatten(), pa.array(batch.column("start")[0].as_py() + begins, pa.int64()), bodies],
                ["doc_id", "start", "ids"],
            )

    kind = shards.schema["doc_ids"].dataType.elementType.simpleString()
    return shards.mapInArrow(decode, f"doc_id {kind}, start long, ids binary")


def read_range(spark: SparkSession, folder: str, first: int, last: int) -> DataFrame:
    """position, token_id for the positions from ``first`` to before ``last`` over all files.

    Only shards that hold some of them are read, and of these only the symbols.
    """
    shards = shard_starts(spark.read.parquet(folder)).select("start", "n_ids", "data")
    hit = shards.filter((F.col("start") < last) & (F.col("start") + F.col("n_ids") > first))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            start = batch.column("start")[0].as_py()
            low = max(first - start, 0)
            ids = Shard(batch.column("data")[0].as_py()).ids(low, last - start)
            yield pa.RecordBatch.from_arrays(
                [pa.array(start + low + np.arange(len(ids)), pa.int64()), pa.array(ids.astype(np.int64))], ["position", "token_id"]
            )

    return hit.mapInArrow(decode, "position long, token_id long")
