"""Token counts at every prefix of a text, by dynamic programming over the tokenizer's merges.

Byte-pair encodings of prefixes extend each other: if the encoding of a string ends with the token t, then what is before t is
encoded as it is on its own. So the table

    count(i) = count(i - |t|) + 1,   t = last(i) the last token of the first i symbols

has one entry per prefix, and last(i) is the one token that ends at i and *fits* behind last(i - |t|): the merges of the two, undone
from the latest to the first, never have a merge across their border that would have come first. From each place
the tokens that begin there are found in a trie, so the work is linear in the text. At the end of a word the last
symbol is another one (it carries the suffix that ends words); the same rule gives the count for a prefix cut there.

Between white space a text is a sequence of chunks; tokens never cross white space, so that counts of chunks add up, and
each distinct piece of a chunk is worked out once. The table answers every question about truncation and budgets without
encoding again.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattline.llm.token_grammar import _ALL_LETTERS, REMEMBERED, ChunkIds, pieces_of

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LATEST = 1 << 40
PLAIN, FINAL = "", "end"


@lru_cache(maxsize=1)
def byte_symbols() -> list[str]:
    """The symbol that stands for each byte: printable ones for themselves, the others numbered from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class Merges:
    """The merge table of a byte-pair tokenizer whose words end with a suffix: which tokens fit behind each other."""

    def __init__(self, tokenizer_file: str):
        with open(tokenizer_file, encoding="utf-8") as file:
            model = json.load(file)["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.vocabulary: dict[str, int] = model["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {(self.vocabulary[a], self.vocabulary[b]): r for r, (a, b) in enumerate(pairs)}
        #: How each token came about: rank, left, right; symbols have none.
        self.made: dict[int, tuple[int, int, int]] = {}
        for r, (a, b) in enumerate(pairs):
            self.made.setdefault(self.vocabulary[a + b], (r, self.vocabulary[a], self.vocabulary[b]))
        self.trie: dict = {}
        for token, number in self.vocabulary.items():
            final = bool(self.suffix) and token.endswith(self.suffix) and token != self.suffix
            node = self.trie
            for symbol in token.removesuffix(self.suffix) if final else token:
                node = node.setdefault(symbol, {})
            node[FINAL if final else PLAIN] = number
        self.fitting: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}

    def fits(self, left: int, right: int) -> bool:
        """Whether two tokens stay apart when what they stand for is encoded as one string."""
        key = left << 32 | right
        if (known := self.fitting.get(key)) is None:
            if len(self.fitting) > 2_000_000:
                self.fitting.clear()
            known = self.fitting[key] = self._fits(left, right)
        return known

    def _fits(self, x: int, y: int) -> bool:
        # When x and y are at the border, x is merged away at rank x_until and y at y_until.
        x_until = y_until = _LATEST
        while True:
            across = self.rank.get((x, y), _LATEST)
            # Of equal merges the leftmost comes first: that of x with its left before, that of y with its right after it.
            if across < x_until and across <= y_until and across < _LATEST:
                return False
            x_made, y_made = self.made.get(x), self.made.get(y)
            if x_made is None and y_made is None:
                return True
            if y_made is None or (x_made is not None and x_made[0] > y_made[0]):
                x_until, x = x_made[0], x_made[2]
            else:
                y_until, y = y_made[0], y_made[1]

    def is_whole(self, token: int) -> bool:
        """Whether the tokenizer makes this token of its own symbols."""
        if (known := self.whole.get(token)) is None:
            made = self.made.get(token)
            known = made is None or (self.is_whole(made[1]) and self.is_whole(made[2]) and self._joins(token))
            self.whole[token] = known
        return known

    def _joins(self, token: int) -> bool:
        """Whether the parts of a token, each whole, meet: nothing across their border comes before their own last merges."""
        rank, x, y = self.made[token]
        x_until = y_until = rank
        while True:
            x_made, y_made = self.made.get(x), self.made.get(y)
            if x_made is None and y_made is None:
                return True
            if y_made is None or (x_made is not None and x_made[0] > y_made[0]):
                x_until, x = x_made[0], x_made[2]
            else:
                y_until, y = y_made[0], y_made[1]
            across = self.rank.get((x, y), _LATEST)
            if across < x_until and across <= y_until:
                return False

    def table(self, word: str, inside: bool = False) -> tuple[list[int], list[int], list[int]]:
        """For each prefix of a word's symbols: tokens inside a word, tokens if the word ends there, and last token if it ends there.

        Without ``inside`` the second and third are right for the whole word only.
        """
        n = len(word)
        count, last, ended, end = [0] * (n + 1), [-1] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        trie, fits = self.trie, self.fits
        for at in range(n):
            before, tokens, node = last[at], count[at] + 1, trie
            if at and before < 0:
                continue
            for to in range(at + 1, n + 1):
                node = node.get(word[to - 1])
                if node is None:
                    break
                token = node.get(PLAIN)
                if token is not None and last[to] < 0 and (fits(before, token) if at else self.is_whole(token)):
                    last[to], count[to] = token, tokens
                if inside or to == n:
                    token = node.get(FINAL)
                    if token is not None and end[to] < 0 and (fits(before, token) if at else self.is_whole(token)):
                        end[to], ended[to] = token, tokens
        return count, ended, end

    def tokens(self, word: str) -> list[int]:
        """Token ids of a word's symbols, last to first along the table, given in order."""
        n = len(word)
        last, end, back = [-1] * (n + 1), -1, [0] * (n + 1)
        end_at, trie, fits = 0, self.trie, self.fits
        for at in range(n):
            before, node = last[at], trie
            if at and before < 0:
                continue
            for to in range(at + 1, n + 1):
                node = node.get(word[to - 1])
                if node is None:
                    break
                token = node.get(PLAIN)
                if token is not None and last[to] < 0 and (fits(before, token) if at else self.is_whole(token)):
                    last[to], back[to] = token, at
                if to == n and (token := node.get(FINAL)) is not None and end < 0 and (fits(before, token) if at else self.is_whole(token)):
                    end, end_at = token, at
        if end < 0 and self.suffix:
            raise ValueError(f"No token ends the word {word!r}.")
        found, at = ([end], end_at) if self.suffix else ([], n)
        while at:
            found.append(last[at])
            at = back[at]
        return found[::-1]


class PrefixCounter(ChunkIds):
    """Counts by the merge table; the library only normalises and splits what is not plain letters."""

    def __init__(self, tokenizer_file: str, remembered: int = REMEMBERED):
        super().__init__(tokenizer_file, remembered)
        self.merges = Merges(tokenizer_file)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.vectors: dict[str, list[int]] = {}

    def words(self, text: str) -> list[str]:
        """The symbols of each word of a piece without special tokens."""
        if _ALL_LETTERS.fullmatch(text):
            if text.isascii():
                return [text.lower()]
            symbols = byte_symbols()
            return ["".join([symbols[b] for b in text.lower().encode()])]
        plain = self.tokenizer.normalizer.normalize_str(text)
        return [word for word, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(plain)]

    def _encoded(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, lengths = [], []
        for piece in pieces:
            if any(special in piece for special in self.special):
                own = self.tokenizer.encode(piece, add_special_tokens=False).ids
            else:
                own = [token for word in self.words(piece) for token in self.merges.tokens(word)]
            ids += own
            lengths.append(len(own))
        return np.array(ids, np.uint32), np.array(lengths, np.int64)

    def inside(self, chunk: str) -> list[int]:
        """Tokens of every proper prefix of a chunk, by characters."""
        if chunk not in self.vectors:
            if len(self.vectors) >= self.remembered:
                self.vectors.clear()
            self.vectors[chunk] = self._inside(chunk)
        return self.vectors[chunk]

    def _inside(self, chunk: str) -> list[int]:
        lower = [self.tokenizer.normalizer.normalize_str(c) for c in chunk]
        plain = "".join(lower)
        simple = all(len(c) == 1 for c in lower) and unicodedata.is_normalized("NFC", chunk) and not any(c in "<" for c in chunk)
        if not simple or self.tokenizer.normalizer.normalize_str(chunk) != plain:
            # Characters that change their number, or special tokens: no table of this text has its prefixes.
            return [len(self.tokenizer.encode(chunk[:i], add_special_tokens=False).ids) for i in range(1, len(chunk))]
        found, before = [], 0
        for _, (begin, end) in self.tokenizer.pre_tokenizer.pre_tokenize_str(plain):
            found += [before] * (begin - len(found))  # characters that belong to no word
            word = plain[begin:end]
            sizes = np.cumsum([len(c.encode()) for c in word])
            symbols = byte_symbols()
            _, ended, _ = self.merges.table("".join([symbols[b] for b in word.encode()]), inside=True)
            counts = [before + ended[n] for n in sizes]
            if word[0] == "'" and len(word) > 2:  # an apostrophe with the first of two letters is two words
                counts[1] = before + sum(len(self.merges.tokens(w)) for w in self.words(word[:2]))
            found += counts
            before = counts[-1]
        found += [before] * (len(chunk) - len(found))
        return found[:-1]


@lru_cache(maxsize=2)
def prefix_counter(tokenizer_file: str) -> PrefixCounter:
    """One for all tasks that a Python worker runs."""
    return PrefixCounter(tokenizer_file)


def chunk_ends(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets, in their text, at which the chunks of each text end, and how many there are up to each text's end."""
    texts = pa.concat_arrays([texts.cast(pa.binary()).fill_null(b"")])
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    dark = ~_IS_SPACE[data]
    closes = np.append(~dark[1:], True) if len(dark) else np.zeros(0, bool)
    closes[offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] <= len(dark))] - 1] = True
    ends = (dark & closes).nonzero()[0] + 1
    number = np.searchsorted(ends, offsets, "right")
    starts = np.repeat(offsets[:-1], np.diff(number))
    return ends - starts, number


def prefix_counts(
    docs: DataFrame, tokenizer_file: str, *, id: str = "doc_id", text: str = "text", inside: bool = False
) -> DataFrame:
    """One row per input row: id, n_bytes, ``ends`` (byte offsets of chunk ends), ``counts`` (tokens up to each).

    With ``inside`` there is an entry for every character that is not white space, so that a prefix
    cut in the middle of a word has its exact count too. A null text counts as empty and has empty
    arrays. Only ``id`` and ``text`` are read. The file must be at the same path on every executor;
    its tokenizer must be a byte-level pair encoding that drops white space.
    """

    def table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = prefix_counter(tokenizer_file)
        for whole in batches:
            for batch in pieces_of(whole):
                texts = batch.column("text")
                ends, number = chunk_ends(texts)
                counts = counter.chunk_counts(texts)
                total = np.concatenate([[0], np.cumsum(counts)])
                sums = total[1:] - np.repeat(total[number[:-1]], np.diff(number))
                if inside:
                    number, ends, sums = every_character(counter, texts, ends, sums, number)
                size = pc.binary_length(texts).fill_null(0).cast(pa.int64())
                offsets = pa.array(number, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id"),
                        size,
                        pa.ListArray.from_arrays(offsets, pa.array(ends, pa.int32())),
                        pa.ListArray.from_arrays(offsets, pa.array(sums, pa.int32())),
                    ],
                    ["id", "n_bytes", "ends", "counts"],
                )

    pair = docs.select(docs[id].alias("id"), docs[text].alias("text"))
    kind = pair.schema["id"].dataType.simpleString()
    out = pair.mapInArrow(table, f"id {kind}, n_bytes long, ends array<int>, counts array<int>")
    return out.withColumnRenamed("id", id)


def every_character(counter: PrefixCounter, texts: pa.Array, ends, sums, number) -> tuple[list[int], list[int], list[int]]:
    """The same three for every character that is not white space."""
    all_number, all_ends, all_counts = [0], [], []
    for row, text in enumerate(texts.to_pylist()):
        before = 0
        chunks = (text or "").encode().split()
        for chunk, end, total in zip(chunks, ends[number[row] : number[row + 1]].tolist(), sums[number[row] : number[row + 1]].tolist(), strict=True):
            offset, letters = end - len(chunk), chunk.decode()
            for letter, tokens in zip(letters, counter.inside(letters), strict=False):
                offset += len(letter.encode())
                all_ends.append(offset)
                all_counts.append(before + tokens)
            all_ends.append(end)
            all_counts.append(total)
            before = total
        all_number.append(len(all_ends))
    return all_number, all_ends, all_counts


def total_tokens() -> Column:
    """Tokens of the whole text, from a prefix table."""
    return F.coalesce(F.try_element_at("counts", F.lit(-1)), F.lit(0)).cast("long")


def tokens_before(offset: Column | int) -> Column:
    """Tokens of the longest stored prefix that ends at or before a byte offset."""
    inside = F.size(F.filter("ends", lambda end: end <= offset))
    return F.when(inside > 0, F.try_element_at("counts", inside)).otherwise(0).cast("long")


def bytes_within(budget: Column | int) -> Column:
    """Bytes of the longest stored prefix with at most ``budget`` tokens."""
    # Inside a word one letter more can mean one token less, so the last fitting entry counts.
    last = F.array_max(F.transform("counts", lambda count, i: F.when(count <= budget, i + 1)))
    return F.coalesce(F.try_element_at("ends", last), F.lit(0)).cast("long")
