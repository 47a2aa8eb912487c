"""Counts over whole texts that classifiers and quality rules are built on."""

from __future__ import annotations

import operator
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from wattline.llm.common import slices, text_bytes

COUNTS = (
    "n_words word_chars n_symbols n_dup_lines n_repeat_words "
    "n_lines n_capitals n_small n_digits n_marks n_adjacent n_distinct n_shouted n_bare"
).split()
WINDOW = 8

_SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
_MARKS = np.frombuffer(b"!?", np.uint8)
_CONTINUES = slice(0x80, 0xC0)  # bytes that do not begin a character
_SPACE = np.array([0x20, *range(0x09, 0x0E)])


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows of ``window`` words that occur twice or more, the first occurrence included."""
    if len(words) <= window:
        return 0
    numbers = {word: i for i, word in enumerate(dict.fromkeys(words))}
    ids = [numbers[word] for word in words]
    windows = list(zip(*(ids[i:] for i in range(window)), strict=False))
    seen = Counter(windows)
    if len(seen) == len(windows):
        return 0
    edges = np.zeros(len(words) + 1, np.int64)
    starts = np.fromiter((seen[w] > 1 for w in windows), bool, len(windows)).nonzero()[0]
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + window, -1)
    return int((np.cumsum(edges) > 0).sum())


def repeated_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in text.split(b"\n") if line.split()]
    return len(lines) - len(set(lines))


def count_text(text: bytes, windows: bool = True) -> tuple[int, ...]:
    """The values of ``COUNTS`` for one text in UTF-8."""
    words = text.split()  # exactly the six ASCII space characters
    per_byte = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    n_chars = len(text) - int(per_byte[_CONTINUES].sum())
    return (
        len(words),
        n_chars - int(per_byte[_SPACE].sum()),
        int(per_byte[_SYMBOLS].sum()),
        repeated_lines(text),
        repeated_words(words) if windows else 0,
        text.count(b"\n") + 1 if text else 0,
        int(per_byte[65:91].sum()),
        int(per_byte[97:123].sum()),
        int(per_byte[48:58].sum()),
        int(per_byte[_MARKS].sum()),
        sum(map(operator.eq, words, words[1:])),
        len(set(words)),
        sum(map(bytes.isupper, words)),
        sum(not word.isalnum() for word in words if len(word) == 1),
    )


def document_statistics(
    docs: DataFrame, *, id: str = "doc_id", text: str = "text", windows: bool = True
) -> DataFrame:
    """One row per input row: its id and the columns ``COUNTS`` (long). A null text counts as empty.

    Nothing but ``id`` and ``text`` is read; other columns, whatever their names, do not matter.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [count_text(value, windows) for value in text_bytes(batch, "text")]
            columns = zip(*rows, strict=True) if rows else [[] for _ in COUNTS]
            arrays = [pa.array(column, pa.int64()) for column in columns]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *arrays], ["id", *COUNTS])

    pair = docs.select(docs[id].alias("id"), docs[text].alias("text"))
    schema = f"id {pair.schema['id'].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in COUNTS)
    return pair.mapInArrow(count, schema)
