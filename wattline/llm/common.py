"""Helpers that the operators share: stored intermediate tables, words, row batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattline.session import new_work_dir

# Fixed by the contracts: a word is a maximal run of [^\x00-\x2F\x3A-\x60\x7B-\x7F], after A-Z are lowered. The characters
# are listed one by one: Java looks these up in a table, but tries ranges one after the other, ten times as slowly.
WORD = "[^" + "".join(f"\\x{b:02X}" for b in range(128) if not chr(b).islower() and not chr(b).isdigit()) + "]+"
# The same words in text whose capitals are still there.
WORD_ANY_CASE = "[^" + "".join(f"\\x{b:02X}" for b in range(128) if not chr(b).isalnum()) + "]+"
# Fixed by the contracts: a word between white space.
SPACED_WORD = r"[^\x20\x09-\x0D]+"

CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_TO_WORDS = bytes(
    b if b >= 0x80 or chr(b) in SMALL + "0123456789" else ord(chr(b).lower()) if chr(b) in CAPITALS else 0x20
    for b in range(256)
)


def word_list(text: bytes) -> list[bytes]:
    """The words ``WORD`` of UTF-8 text with A-Z lowered; every byte from 0x80 belongs to a word."""
    return text.translate(_TO_WORDS).split()


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Small pieces of Arrow batches, so that few Python objects exist at a time."""
    for batch in batches:
        for begin in range(0, batch.num_rows, rows):
            yield batch.slice(begin, rows)


def text_bytes(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """UTF-8 bytes of a string column; a null is empty."""
    return [value or b"" for value in batch.column(name).cast(pa.binary()).to_pylist()]


def stored(rows: DataFrame, purpose: str) -> DataFrame:
    """Write once below the shared folder and read back: later uses share the work and outlive executors."""
    path = new_work_dir(rows.sparkSession, purpose)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def small_enough(rows: DataFrame, row_bytes: int, limit_bytes: int = 16 * 1024 * 1024) -> bool:
    """Whether a stored table is within the size that may be broadcast, by its real row count."""
    return rows.count() * row_bytes <= limit_bytes


def lower_ascii(word: Column) -> Column:
    """A-Z lowered and nothing else; plain ``lower`` where the value has only ASCII characters."""
    ascii_only = F.length(word) == F.octet_length(word)
    return F.when(ascii_only, F.lower(word)).otherwise(F.translate(word, CAPITALS, SMALL))


def in_fold(doc_id: Column) -> Column:
    """Whether a document belongs to the held-out fifth; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0
