"""Runs a registered query next to its SQL and compares complete results."""

from __future__ import annotations

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return connection


def normalised(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)]
    return frame.sort_values(list(frame.columns), ignore_index=True)


def assert_same(actual: pd.DataFrame, expected: pd.DataFrame) -> None:
    """Same columns, types, rows and exact values, in any row order."""
    pd.testing.assert_frame_equal(normalised(actual), normalised(expected), check_exact=True)
