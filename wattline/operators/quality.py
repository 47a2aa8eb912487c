"""Separating records that cannot be used."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REASON = "reason"

# Readers of text keep what they cannot decode in this column.
CORRUPT = "_corrupt_record"
UNDECODABLE = "undecodable"

# Spark timestamps count microseconds in a BIGINT.
MAX_TIME_MS = (2**63 - 1) // 1000


def rejection_reason(
    time: str = "timestamp",
    required: Sequence[str] = ("valueInW",),
    identifier: str = "identifier",
    corrupt: str | None = None,
) -> Column:
    """Why a record is unusable, null for a good one.

    Undecodable input (if ``corrupt`` names the column that keeps it); a missing key, time or
    value; a time before the epoch or beyond what a timestamp can hold.
    """
    reason = F.when(F.col(corrupt).isNotNull() if corrupt else F.lit(False), F.lit(UNDECODABLE))
    reason = reason.when(F.col(identifier).isNull(), F.lit(f"missing {identifier}"))
    reason = reason.when(F.col(time).isNull(), F.lit(f"missing {time}"))
    reason = reason.when(F.col(time) < 0, F.lit(f"negative {time}"))
    reason = reason.when(F.col(time) > F.lit(MAX_TIME_MS), F.lit(f"{time} out of range"))
    for column in required:
        reason = reason.when(F.col(column).isNull(), F.lit(f"missing {column}"))
    return reason


def reason_for(
    rows: DataFrame, time: str = "timestamp", required: Sequence[str] = ("valueInW",), identifier: str = "identifier"
) -> Column:
    """``rejection_reason`` with the column of undecodable input, if ``rows`` has one."""
    return rejection_reason(time, required, identifier, CORRUPT if CORRUPT in rows.columns else None)


def accepted(
    rows: DataFrame, time: str = "timestamp", required: Sequence[str] = ("valueInW",), identifier: str = "identifier"
) -> DataFrame:
    return rows.filter(reason_for(rows, time, required, identifier).isNull())


def rejected(
    rows: DataFrame, time: str = "timestamp", required: Sequence[str] = ("valueInW",), identifier: str = "identifier"
) -> DataFrame:
    """The complement of ``accepted``, with the reason. Nothing is lost between the two."""
    reason = reason_for(rows, time, required, identifier)
    return rows.withColumn(REASON, reason).filter(F.col(REASON).isNotNull())
