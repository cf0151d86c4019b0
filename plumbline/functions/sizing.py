"""Broadcast only what is known to be small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_LIMIT = 32 * 1024 * 1024


def plan_bytes(df: DataFrame) -> int | None:
    """Size estimate of the optimised plan, None where the session cannot tell."""
    try:
        return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().toString())
    except AttributeError:
        return None


def is_small(df: DataFrame, limit: int | None = None) -> bool:
    """Whether the estimated size is known and within ``limit``."""
    size = plan_bytes(df)
    return size is not None and size <= (BROADCAST_LIMIT if limit is None else limit)


def small(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Hint a broadcast for a table that :func:`is_small`; else leave the choice to the optimizer."""
    return F.broadcast(df) if is_small(df, limit) else df


def stored_bytes(stored: DataFrame) -> int:
    """Bytes of the files of a table that was just read back, as its scan knows them from listing them."""
    return int(str(stored._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
