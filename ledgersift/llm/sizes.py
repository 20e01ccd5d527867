"""Broadcasts of a checked size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What may be broadcast: rows and estimated bytes.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20


def sent(df: DataFrame, size: Column, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most so many rows and, ``size`` bytes each, ``BROADCAST_BYTES`` in all; else as it is, to be shuffled."""
    n, b = df.agg(F.count("*"), F.sum(size)).first()
    return F.broadcast(df) if n <= rows and (b or 0) <= BROADCAST_BYTES else df
