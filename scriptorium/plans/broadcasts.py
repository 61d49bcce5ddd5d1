"""Broadcasts behind a check of their size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A table of at most so many rows, and bytes, may be broadcast.
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 32 << 20


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows and BROADCAST_BYTES bytes, else left to a shuffle join."""
    wide = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in df.dtypes if kind == "string"]
    size = F.sum(sum(wide, F.lit(16 * len(df.columns))))
    found = df.limit(rows + 1).agg(F.count("*").alias("n"), size.alias("size")).first()
    return F.broadcast(df) if found["n"] <= rows and (found["size"] or 0) <= BROADCAST_BYTES else df
