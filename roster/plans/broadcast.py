"""Broadcast only what is proven small.

``bounded(df, max_rows)`` runs a cheap check (rows and bytes of ``limit(max_rows + 1)``) and marks the frame for
broadcast only when it holds at most ``max_rows`` rows of ``MAX_BYTES`` together. Beyond the bound the frame is returned as is and
the join falls back to a shuffle join, which AQE may still turn into a broadcast from runtime sizes.
Frames whose size is fixed by construction (a literal lookup) use ``fixed`` and skip the check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A dimension row here is a few ids and a short name: 100k rows stay well below 10 MB per executor.
DEFAULT_MAX_ROWS = 100_000


MAX_BYTES = 32 << 20


def row_bound_holds(df: DataFrame, max_rows: int = DEFAULT_MAX_ROWS, max_bytes: int = MAX_BYTES) -> bool:
    """At most so many rows, and so many bytes: those of texts, and 16 for any other value."""
    size = sum((F.coalesce(F.octet_length(c), F.lit(0)) if kind in ("string", "binary") else F.lit(16) for c, kind in df.dtypes), F.lit(0))
    n, held = df.limit(max_rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    return n <= max_rows and held <= max_bytes


def bounded(df: DataFrame, max_rows: int = DEFAULT_MAX_ROWS) -> DataFrame:
    return F.broadcast(df) if row_bound_holds(df, max_rows) else df


def fixed(df: DataFrame) -> DataFrame:
    """Broadcast a frame whose row count is a constant of the code (not of the data)."""
    return F.broadcast(df)
