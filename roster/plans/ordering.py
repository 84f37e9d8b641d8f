"""Sorted outputs with their row numbers, and orders under an ICU collation.

A sorted frame loses its order when it is written and read, joined or compared as rows. ``in_order`` adds the position as a
column: the rows are range-partitioned and numbered by the distributed dense index, so no task holds more than its
range, and the position can be checked, joined and paged by.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roster.plans.indexing import index_by

#: Case and accents don't count, as in the source database.
CASELESS = "UNICODE_CI_AI"


def in_order(df: DataFrame, keys: Sequence[Column], position: str = "position") -> DataFrame:
    """``df`` with its rows numbered from 1 in the order of ``keys``, which must fix the order."""
    return index_by(df, list(keys), id_col=position)


def collated(c: str | Column, collation: str = CASELESS) -> Column:
    """A text that compares, sorts, groups and joins under a collation."""
    return F.collate(F.col(c) if isinstance(c, str) else c, collation)
