"""Id allocation (W2): dense ids after the current maximum, for a whole batch at once.

Replaces the read-max-then-insert loop of the reference (one round trip per row, racy between writers)
with one job: ``max(id)`` as a scalar subquery plus the distributed dense index. Ids follow a total order
over the columns that fix each new row, so a rerun gives every row the same id, and the dense index pins
its numbered rows with a reliable checkpoint, so a lost executor cannot make a recomputation hand out
different ids.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roster.plans.indexing import dense_index


def next_id_column(existing: DataFrame | Column, id_col: str = "id") -> Column:
    """COALESCE(MAX(id), 0) + 1 as a scalar-subquery column; ``existing`` is the table, or already its
    largest id (``Tables.max_id``)."""
    top = existing if isinstance(existing, Column) else existing.agg(F.max(id_col)).scalar()
    return F.coalesce(top, F.lit(0)).cast("bigint") + 1


def allocate_ids(existing: DataFrame | Column, batch: DataFrame, order: Sequence[str], id_col: str = "id",
                 existing_id_col: str = "id") -> DataFrame:
    """Number ``batch`` after the largest id of ``existing`` (a table, or its largest id as a column). Rows equal
    in all of ``order`` are interchangeable; a random tie-break spreads them over the range partitions."""
    tied = batch.withColumn("__tie", F.rand())
    return dense_index(tied, order, id_col=id_col, start=next_id_column(existing, existing_id_col),
                       tiebreak=["__tie"]).drop("__tie")


def reserve_ids(existing: DataFrame | Column, batch: DataFrame, id_col: str = "id", existing_id_col: str = "id") -> DataFrame:
    """Number ``batch`` after the largest id where it is free which row gets which: every task numbers its rows from a
    range reserved for it, without a sort or a shuffle of the rows. The numbered rows are pinned, so a lost executor
    doesn't change them."""
    return dense_index(batch, [], id_col=id_col, start=next_id_column(existing, existing_id_col))
