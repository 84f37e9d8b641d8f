"""Dense consecutive ids in a total order, computed without an unbounded single-partition window.

``row_number() over (order by ...)`` with no ``partition by`` moves every row into one task. Instead:

1. range-partition the rows on the order columns and sort inside each partition (the same work a
   distributed ``orderBy`` does; AQE sizes the partitions unless a count is given);
2. ``monotonically_increasing_id`` then carries (partition index, position inside the partition);
3. that tagged frame is written once with a reliable ``checkpoint()`` to the session's checkpoint folder.
   Range bounds come from a sample whose seed differs between evaluations, so without pinning the rows
   the count pass and the numbering pass could see different partitions; after the checkpoint both
   read the same files, and a lost executor re-reads them instead of re-sampling;
4. count rows per partition (one row per partition) and turn the counts into starting offsets with a
   running sum over those rows, broadcast them (bounded by the partition count, not by the data) and add.

Rows that tie on the order columns may swap ids between runs, so callers order by columns that fix every
output value (then ties are indistinguishable). ``tiebreak`` columns refine the order only to let the range
partitioner split a hot key over several partitions; they must not change which output row gets which id.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roster.session import ensure_checkpoint_dir

_POS_BITS = 33
_POS_MASK = (1 << _POS_BITS) - 1


def _as_col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dense_index(df: DataFrame, order: Sequence[str | Column], id_col: str = "id", start: int | Column = 1,
                tiebreak: Sequence[str | Column] = (), num_partitions: int | None = None) -> DataFrame:
    """Add ``id_col`` = start, start+1, ... following ``order`` (ascending, nulls last, as ANSI SQL engines
    default), refined by ``tiebreak``. ``start`` may be a literal or a scalar-subquery column. Without any order nothing
    is moved or sorted: every task's rows get the range of numbers reserved for them."""
    return index_by(df, [_as_col(c).asc_nulls_last() for c in list(order) + list(tiebreak)], id_col, start, num_partitions)


def index_by(df: DataFrame, keys: Sequence[Column], id_col: str = "id", start: int | Column = 1,
             num_partitions: int | None = None) -> DataFrame:
    """``dense_index`` by sort keys as they are (``F.desc(...)``, ``asc_nulls_first()`` and so on)."""
    start_col = start if isinstance(start, Column) else F.lit(start)
    ensure_checkpoint_dir(df.sparkSession)
    # Without an explicit count AQE may coalesce the range partitions to its advisory size. That is safe
    # here: coalesced partitions keep their range order, and the partition index is recorded in the ids
    # that the checkpoint pins, which both passes below read.
    if keys:
        ranged = df.repartitionByRange(num_partitions, *keys) if num_partitions else df.repartitionByRange(*keys)
        df = ranged.sortWithinPartitions(*keys)
    tagged = df.withColumn("__rid", F.monotonically_increasing_id()).checkpoint(eager=True)
    tagged = tagged.withColumn("__part", F.shiftright("__rid", _POS_BITS)) \
                   .withColumn("__pos", F.col("__rid").bitwiseAND(F.lit(_POS_MASK)))
    counts = tagged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    # One row per partition: a single-task running sum here is bounded by the partition count.
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    out = (tagged.join(F.broadcast(offsets), "__part")
           .withColumn(id_col, (start_col + F.col("__off") + F.col("__pos")).cast("bigint")))
    return out.drop("__rid", "__part", "__pos", "__off")
