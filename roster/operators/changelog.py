"""Change-log application (W8): the latest change per key wins; deletes remove the key, other operations
upsert it.

``max_by`` over a struct of the ordering columns picks the latest change per key. It is a partial
aggregate, so a key that holds a third of the log still sends one row per task to the shuffle. The same
function serves batch jobs and the streaming ``foreachBatch`` wrapper (``roster.streaming``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_per_key(changes: DataFrame, key: str | Sequence[str], order: Sequence[str]) -> DataFrame:
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in changes.columns if c not in keys]
    picked = (changes.groupBy(*keys)
              .agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__last")))
    return picked.select(*keys, *[F.col(f"__last.{c}").alias(c) for c in rest])


def apply_changes(base: DataFrame | None, changes: DataFrame, key: str | Sequence[str], order: Sequence[str],
                  op_col: str, delete_ops: Sequence[str] = ("delete",),
                  columns: Sequence[str] | None = None, keep_deletes: bool = False) -> DataFrame:
    """New table state after the change log.

    ``columns`` (default: all change columns but the key) are the columns the state carries. When the
    state carries the order and operation columns too, its rows compete with the new changes, so a change
    that arrives late but is older than the stored row loses; ``keep_deletes=True`` keeps deleted keys as
    tombstones so a late, older upsert cannot bring them back (used by the streaming wrapper). Otherwise the
    base is a plain table: every changed key is replaced by its latest change or removed."""
    keys = [key] if isinstance(key, str) else list(key)
    cols = list(columns) if columns is not None else [c for c in changes.columns if c not in keys]
    work = list(dict.fromkeys([*cols, *order, op_col]))
    # A NULL operation is not a delete (SQL: NULL IN (...) is unknown, so the row is not removed).
    is_delete = F.coalesce(F.col(op_col).isin(*delete_ops), F.lit(False))
    versioned = base is not None and all(c in base.columns for c in work)
    if base is None or versioned:
        log = changes.select(*keys, *work)
        if versioned:
            log = base.select(*keys, *work).unionByName(log)
        latest = latest_per_key(log, keys, order)
        return (latest if keep_deletes else latest.filter(~is_delete)).select(*keys, *cols)
    latest = latest_per_key(changes.select(*keys, *work), keys, order)
    upserts = latest.filter(~is_delete).select(*keys, *cols)
    kept = base.join(latest.select(*keys), keys, "left_anti")
    return kept.unionByName(upserts.select(*base.columns))
