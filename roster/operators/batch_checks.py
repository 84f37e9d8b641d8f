"""Validation of a change batch against the keys it touches (W9 for a batch only).

``check_batch`` tells by how much a batch of inserts, updates and deletes changes each count of ``quality.validate``, so that
a stored report plus this one is the report of the changed tables, without validating them again. The rows that go (old)
and come (new) are found by key; of the rows that stay only those count whose parent appears or disappears.

The base tables are read behind a Bloom filter of the keys in question: a bit array computed from them in one small
aggregate, tested in the filter right above the scan (by every row's key, in generated code), so that only candidate rows
reach the exchange of the exact join that follows. A filter that lets too much through costs time, never rows.

Rules, per table of the batch: key duplicates and nulls, form and width rules, and references of the table and to it. An
update of a key without a row does nothing; inserts may repeat keys (that is what the check is for).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roster import schema
from roster.operators.quality import domain_rules
from roster.session import ensure_checkpoint_dir
from roster.sources.tables import Tables

BITS_A_KEY, HASHES = 10, 4
LEAST_BITS, MOST_BITS = 1 << 12, 1 << 23        # of a filter: at most 1 MB


@dataclass(frozen=True)
class Batch:
    inserts: DataFrame | None = None    # whole rows
    updates: DataFrame | None = None    # whole rows, by key
    deletes: DataFrame | None = None    # keys


def _bits(cols: Sequence[str], n: int) -> list[Column]:
    return [F.pmod(F.xxhash64(*cols, F.lit(i)), F.lit(n)) for i in range(HASHES)]


def bloom(keys: DataFrame, cols: Sequence[str]) -> Column:
    """A condition on rows with the same columns that holds for all of ``keys`` and few others: a scalar subquery gives the
    filter's words, of 64 bits each."""
    n = LEAST_BITS
    while n < min(MOST_BITS, BITS_A_KEY * keys.count()):
        n *= 2
    set_bits = keys.select(F.explode(F.array(*_bits(cols, n))).alias("bit"))
    one = F.lit(1).cast("bigint")
    words = set_bits.select(F.shiftright("bit", 6).alias("word"), F.call_function("shiftleft", one, F.col("bit").bitwiseAND(63).cast("int")).alias("mask"))
    every = keys.sparkSession.range(n // 64).select(F.col("id").alias("word"), F.lit(0).cast("bigint").alias("mask"))
    words = words.unionByName(every).groupBy("word").agg(F.bit_or("mask").alias("mask"))
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("word", "mask"))), lambda w: w["mask"])
    array = words.agg(in_order.alias("words")).scalar()
    tests = [F.call_function("shiftright", F.get(array, F.shiftright(b, 6).cast("int")), b.bitwiseAND(63).cast("int")).bitwiseAND(one) == one
             for b in _bits(cols, n)]
    return reduce(lambda a, b: a & b, tests)


def touched_rows(rows: DataFrame, keys: DataFrame, cols: Sequence[str]) -> DataFrame:
    """The rows whose columns equal some key's (nulls equal nulls): the filter at the scan, then the exact check."""
    near = rows.filter(bloom(keys, cols))
    return _matching(near, keys, cols, "left_semi")


def _matching(rows: DataFrame, keys: DataFrame, cols: Sequence[str], how: str) -> DataFrame:
    other = keys.select(*[F.col(c).alias(f"__k_{c}") for c in cols])
    return rows.join(other, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__k_{c}")) for c in cols]), how)


def _typed(df: DataFrame, name: str, cols: Sequence[str]) -> DataFrame:
    kinds = schema.table(name).schema
    return df.select(*[F.col(c).cast(kinds[c].dataType).alias(c) for c in cols])


def _pinned(df: DataFrame) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def _change(t: Tables, name: str, batch: Batch) -> tuple[DataFrame, DataFrame]:
    """(old, new): the rows of the table that go and that come. Both are as small as the batch and are written once."""
    spec = schema.table(name)
    pk, cols, base = list(spec.primary_key), spec.columns, t.get(name)
    keys = [_typed(df, name, pk) for df in (batch.updates, batch.deletes) if df is not None]
    come = [] if batch.inserts is None else [_typed(batch.inserts, name, cols)]
    old = base.limit(0)
    if keys:
        old = _pinned(touched_rows(base, _pinned(reduce(DataFrame.unionByName, keys).distinct()), pk))
    if batch.updates is not None:
        updates = _typed(batch.updates, name, cols)
        if batch.deletes is not None:
            updates = _matching(updates, _typed(batch.deletes, name, pk), pk, "left_anti")
        come.append(_matching(updates, old.select(*pk), pk, "left_semi"))
    return old, _pinned(reduce(DataFrame.unionByName, come)) if come else base.limit(0)


def _signed(old: DataFrame, new: DataFrame, cols: Sequence[str]) -> DataFrame:
    return new.select(*cols, F.lit(1).alias("sign")).unionByName(old.select(*cols, F.lit(-1).alias("sign")))


def _row(rule: str, table: str, column: str, n: DataFrame) -> DataFrame:
    return n.select(F.lit(rule).alias("rule"), F.lit(table).alias("table_name"), F.lit(column).alias("column_name"),
                    F.coalesce("n", F.lit(0)).cast("bigint").alias("n_bad"))


def _domain_changes(name: str, old: DataFrame, new: DataFrame) -> list[DataFrame]:
    rules = domain_rules(name)
    if not rules:
        return []
    rows = _signed(old, new, list(dict.fromkeys(c for _, c in rules)))
    sums = rows.agg(*[F.sum(F.when(bad, F.col("sign"))).alias(f"r{i}") for i, bad in enumerate(rules.values())])
    return [_row(rule, name, c, sums.select(F.col(f"r{i}").alias("n"))) for i, (rule, c) in enumerate(rules)]


def _key_changes(t: Tables, name: str, old: DataFrame, new: DataFrame) -> list[DataFrame]:
    pk = list(schema.table(name).primary_key)
    moved = _signed(old, new, pk).groupBy(*pk).agg(F.sum("sign").alias("by"))
    keys = _pinned(moved)
    held = touched_rows(t.get(name, *pk), keys, pk).groupBy(*pk).agg(F.count(F.lit(1)).alias("n"))
    held = held.select(*[F.col(c).alias(f"__k_{c}") for c in pk], "n")
    both = keys.join(held, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__k_{c}")) for c in pk]), "left")
    n = F.coalesce("n", F.lit(0))
    doubled = both.agg(F.sum(((n + F.col("by")) > 1).cast("int") - (n > 1).cast("int")).alias("n"))
    null = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in pk])
    blank = _signed(old, new, pk).agg(F.sum(F.when(null, F.col("sign"))).alias("n"))
    return [_row("pk_duplicate", name, ",".join(pk), doubled), _row("pk_null", name, ",".join(pk), blank)]


def _reference_change(t: Tables, fk: schema.ForeignKey, changes: Mapping[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """The change of the number of orphans of one edge.

    By parent key: rows that come or go count by whether the parent is there after or before; rows that stay count where
    that changes."""
    def by_key(df: DataFrame, column: str, sign: int) -> DataFrame:
        return df.select(F.col(column).cast("bigint").alias("key"), F.lit(sign).alias("sign")).filter("key IS NOT NULL")

    empty = t.spark.createDataFrame([], "key bigint, sign int")
    child = [by_key(df, fk.column, s) for df, s in zip(changes[fk.child], (-1, 1), strict=True)] if fk.child in changes else [empty]
    parent = [by_key(df, fk.parent_column, s) for df, s in zip(changes[fk.parent], (-1, 1), strict=True)] if fk.parent in changes else [empty]
    count = [F.count_if(F.col("sign") == s).alias(c) for s, c in ((-1, "gone"), (1, "come"))]
    children = reduce(DataFrame.unionByName, child).groupBy("key").agg(*count)
    parents = reduce(DataFrame.unionByName, parent).groupBy("key").agg(F.sum("sign").alias("by"))
    keys = _pinned(children.join(parents, "key", "full").na.fill(0))
    known = t.get(fk.parent, fk.parent_column).select(F.col(fk.parent_column).cast("bigint").alias("key"))
    known = touched_rows(known, keys, ["key"]).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    judged = _pinned(keys.join(known, "key", "left").select(
        "key", "gone", "come", (F.coalesce("n", F.lit(0)) == 0).cast("int").alias("before"),
        (F.coalesce("n", F.lit(0)) + F.col("by") <= 0).cast("int").alias("after")))
    moved = judged.agg(F.sum(F.col("come") * F.col("after") - F.col("gone") * F.col("before")).alias("n"))
    if fk.parent not in changes:
        return _row("fk_orphan", fk.child, fk.column, moved)
    turned = judged.filter("before <> after").select("key", "before", "after", "gone")
    rows = t.get(fk.child, fk.column).select(F.col(fk.column).cast("bigint").alias("key"))
    staying = (touched_rows(rows, turned, ["key"]).groupBy("key").agg(F.count(F.lit(1)).alias("n")).join(turned, "key")
               .agg(F.sum((F.col("n") - F.col("gone")) * (F.col("after") - F.col("before"))).alias("n")))
    return _row("fk_orphan", fk.child, fk.column, moved.unionByName(staying).agg(F.sum("n").alias("n")))


def check_batch(t: Tables, batches: Mapping[str, Batch]) -> DataFrame:
    """(rule, table_name, column_name, n_bad): by how much the batches change each count of ``quality.validate``, for the
    rules of their tables and the references into these."""
    changes = {name: _change(t, name, batch) for name, batch in batches.items()}
    parts: list[DataFrame] = []
    for name, (old, new) in changes.items():
        parts += _key_changes(t, name, old, new) + _domain_changes(name, old, new)
    parts += [_reference_change(t, fk, changes) for fk in schema.FOREIGN_KEYS if fk.child in changes or fk.parent in changes]
    return reduce(DataFrame.unionByName, parts)
