"""Change logs over stored tables: hash buckets, and a stream whose tombstones expire and whose deltas are compacted (W8)."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from roster.operators.changelog import apply_changes
from roster.sources import files
from roster.sources.bucketed import BucketedTable
from roster.streaming import expiring_state as stream

KEYED = "k long, v string, n int"
CHANGE = "k int, seq int, op string, v string, n int"


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def base_rows(n=200):
    return [(i, f"v{i}", i % 7) for i in range(n)]


def model(base, *batches):
    """The table after batches of (k, seq, op, v, n): the latest change of a key per batch."""
    table = {k: (k, v, n) for k, v, n in base}
    for batch in batches:
        latest = {}
        for c in batch:
            if c[0] not in latest or c[1] > latest[c[0]][1]:
                latest[c[0]] = c
        for k, _, op, v, n in latest.values():
            if op == "delete":
                table.pop(k, None)
            else:
                table[k] = (k, v, n)
    return sorted(table.values())


def create(spark, scratch, buckets=8):
    return BucketedTable.create(spark.createDataFrame(base_rows(), KEYED), os.path.join(scratch, "t"), "k", buckets)


def bucket_files(spark, table):
    """bucket -> (name, time) of its files."""
    found = {}
    for e in files.files(spark, f"{table.root}/data"):
        found.setdefault(int(e.path.split("bucket=")[1].split("/")[0]), []).append((e.path, e.modified))
    return found


def test_only_touched_buckets_are_rewritten(spark, scratch):
    table = create(spark, scratch)
    before = bucket_files(spark, table)
    batch = [(3, 1, "upsert", "new", 1), (3, 2, "upsert", "newer", None), (500, 1, None, "added", 2), (9, 4, "delete", None, None)]
    touched = table.apply(spark.createDataFrame(batch, CHANGE), 1, ["seq"], "op")
    after = bucket_files(spark, table)
    assert rows_of(table.read()) == model(base_rows(), batch)
    assert 0 < len(touched) < 8 and set(after) == set(before)
    for b in range(8):
        assert (after[b] == before[b]) == (b not in touched)
    plan = table.read(touched)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket#", "bucket").replace("(", "") or "PartitionFilters: [" in plan


def test_batches_in_order_equal_one_log(spark, scratch):
    rng, table, batches = random.Random(1), create(spark, scratch, 4), []
    for b in range(4):
        batch = [(rng.randrange(260), rng.randrange(10**6), rng.choice(["upsert", "delete", None]), f"b{b}.{i}", i) for i in range(40)]
        batches.append(batch)
        table.apply(spark.createDataFrame(batch, CHANGE), b, ["seq"], "op")
    assert rows_of(table.read()) == model(base_rows(), *batches)
    assert table.applied() == ["0", "1", "2", "3"]
    again = table.apply(spark.createDataFrame(batches[0], CHANGE), 0, ["seq"], "op")     # a retried batch
    assert again == [] and rows_of(BucketedTable(spark, table.root).read()) == model(base_rows(), *batches)


def test_a_bucket_may_lose_all_its_rows(spark, scratch):
    table = create(spark, scratch, 2)
    table.apply(spark.createDataFrame([(i, 1, "delete", None, None) for i in range(200)], CHANGE), 1, ["seq"], "op")
    assert table.read().count() == 0
    table.apply(spark.createDataFrame([(7, 2, "upsert", "x", 1)], CHANGE), 2, ["seq"], "op")
    assert rows_of(table.read()) == [(7, "x", 1)]
    assert table.apply(spark.createDataFrame([], CHANGE), 3, ["seq"], "op") == []


def test_lookups_read_the_buckets_of_their_keys(spark, scratch):
    table = create(spark, scratch)
    got = table.lookup(spark.createDataFrame([(5,), (5,), (999,)], "k int"))
    assert rows_of(got) == [(5, "v5", 5)]


@pytest.mark.parametrize("replaced", [False, True])
def test_a_broken_batch_is_finished(spark, scratch, monkeypatch, replaced):
    """The driver goes while the buckets are replaced, or before: the next call finishes or forgets the batch."""
    table, batch = create(spark, scratch), [(3, 1, "delete", None, None), (4, 1, "upsert", "x", 0)]

    def broken(self, name):
        raise RuntimeError("lost")

    monkeypatch.setattr(BucketedTable, "_replace", broken)
    with pytest.raises(RuntimeError, match="lost"):
        table.apply(spark.createDataFrame(batch, CHANGE), 1, ["seq"], "op")
    monkeypatch.undo()
    if not replaced:        # the new buckets were not complete either
        files.delete(spark, f"{table.root}/_pending/batch=1/_SUCCESS")
    table = BucketedTable(spark, table.root)
    table.recover()
    assert rows_of(table.read()) == model(base_rows(), *([batch] if replaced else []))
    assert files.names(spark, f"{table.root}/_pending") == []
    table.apply(spark.createDataFrame(batch, CHANGE), 1, ["seq"], "op")
    assert rows_of(table.read()) == model(base_rows(), batch)


def test_reserved_columns_and_composite_keys(spark, scratch):
    with pytest.raises(ValueError, match="reserved"):
        BucketedTable.create(spark.createDataFrame([(1, True)], "k int, live boolean"), os.path.join(scratch, "a"), "k", 2)
    pairs = spark.createDataFrame([(1, None, "x"), (1, "b", "y")], "a int, b string, v string")
    table = BucketedTable.create(pairs, os.path.join(scratch, "b"), ["a", "b"], 3)
    table.apply(spark.createDataFrame([(1, "b", 1, "upsert", "z")], "a int, b string, seq int, op string, v string"), 0, ["seq"], "op")
    assert sorted(r.v for r in table.read().collect()) == ["x", "z"]


def test_a_hot_key_in_the_log_is_one_row_a_task(spark, scratch):
    table = create(spark, scratch)
    log = spark.range(5000).select((F.col("id") % 3 * F.col("id") % 9).cast("int").alias("k"), F.col("id").cast("int").alias("seq"),
                                   F.lit("upsert").alias("op"), F.col("id").cast("string").alias("v"), F.lit(1).alias("n"))
    table.apply(log, 1, ["seq"], "op")
    assert rows_of(table.read()) == model(base_rows(), [tuple(r) for r in log.collect()])


# ---------------------------------------------------------------- stream

@pytest.fixture()
def rocks(spark):
    old = spark.conf.get(stream.STATE_STORE[0])
    spark.conf.set(*stream.STATE_STORE)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield spark
    spark.conf.set(stream.STATE_STORE[0], old)
    spark.conf.set("spark.sql.shuffle.partitions", "8")


LOG = "k long, seq long, op string, v string"


def run(spark, scratch, source, retention_ms, compact_every=8):
    changes = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(source)
    table = stream.StoredTable(spark, os.path.join(scratch, "table"), changes.schema, ["k"], ["seq"], "op", ["delete"], retention_ms)
    query = stream.start_expiring_stream(changes, table, os.path.join(scratch, "ckpt"), compact_every)
    ended = query.awaitTermination(150)
    query.stop()
    assert ended and query.exception() is None
    return table


def test_after_twenty_batches_a_reader_opens_one_base_and_the_deltas_since(rocks, scratch):
    rng, source, rows = random.Random(4), os.path.join(scratch, "src"), []
    for b in range(20):
        part = [(rng.randrange(30), b * 10 + rng.randrange(40) - 20, rng.choice(["upsert", "upsert", "delete"]), f"{b}.{i}") for i in range(15)]
        part = [p for i, p in enumerate(part) if (p[0], p[1]) not in {(r[0], r[1]) for r in rows + part[:i]}]     # no ties
        rows += part
        rocks.createDataFrame(part, LOG).coalesce(1).write.mode("append").parquet(source)
    table = run(rocks, scratch, source, retention_ms=10**9)
    log = rocks.createDataFrame(rows, LOG)
    want = apply_changes(None, log, "k", ["seq"], "op", ["delete"], ["seq", "op", "v"])
    assert rows_of(table.read()) == rows_of(want)
    base, deltas = table.opened()
    assert base == 15 and deltas[:4] == [16, 17, 18, 19] and len(deltas) <= 5       # a last batch without rows may follow
    assert files.names(rocks, f"{table.root}/base") == ["v=000000000015"] and len(files.names(rocks, f"{table.root}/deltas")) == len(deltas)
    table.compact(20, 0)
    table.compact(20, 0)        # a repeat after a loss
    assert rows_of(table.read()) == rows_of(want) and table.opened() == (20, [])


def test_tombstones_hold_until_their_timer_and_then_go(rocks, scratch):
    source = os.path.join(scratch, "src")

    def add(*rows):
        rocks.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(source)

    def emitted(table):
        """(key, order) of every delta row."""
        return sorted((r.k, r.seq) for r in rocks.read.parquet(*[f"{table.root}/deltas/v={v:012d}" for v in table.opened()[1]]).collect())

    add((1, 5, "upsert", "a"), (2, 5, "upsert", "b"))
    add((1, 7, "delete", None))
    add((1, 6, "upsert", "late"), (2, 4, "upsert", "late"))      # older than what is known
    runs = {ms: os.path.join(scratch, str(ms)) for ms in (0, 10**9)}
    for ms, folder in runs.items():
        table = run(rocks, folder, source, ms, 100)
        assert rows_of(table.read()) == [(2, 5, "upsert", "b")] and emitted(table) == [(1, 5), (1, 7), (2, 5)]
    add((1, 3, "upsert", "later"), (3, 1, "upsert", "c"))
    held, gone = (run(rocks, runs[ms], source, ms, 100) for ms in (10**9, 0))
    assert (1, 3) not in emitted(held) and (1, 3) in emitted(gone)          # the timer has dropped the tombstone
    gone.compact(99, 2**60)
    assert rows_of(rocks.read.parquet(f"{gone.root}/base").select("k", "op")) == [(2, "upsert"), (3, "upsert")]
    held.compact(99, 0)
    assert rows_of(held.read()) == [(2, 5, "upsert", "b"), (3, 1, "upsert", "c")]


def test_the_state_store_is_asked_for(spark, scratch):
    changes = spark.readStream.schema(LOG).parquet(scratch)
    table = stream.StoredTable(spark, scratch, changes.schema, ["k"], ["seq"], "op")
    if spark.conf.get(stream.STATE_STORE[0]) != stream.STATE_STORE[1]:
        with pytest.raises(ValueError, match="RocksDB"):
            stream.start_expiring_stream(changes, table, scratch)
