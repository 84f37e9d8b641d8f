"""The change-log stream gives the same state as the batch job over the whole log."""

import os

from pyspark.sql import functions as F

from roster.operators.changelog import apply_changes
from roster.sources.adapter import SOURCE_SCHEMAS
from roster.streaming.changelog_stream import latest_state, start_changelog_stream
from tests.conftest import SF0001


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_stream_matches_batch(spark, scratch):
    events = spark.read.schema(SOURCE_SCHEMAS["events"]).parquet(f"{SF0001}/events.parquet")
    src = os.path.join(scratch, "src")
    # three arrival files, split by event id
    for i in range(3):
        events.filter(F.col("event_id") % 3 == i).coalesce(1).write.parquet(os.path.join(src, f"part{i}"))
    cols = ["event_id", "ts", "event_type", "value", "props"]
    q = start_changelog_stream(spark, os.path.join(src, "*"), SOURCE_SCHEMAS["events"], os.path.join(scratch, "state"),
                               os.path.join(scratch, "ckpt"), "user_id", ["ts", "event_id"], "event_type",
                               ["error"], cols, max_files_per_trigger=1)
    q.awaitTermination(120)
    state_schema = events.select("user_id", *cols).schema
    got = latest_state(spark, os.path.join(scratch, "state"), q, state_schema, "event_type", ["error"])
    want = apply_changes(None, events, "user_id", ["ts", "event_id"], "event_type", ["error"], cols)
    assert _rows(got.select("user_id", *cols)) == _rows(want.select("user_id", *cols))


def test_apply_changes_on_a_base(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    log = spark.createDataFrame([(1, 1, "upsert", "a2"), (2, 1, "delete", None), (1, 2, "upsert", "a3"),
                                 (4, 1, "upsert", "d"), (3, 5, None, "c2")],
                                "k int, seq int, op string, v string")
    out = apply_changes(base, log, "k", ["seq"], "op", ["delete"], ["v"])
    assert _rows(out) == [(1, "a3"), (3, "c2"), (4, "d")]


def test_versioned_state_resists_late_older_changes(spark):
    state = spark.createDataFrame([(1, 5, "upsert", "new"), (2, 5, "delete", None)], "k int, seq int, op string, v string")
    late = spark.createDataFrame([(1, 3, "upsert", "old"), (2, 4, "upsert", "zombie"), (3, 1, "upsert", "c")],
                                 "k int, seq int, op string, v string")
    out = apply_changes(state, late, "k", ["seq"], "op", ["delete"], ["seq", "op", "v"])
    assert _rows(out) == [(1, 5, "upsert", "new"), (3, 1, "upsert", "c")]


def test_state_store_stream_matches_batch(spark, scratch):
    from roster.streaming.changelog_stream import read_latest_state, start_latest_per_key_stream
    events = spark.read.schema(SOURCE_SCHEMAS["events"]).parquet(f"{SF0001}/events.parquet")
    src = os.path.join(scratch, "src")
    for i in range(3):
        events.filter(F.col("event_id") % 3 == i).coalesce(1).write.parquet(os.path.join(src, f"part{i}"))
    cols = ["event_id", "ts", "event_type", "value", "props"]
    q = start_latest_per_key_stream(spark, os.path.join(src, "*"), SOURCE_SCHEMAS["events"],
                                    os.path.join(scratch, "deltas"), os.path.join(scratch, "ckpt"), "user_id",
                                    ["ts", "event_id"], cols, max_files_per_trigger=1)
    q.awaitTermination(180)
    got = read_latest_state(spark, os.path.join(scratch, "deltas"), "user_id", ["ts", "event_id"], "event_type",
                            ["error"], cols)
    want = apply_changes(None, events, "user_id", ["ts", "event_id"], "event_type", ["error"], cols)
    assert _rows(got.select("user_id", *cols)) == _rows(want.select("user_id", *cols))
    # three files, three batches, and later batches only carry the keys they changed
    assert len([d for d in os.listdir(os.path.join(scratch, "deltas")) if d.startswith("v=")]) == 3
