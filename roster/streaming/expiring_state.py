"""Change log from a stream with state that does not grow with deleted keys, and a compacted table (W8).

``transformWithState`` keeps the latest change of every key. A delete stays as a tombstone, so that an older change of the
key that arrives later can't bring it back; a timer drops the tombstone ``retention_ms`` after the delete arrived. Event
time is the time of arrival, one for all rows of a micro-batch, so that no change is ever late for the watermark, however
old its order columns are, and a repeated batch sees the same time. Each micro-batch emits the keys it changed, with the
arrival time, and writes them to one delta folder per batch (overwritten when a batch is retried).

Every ``compact_every`` batches the deltas and the base before them become a new base: the latest row per key, without
tombstones older than the retention. The base is complete before anything else goes; then the deltas it holds and the
older bases are deleted. ``read_table`` opens the newest complete base and the deltas after it, so a reader's work is
bounded by the table and ``compact_every`` batches, not by the age of the stream.

The state store must be RocksDB (``STATE_STORE``), which keeps state on disk with checkpoints in the shared folder.
"""

from __future__ import annotations

import time
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from roster.operators.changelog import latest_per_key
from roster.sources import files

STATE_STORE = ("spark.sql.streaming.stateStore.providerClass",
               "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
ARRIVED = "arrived_ms"


class LatestChange(StatefulProcessor):
    """The latest change of a key; a delete is forgotten when its timer expires."""

    def __init__(self, columns: T.StructType, keys: Sequence[str], order: Sequence[str], op_col: str, delete_ops: Sequence[str],
                 retention_ms: int):
        self.columns, self.keys, self.order = columns, list(keys), list(order)
        self.op_col, self.delete_ops, self.retention_ms = op_col, set(delete_ops), retention_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.latest = handle.getValueState("latest", self.columns)

    def _place(self, values: dict) -> tuple:
        """Order as Spark sorts: nulls first."""
        return tuple((values[c] is not None, values[c]) if values[c] is not None else (False,) for c in self.order)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        names, best, changed = self.columns.names, None, False
        if self.latest.exists():
            best = dict(zip(names, self.latest.get(), strict=True))
        for row in rows:
            values = {c: row[c] for c in names}
            if best is None or self._place(values) > self._place(best):
                best, changed = values, True
        if not changed:
            return
        self.latest.update(tuple(best[c] for c in names))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        now = row[ARRIVED]
        if best[self.op_col] in self.delete_ops:
            self.handle.registerTimer(now + self.retention_ms)
        yield Row(**dict(zip(self.keys, key, strict=True)), **best, **{ARRIVED: now})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.latest.exists() and dict(zip(self.columns.names, self.latest.get(), strict=True))[self.op_col] in self.delete_ops:
            self.latest.clear()
        return iter(())

    def close(self) -> None:
        pass


def _delta(root: str, batch_id: int) -> str:
    return f"{root}/deltas/v={batch_id:012d}"


def _base(root: str, batch_id: int) -> str:
    return f"{root}/base/v={batch_id:012d}"


def _versions(spark: SparkSession, folder: str) -> list[int]:
    """Batch numbers of the complete folders below one, in order."""
    return [int(n.removeprefix("v=")) for n in files.names(spark, folder) if n.startswith("v=") and files.complete(spark, f"{folder}/{n}")]


class StoredTable:
    """The folders of one stream's table."""

    def __init__(self, spark: SparkSession, root: str, columns: T.StructType, keys: Sequence[str], order: Sequence[str], op_col: str,
                 delete_ops: Sequence[str] = ("delete",), retention_ms: int = 7 * 24 * 3600 * 1000):
        self.spark, self.root = spark, root.rstrip("/")
        self.keys, self.order, self.op_col, self.delete_ops, self.retention_ms = list(keys), list(order), op_col, list(delete_ops), retention_ms
        self.rows = T.StructType([*columns, T.StructField(ARRIVED, T.LongType())])

    def opened(self) -> tuple[int | None, list[int]]:
        """The newest base and the deltas after it."""
        bases = _versions(self.spark, f"{self.root}/base")
        base = bases[-1] if bases else None
        return base, [v for v in _versions(self.spark, f"{self.root}/deltas") if base is None or v > base]

    def _log(self, base: int | None, deltas: Sequence[int]) -> DataFrame:
        paths = ([_base(self.root, base)] if base is not None else []) + [_delta(self.root, v) for v in deltas]
        if not paths:
            return self.spark.createDataFrame([], self.rows)
        return self.spark.read.schema(self.rows).parquet(*paths)

    def _deleted(self):
        return F.coalesce(F.col(self.op_col).isin(self.delete_ops), F.lit(False))

    def read(self) -> DataFrame:
        """The table now, deletes left out."""
        base, deltas = self.opened()
        return latest_per_key(self._log(base, deltas), self.keys, self.order).filter(~self._deleted()).drop(ARRIVED).select(
            *[c for c in self.rows.names if c != ARRIVED])

    def compact(self, upto: int, now_ms: int) -> None:
        """Make a base of everything through batch ``upto``; then delete what it replaces. Safe to repeat."""
        base, deltas = self.opened()
        if base is None or base < upto:
            rows = latest_per_key(self._log(base, [v for v in deltas if v <= upto]), self.keys, self.order)
            rows = rows.filter(~self._deleted() | (F.col(ARRIVED) + F.lit(self.retention_ms) > F.lit(now_ms)))
            rows.select(*self.rows.names).write.mode("overwrite").parquet(_base(self.root, upto))
            base = upto
        for v in _versions(self.spark, f"{self.root}/deltas"):
            if v <= base:
                files.delete(self.spark, _delta(self.root, v))
        for v in _versions(self.spark, f"{self.root}/base"):
            if v < base:
                files.delete(self.spark, _base(self.root, v))


def start_expiring_stream(changes: DataFrame, table: StoredTable, checkpoint_location: str, compact_every: int = 10,
                          available_now: bool = True) -> StreamingQuery:
    """Apply a stream of changes (key, order, operation and table columns) to a stored table."""
    spark = changes.sparkSession
    if spark.conf.get(*STATE_STORE[:1], None) != STATE_STORE[1]:
        raise ValueError(f"set {STATE_STORE[0]} to {STATE_STORE[1]}: timers need the RocksDB state store")
    keys, names = table.keys, [c for c in table.rows.names if c != ARRIVED]
    state = T.StructType([f for f in table.rows if f.name not in {*keys, ARRIVED}])
    out = T.StructType([*[table.rows[k] for k in keys], *state, table.rows[ARRIVED]])
    processor = LatestChange(state, keys, table.order, table.op_col, table.delete_ops, table.retention_ms)
    arriving = changes.select(*names).withColumn("arrived", F.current_timestamp()).withColumn(ARRIVED, F.unix_millis("arrived"))
    latest = arriving.withWatermark("arrived", "0 seconds").groupBy(*keys).transformWithState(processor, out, "Update", "EventTime")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.select(*table.rows.names).write.mode("overwrite").parquet(_delta(table.root, batch_id))
        if (batch_id + 1) % compact_every == 0:
            table.compact(batch_id, int(time.time() * 1000))

    writer = latest.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint_location)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")).start()
