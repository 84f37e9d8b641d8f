"""Change log applied from a stream (W8 with ``foreachBatch``).

The batch job ``operators.changelog.apply_changes`` runs on every micro-batch; the state keeps the order
and operation columns plus delete tombstones, so changes that arrive late and out of order still resolve
to the latest one per key. The table state is kept
as one Parquet folder per batch id: batch ``n`` reads the folder of batch ``n - 1`` (or the initial state),
applies its changes and overwrites folder ``n``. A retried batch rewrites the same folder from the same
inputs, so the sink is idempotent, and reading each version back from files cuts the lineage every batch.
The stream's own progress lives in ``checkpoint_location``, which must be a shared folder on a cluster.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from roster.operators.changelog import apply_changes
from roster.sources import files


def version_path(state_dir: str, batch_id: int) -> str:
    return f"{state_dir.rstrip('/')}/v={batch_id:012d}"


def read_version(spark: SparkSession, state_dir: str, batch_id: int, state_schema: T.StructType) -> DataFrame:
    """The state after a batch. A missing folder raises: going on without it would lose every earlier change."""
    return spark.read.schema(state_schema).parquet(version_path(state_dir, batch_id))


def start_changelog_stream(spark: SparkSession, source_dir: str, source_schema: T.StructType | str, state_dir: str,
                           checkpoint_location: str, key: str | Sequence[str], order: Sequence[str], op_col: str,
                           delete_ops: Sequence[str] = ("delete",), columns: Sequence[str] | None = None,
                           initial: DataFrame | None = None, available_now: bool = True,
                           max_files_per_trigger: int | None = None) -> StreamingQuery:
    keys = [key] if isinstance(key, str) else list(key)
    reader = spark.readStream.schema(source_schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    changes = reader.parquet(source_dir)
    cols = list(columns) if columns is not None else [c for c in changes.columns if c not in keys]
    state_schema = T.StructType([changes.schema[c] for c in keys + cols])

    def apply_batch(batch: DataFrame, batch_id: int) -> None:
        if batch_id > 0:
            previous = read_version(batch.sparkSession, state_dir, batch_id - 1, state_schema)
        else:
            previous = initial.select(*keys, *cols) if initial is not None else None
        state = apply_changes(previous, batch, keys, order, op_col, delete_ops, cols, keep_deletes=True)
        state.write.mode("overwrite").parquet(version_path(state_dir, batch_id))

    writer = changes.writeStream.foreachBatch(apply_batch).option("checkpointLocation", checkpoint_location)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


def latest_state(spark: SparkSession, state_dir: str, query: StreamingQuery, state_schema: T.StructType,
                 op_col: str | None = None, delete_ops: Sequence[str] = ("delete",)) -> DataFrame | None:
    """State after the last batch the query committed; with ``op_col``, deleted keys (tombstones) are
    left out."""
    progress = query.lastProgress
    if not progress:
        return None
    # The final progress report may belong to a batch that found no new files and wrote nothing.
    written = [int(n.removeprefix("v=")) for n in files.names(spark, state_dir)
               if n.startswith("v=") and files.complete(spark, f"{state_dir.rstrip('/')}/{n}")]
    written = [v for v in written if v <= int(progress["batchId"])]
    if not written:
        return None
    state = read_version(spark, state_dir, max(written), state_schema)
    return state if op_col is None else state.filter(~F.coalesce(F.col(op_col).isin(*delete_ops), F.lit(False)))


def start_latest_per_key_stream(spark: SparkSession, source_dir: str, source_schema: T.StructType | str,
                                delta_dir: str, checkpoint_location: str, key: str | Sequence[str],
                                order: Sequence[str], columns: Sequence[str] | None = None,
                                available_now: bool = True, max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Incremental variant: the latest change per key lives in the state store of a streaming ``max_by``
    aggregation (partitioned by key across the shuffle partitions), and each micro-batch emits only the
    keys it changed (update mode). Those rows are written as one delta folder per batch id (overwritten on
    retry), so a batch costs what it changed, not the size of the table. ``columns`` must include the
    order columns and the operation column, so ``read_latest_state`` can resolve the deltas."""
    keys = [key] if isinstance(key, str) else list(key)
    reader = spark.readStream.schema(source_schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    changes = reader.parquet(source_dir)
    cols = list(columns) if columns is not None else [c for c in changes.columns if c not in keys]
    missing = [c for c in order if c not in cols]
    if missing:
        raise ValueError(f"the state must carry the order columns {missing}")
    latest = (changes.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("__last"))
              .select(*keys, *[F.col(f"__last.{c}").alias(c) for c in cols]))

    def write_delta(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(version_path(delta_dir, batch_id))

    writer = (latest.writeStream.outputMode("update").foreachBatch(write_delta)
              .option("checkpointLocation", checkpoint_location))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


def read_latest_state(spark: SparkSession, delta_dir: str, key: str | Sequence[str], order: Sequence[str],
                      op_col: str, delete_ops: Sequence[str] = ("delete",),
                      columns: Sequence[str] | None = None) -> DataFrame:
    """Current table from the deltas: the latest row per key over all batches, deletes left out."""
    keys = [key] if isinstance(key, str) else list(key)
    deltas = spark.read.parquet(delta_dir)
    cols = list(columns) if columns is not None else [c for c in deltas.columns if c not in keys and c != "v"]
    return apply_changes(None, deltas.select(*keys, *cols), keys, order, op_col, delete_ops, cols)
