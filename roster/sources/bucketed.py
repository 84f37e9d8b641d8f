"""A keyed table stored in hash buckets of its key, changed by change logs that rewrite only the buckets they touch (W8).

``create`` writes a table once, as one Parquet partition folder a bucket. ``apply`` reduces a batch of changes to the latest
one per key, reads the buckets these keys fall into (partition pruning: the files of other buckets are not even listed),
and replaces those buckets by dynamic partition overwrite. A batch costs what its buckets hold, not what the table holds;
with as many buckets as keep one at some hundred megabytes, small batches over a large table rewrite little.

Safe against a lost driver: the new buckets are first written completely to ``_pending`` and only then copied over the old
ones, so a batch that broke off while buckets were being replaced is finished from ``_pending`` by the next call
(``recover``). Each applied batch leaves its number in ``log``, and applying it again does nothing. One writer at a time.

Every rewritten bucket holds one row with ``live`` false, so that a bucket whose last row goes is still replaced; ``read``
leaves these rows out. Large buckets are spread over several files, as Spark's rebalancing sees fit.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roster.operators.changelog import apply_changes, latest_per_key
from roster.session import ensure_checkpoint_dir
from roster.sources import files

BUCKET, LIVE = "bucket", "live"


class BucketedTable:
    def __init__(self, spark: SparkSession, root: str):
        """Open a table that ``create`` made."""
        self.spark, self.root = spark, root.rstrip("/")
        about = json.loads(spark.read.parquet(f"{self.root}/about").first().about)
        self.key, self.buckets = about["key"], about["buckets"]
        self.schema = T.StructType.fromJson(about["schema"])

    @classmethod
    def create(cls, table: DataFrame, root: str, key: str | Sequence[str], buckets: int) -> "BucketedTable":
        keys = [key] if isinstance(key, str) else list(key)
        taken = {BUCKET, LIVE} & set(table.columns)
        if taken or buckets < 1:
            raise ValueError(f"columns {sorted(taken)} are reserved" if taken else "a table needs a bucket")
        root, spark = root.rstrip("/"), table.sparkSession
        rows = table.withColumn(LIVE, F.lit(True)).withColumn(BUCKET, _bucket(keys, buckets))
        _spread(rows).write.partitionBy(BUCKET).parquet(f"{root}/data")
        about = json.dumps({"key": keys, "buckets": buckets, "schema": json.loads(table.schema.json())})
        spark.createDataFrame([(about,)], "about string").coalesce(1).write.parquet(f"{root}/about")     # last: the table is whole
        return cls(spark, root)

    def _stored(self, folder: str) -> DataFrame:
        full = T.StructType([*self.schema, T.StructField(LIVE, T.BooleanType()), T.StructField(BUCKET, T.IntegerType())])
        return self.spark.read.schema(full).parquet(folder)

    def read(self, buckets: Sequence[int] | None = None) -> DataFrame:
        """The table, or the rows of some buckets."""
        rows = self._stored(f"{self.root}/data").filter(LIVE)
        if buckets is not None:
            rows = rows.filter(F.col(BUCKET).isin(list(buckets)))
        return rows.select(*self.schema.names)

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The rows of some keys; only their buckets are read."""
        wanted = keys.select(*self._keys()).distinct().withColumn(BUCKET, _bucket(self.key, self.buckets))
        numbers = [r[0] for r in wanted.select(BUCKET).distinct().collect()]     # at most ``buckets`` numbers
        return self.read(numbers).join(wanted.select(*self.key), self.key, "left_semi")

    def _keys(self) -> list[Column]:
        """The key columns in the table's types, on which the hash depends."""
        return [F.col(c).cast(self.schema[c].dataType).alias(c) for c in self.key]

    def applied(self) -> list[str]:
        """Numbers of the batches applied so far."""
        return [n.removeprefix("batch=") for n in files.names(self.spark, f"{self.root}/log")
                if files.complete(self.spark, f"{self.root}/log/{n}")]

    def recover(self) -> None:
        """Finish a batch that broke off after its new buckets were written, and forget one that broke off before."""
        for name in files.names(self.spark, f"{self.root}/_pending"):
            pending, batch = f"{self.root}/_pending/{name}", name.removeprefix("batch=")
            if files.complete(self.spark, pending) and batch not in self.applied():
                self._replace(batch)
            files.delete(self.spark, pending)

    def _replace(self, batch: str) -> None:
        pending = self._stored(f"{self.root}/_pending/batch={batch}")
        (pending.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET)
         .parquet(f"{self.root}/data"))
        counts = pending.groupBy(BUCKET).agg(F.count_if(F.col(LIVE)).alias("rows"))
        counts.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/log/batch={batch}")

    def apply(self, changes: DataFrame, batch: str | int, order: Sequence[str], op_col: str,
              delete_ops: Sequence[str] = ("delete",)) -> list[int]:
        """Apply a batch of changes (key, order, operation and table columns); the buckets it touched. Rules as in
        ``changelog.apply_changes``. A batch that was applied before changes nothing."""
        self.recover()
        if str(batch) in self.applied():
            return []
        cols = [c for c in self.schema.names if c not in self.key]
        work = list(dict.fromkeys([*cols, *order, op_col]))
        ensure_checkpoint_dir(self.spark)
        # The latest changes are read several times: written once, so that the steps see the same rows.
        latest = latest_per_key(changes.select(*self._keys(), *work), self.key, order).checkpoint()
        placed = latest.select(_bucket(self.key, self.buckets).alias(BUCKET)).distinct()
        touched = sorted(r[0] for r in placed.collect())        # at most ``buckets`` numbers
        if touched:
            rows = apply_changes(self.read(touched), latest, self.key, order, op_col, delete_ops, cols)
            new = rows.select(*[F.col(f.name).cast(f.dataType) for f in self.schema]).withColumn(LIVE, F.lit(True))
            new = new.withColumn(BUCKET, _bucket(self.key, self.buckets))
            marks = placed.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema], F.lit(False).alias(LIVE), BUCKET)
            _spread(new.unionByName(marks)).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{self.root}/_pending/batch={batch}")
            self._replace(str(batch))
            files.delete(self.spark, f"{self.root}/_pending/batch={batch}")
        return touched


def _bucket(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _spread(rows: DataFrame) -> DataFrame:
    """A bucket's rows together; small buckets share a task, and a large one is split over several."""
    return rows.hint("rebalance", F.col(BUCKET))
