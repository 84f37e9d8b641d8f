"""Helpers that several corpus operators share: reading tables, pinning intermediate rows, ASCII case folding."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roster.session import ensure_checkpoint_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: U+0020 and U+0009 to U+000D: the white space of every contract here (Unicode spaces are ordinary characters).
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pin(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to a fresh folder below the session's shared checkpoint folder and read it back.

    The copy cuts the lineage: a lost executor re-reads the files, and values that depend on the order of
    evaluation (row ids) are fixed from here on. The folder belongs to the session's checkpoint folder and
    can be removed with it."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/llm/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only. Texts without multi-byte characters take the faster ``lower``."""
    plain = F.octet_length(c) == F.char_length(c)
    return F.when(plain, F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


def slices(batch: pa.RecordBatch, column: int, rows: int = 512, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most ``rows`` rows, and at most ``size`` bytes (or list items) in one column unless a
    single row has more."""
    values = batch.column(column)
    length = pc.list_value_length(values) if pa.types.is_list(values.type) else pc.binary_length(values)
    ends = np.cumsum(length.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        end = max(at + 1, min(at + rows, int(np.searchsorted(ends, before + size, side="right"))))
        yield batch.slice(at, end - at)
        at = end
