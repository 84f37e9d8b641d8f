"""Bulk loads of literal rows and CSV files into model tables (S3).

Rows are matched to columns by name, so an insert that lists its columns in another order, or leaves out
an auto-generated id, loads the same. Rows without an id in an AUTO_INCREMENT table get 1, 2, ... in
the order given. Literal rows are small by nature (a seed script); large loads go through ``read_csv``
or Parquet, which Spark reads in parallel.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roster import schema
from roster.sources.tables import Tables

Row = Mapping[str, object] | Sequence[object]


def rows_frame(spark: SparkSession, name: str, rows: Sequence[Row], columns: Sequence[str] | None = None) -> DataFrame:
    spec = schema.table(name)
    cols = list(columns) if columns is not None else None
    records = []
    last = 0
    for row in rows:
        rec = dict(row) if isinstance(row, Mapping) else dict(zip(cols or spec.columns, row, strict=True))
        unknown = set(rec) - set(spec.columns)
        if unknown:
            raise KeyError(f"{name}: unknown columns {sorted(unknown)}")
        if name in schema.AUTO_INCREMENT:
            if rec.get("id") is None:
                rec["id"] = last + 1
            last = max(last, rec["id"])
        records.append(tuple(rec.get(c) for c in spec.columns))
    return spark.createDataFrame(records, spec.schema)


def tables_from_rows(spark: SparkSession, rows: Mapping[str, Sequence[Row]],
                     columns: Mapping[str, Sequence[str]] | None = None) -> Tables:
    """All 23 tables; those without rows are empty with their schema."""
    frames = {}
    for name in schema.TABLE_NAMES:
        frames[name] = rows_frame(spark, name, rows.get(name, []), (columns or {}).get(name))
    return Tables.from_frames(spark, frames)


def read_csv(spark: SparkSession, name: str, path: str, header: bool = True) -> DataFrame:
    """A table from CSV with a header; columns are matched by name and cast to the model types."""
    spec = schema.table(name)
    raw = spark.read.option("header", header).option("mode", "FAILFAST").csv(path)
    missing = [c for c in spec.columns if c not in raw.columns]
    if missing:
        raise KeyError(f"{name}: CSV lacks columns {missing}")
    return raw.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in spec.schema.fields])
