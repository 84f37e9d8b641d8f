"""Table row counts and next ids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roster import schema
from roster.sources.tables import Tables


def table_counts(t: Tables, names: list[str] | None = None) -> DataFrame:
    """(table_name, row_count) for every table: one partial-count aggregate per table, unioned."""
    parts = []
    for name in names or t.names():
        # Any one column: Spark prunes the scan to no columns for count(*); avoids generated ids.
        col = schema.table(name).columns[-1]
        parts.append(t.get(name, col).agg(F.count(F.lit(1)).alias("row_count"))
                     .select(F.lit(name).alias("table_name"), "row_count"))
    return reduce(DataFrame.unionByName, parts)


def next_ids(t: Tables) -> DataFrame:
    """(table_name, next_id) for every table with a single-column id: COALESCE(MAX(id), 0) + 1, for AUTO_INCREMENT tables
    counting ids of rows that were deleted since."""
    parts = [t.spark.range(1).select(F.lit(name).alias("table_name"),
                                     (F.coalesce(t.high_water(name), F.lit(0)).cast("bigint") + 1).alias("next_id"))
             for name in t.names() if schema.table(name).primary_key == ("id",)]
    return reduce(DataFrame.unionByName, parts)


def schema_catalog(t: Tables) -> DataFrame:
    """Declared schema of every table joined with what the data holds: one row per column with its type,
    whether it is part of the key, the table it references, and its non-NULL count. One aggregate per
    table, unpivoted to one row per column."""
    refs = {(fk.child, fk.column): fk.parent for fk in schema.FOREIGN_KEYS}
    parts = []
    for name in t.names():
        spec = schema.table(name)
        counted = t.get(name).agg(*[F.count(c).alias(c) for c in spec.columns])
        long = counted.unpivot([], spec.columns, "column_name", "non_null")

        def by_column(values: dict, default=None):
            expr = F.lit(default)
            for col, v in values.items():
                expr = F.when(F.col("column_name") == col, F.lit(v)).otherwise(expr)
            return expr

        parts.append(long.select(
            F.lit(name).alias("table_name"), "column_name",
            by_column({f.name: f.dataType.simpleString() for f in spec.schema.fields}).alias("data_type"),
            by_column({c: True for c in spec.primary_key}, False).alias("is_key"),
            by_column({c: refs[(name, c)] for c in spec.columns if (name, c) in refs}).cast("string")
            .alias("references_table"),
            F.col("non_null").cast("bigint").alias("non_null")))
    return reduce(DataFrame.unionByName, parts)
