"""Partition counts that grow with the data.

A session's ``spark.sql.shuffle.partitions`` is one number for small and large tables. Where it leaves more rows to a task
than ``ROWS_PER_TASK``, the rows are dealt out by key to as many tasks as they need, so that what a task sorts or
groups stays the same while the table grows. Where it doesn't, AQE would still join its partitions until a task has so many
compressed bytes, or the session no more tasks than cores (and shares those out among the sides of a union), which for short
rows is millions a task: tables of more than ``AQE_TASKS`` tasks are dealt out to a number that AQE keeps. Smaller ones are
left to AQE.

Rows are dealt out by keys that (nearly) tell them apart, never by one that can be hot. Joins on such a key are left to
Spark's own exchange, which AQE can split, and hash the smaller side instead of sorting the larger (``hashed``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# A row of a few numbers takes some 100 bytes in a sort or hash map.
ROWS_PER_TASK = 1 << 19
# Beyond so many tasks each takes more rows: the driver keeps a status of every task and partition.
MOST_TASKS = 20_000
# Rows of so many tasks may end in one, if AQE joins all partitions.
AQE_TASKS = 2
# So many times the tasks needed, if the session's number allows, keep its cores busy.
SPARE = 4


def tasks_for(spark: SparkSession, rows: int) -> int:
    """Tasks for so many rows; 0 if the session's own number will do."""
    wanted = _needed(rows)
    return wanted if wanted > int(spark.conf.get("spark.sql.shuffle.partitions")) else 0


def kept_tasks(spark: SparkSession, rows: int) -> int:
    """Tasks for so many rows, which AQE doesn't join into fewer; 0 for so few rows that it may."""
    wanted, own = _needed(rows), int(spark.conf.get("spark.sql.shuffle.partitions"))
    return tasks_for(spark, rows) or (min(own, SPARE * wanted) if wanted > AQE_TASKS else 0)


def _needed(rows: int) -> int:
    return min(-(-rows // ROWS_PER_TASK), MOST_TASKS)


def spread(df: DataFrame, tasks: int, *keys: str) -> DataFrame:
    return df.repartition(tasks, *keys) if tasks else df


def hashed(df: DataFrame, tasks: int) -> DataFrame:
    """The side of a join that is hashed, so that the other, of many rows, need not be sorted."""
    return df.hint("shuffle_hash") if tasks else df
