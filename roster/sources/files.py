"""Folders of stored tables, through the Hadoop file system that Spark writes them with (local disk, HDFS, object stores).

Only names and times are read here, on the driver; rows are always read and written by Spark.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass(frozen=True, order=True)
class Entry:
    path: str
    size: int
    modified: int       # milliseconds since 1970


def _open(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _open(spark, path)
    return fs.exists(p)


def complete(spark: SparkSession, folder: str) -> bool:
    """Whether a Spark job has committed its output to the folder."""
    return exists(spark, f"{folder}/_SUCCESS")


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names of a folder's entries in order; none if it is missing."""
    fs, p = _open(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def files(spark: SparkSession, path: str) -> list[Entry]:
    """The data files of a table in order: a file, or those at any depth of a folder without hidden ones."""
    fs, p = _open(spark, path)
    if not fs.exists(p):
        return []
    found, it = [], fs.listFiles(p, True)
    while it.hasNext():
        s = it.next()
        if not s.getPath().getName().startswith(("_", ".")):
            found.append(Entry(s.getPath().toString(), s.getLen(), s.getModificationTime()))
    return sorted(found)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a superseded folder; a missing one is no error."""
    fs, p = _open(spark, path)
    fs.delete(p, True)
