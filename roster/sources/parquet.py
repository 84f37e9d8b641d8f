"""Model tables as Parquet folders: write, read back with explicit schemas, and load once (S1, S5, S7).

``load_once`` is the start-up load. Several tables are written at once, and after a table's write has been committed its
entry in the load journal is written: the number of rows, and path, size and time of every input file. A table whose entry
names the inputs as they are now is left alone, so a load that broke off goes on where it stopped, and a table whose input
has changed since is loaded again. Tables with unknown inputs are loaded once. The marks of AUTO_INCREMENT ids are stored with
the tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from roster import schema
from roster.sources import files
from roster.sources.tables import Tables


def table_path(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/{name}"


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.schema(schema.table(name).schema).parquet(table_path(root, name))


def read_tables(spark: SparkSession, root: str, names: Iterable[str] | None = None) -> Tables:
    """Lazily read model tables stored under ``root`` (one folder per table)."""
    marks = {n: (lambda m=m: F.lit(m).cast("bigint")) for n, m in _read_marks(spark, root).items()}
    return Tables(spark, {n: (lambda cols, n=n: read_table(spark, root, n)) for n in (names or schema.TABLE_NAMES)}, marks=marks)


def _marks_path(root: str) -> str:
    return f"{root.rstrip('/')}/id_marks"


def _write_marks(t: Tables, root: str, names: Iterable[str]) -> None:
    """The largest ids given out so far of the AUTO_INCREMENT tables among ``names``, which are stored under ``root``."""
    stored = read_tables(t.spark, root)
    counted = [n for n in names if n in schema.AUTO_INCREMENT]
    if counted:
        rows = [t.spark.range(1).select(F.lit(n).alias("table_name"), F.greatest(
            stored.max_id(n), t.mark(n)).cast("bigint").alias("mark")) for n in counted]
        reduce(DataFrame.unionByName, rows).coalesce(1).write.mode("overwrite").parquet(_marks_path(root))


def _read_marks(spark: SparkSession, root: str) -> dict[str, int]:
    if not files.complete(spark, _marks_path(root)):
        return {}
    return {r.table_name: r.mark for r in spark.read.parquet(_marks_path(root)).collect() if r.mark is not None}    # a row a table


def write_tables(t: Tables, root: str, names: Iterable[str] | None = None, mode: str = "errorifexists") -> None:
    names = list(names or t.names())
    for name in names:
        t.get(name).write.mode(mode).parquet(table_path(root, name))
    _write_marks(t, root, names)


def journal_path(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/journal/{name}"


def _inputs(t: Tables, name: str) -> list[files.Entry]:
    return [e for path in t.lineage.get(name, ()) for e in files.files(t.spark, path)]


def loaded(t: Tables, root: str, name: str) -> bool:
    """Whether the journal says that the table was loaded from its inputs as they are now."""
    if not files.complete(t.spark, journal_path(root, name)):
        return False
    entry = t.spark.read.parquet(journal_path(root, name)).first()
    return [(e.path, e.size, e.modified) for e in entry.inputs] == [(e.path, e.size, e.modified) for e in _inputs(t, name)]


def _load(t: Tables, root: str, name: str, df: DataFrame) -> None:
    inputs = _inputs(t, name)           # before the read: a change during the load shows at the next one
    rows = Observation(f"load {name}")
    df.observe(rows, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(table_path(root, name))
    entry = t.spark.createDataFrame([(name, rows.get["n"], [(e.path, e.size, e.modified) for e in inputs])],
                                    "table_name string, n bigint, inputs array<struct<path: string, size: bigint, modified: bigint>>")
    entry.coalesce(1).write.mode("overwrite").parquet(journal_path(root, name))


def load_once(t: Tables, root: str, names: Iterable[str] | None = None, at_once: int = 6) -> list[str]:
    """Write each table that isn't loaded under ``root`` from its present inputs; return the names written."""
    names = list(names or t.names())
    todo = [n for n in names if not loaded(t, root, n)]
    frames = {n: t.get(n) for n in todo}        # built here: only the writes run side by side
    with ThreadPoolExecutor(at_once) as pool:
        for done in [pool.submit(_load, t, root, n, df) for n, df in frames.items()]:
            done.result()
    if todo:
        _write_marks(t, root, [n for n in t.names() if files.complete(t.spark, table_path(root, n))])
    return todo


def load_journal(spark: SparkSession, root: str) -> DataFrame:
    """(table_name, n, inputs) of the loaded tables."""
    entries = [journal_path(root, n) for n in files.names(spark, f"{root.rstrip('/')}/journal")]
    kind = "table_name string, n bigint, inputs array<struct<path: string, size: bigint, modified: bigint>>"
    return spark.read.schema(kind).parquet(*entries) if entries else spark.createDataFrame([], kind)


def fresh_model_folder(spark: SparkSession) -> str:
    """A new folder for a loaded model inside the session's checkpoint directory (the shared folder the cluster
    names in ``spark.checkpoint.dir``). It is never reused, so a load always reflects the input as it is."""
    from roster.session import ensure_checkpoint_dir
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/roster-model/{uuid.uuid4().hex}"
