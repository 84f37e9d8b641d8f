"""Rows a task: tables of many rows are dealt out to as many tasks as they need, with the rows that small ones give."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from roster.plans import partitions
from roster.registry import QUERIES
from roster.sources.adapter import SOURCE_SCHEMAS, star_schema_tables

LINES, A_TASK = 3000, 100

# Keys that repeat, keys without a parent and null keys; a third of the lines is one pair, names repeat.
SOURCES = {
    "region": (3, ["id", "concat('R', id)"]),
    "nation": (6, ["id", "concat('N', id)", "id % 3"]),
    "customer": (60, ["if(id = 7, null, id)", "concat('c', id % 40)", "id % 6", "0.5d", "'BUILDING'"]),
    "supplier": (41, ["if(id = 40, 3, id)", "concat('s', id % 30)", "id % 6", "0.5d"]),
    "part": (80, ["id", "concat('p', id % 9)", "concat('Brand#', 11 + id % 5)", "concat('T', id % 4)", "1 + id % 7", "9.5d"]),
    "orders": (1000, ["id", "id % 70", "'F'", "10.25d", "timestamp_ntz '1995-01-02 00:00:00'", "concat(1 + id % 5, '-X')"]),
    "lineitem": (LINES, ["id div 3", "if(id % 3 = 0, 5, if(id % 101 = 0, null, id % 97))", "if(id % 3 = 0, 3, if(id % 103 = 0, null, id % 43))",
                         "1 + id % 3", "1d", "1d", "0d", "0d", "'N'", "'O'", "timestamp_ntz '1995-01-02 00:00:00'"]),
    "events": (900, ["id", "timestamp_ntz '1995-01-02 03:00:00'", "id % 90", "if(id % 9 = 0, 'error', 'view')", "1d", "'{}'"]),
}

NAMED = ["link_teaches", "cascade_person_rows", "link_label_index_teaches", "unlink_teaches_outcomes", "link_teaches_rows", "unlink_teaches", "check_pk"]
SHARED = ["link_student_plan", "link_guardianship_rows", "unlink_student_plan", "link_label_index", "link_enrollment", "cascade_person", "unlink_one"]


@pytest.fixture(scope="module")
def sources(spark, tmp_path_factory):
    top = str(tmp_path_factory.mktemp("star"))
    for name, (n, values) in SOURCES.items():
        kinds = SOURCE_SCHEMAS[name].split(", ")
        cols = [F.expr(v).cast(k.split()[1]).alias(k.split()[0]) for v, k in zip(values, kinds, strict=True)]
        spark.range(n).select(*cols).write.parquet(f"{top}/{name}.parquet")
    return top


def _rows(df):
    return Counter(map(tuple, df.collect()))


@pytest.mark.parametrize("name", NAMED + SHARED)
def test_same_rows_when_dealt_out(spark, sources, monkeypatch, name):
    want = _rows(QUERIES[name].job(star_schema_tables(spark, sources)))
    monkeypatch.setattr(partitions, "ROWS_PER_TASK", A_TASK)
    got = _rows(entry.queries()[name](spark, sources))
    assert sum(want.values()) > 0
    if name == "link_enrollment":   # which of two equal pairs takes which id is open
        assert len(got) == len(want) and Counter(r[1:] for r in got.elements()) == Counter(r[1:] for r in want.elements())
    else:
        assert got == want


@pytest.mark.parametrize("name", NAMED)
def test_tasks_grow_with_the_lines(spark, sources, monkeypatch, name):
    monkeypatch.setattr(partitions, "ROWS_PER_TASK", A_TASK)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = entry.queries()[name](spark, sources)._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    # The pairs of the lines go to so many tasks, by both keys of the pair.
    assert "hashpartitioning(instructor_id#" in plan and f", {LINES // A_TASK}), REPARTITION_BY_NUM" in plan


def test_small_tables_keep_the_sessions_number(spark, sources):
    t = star_schema_tables(spark, sources)
    assert t.tasks("teaches") == 0 and "REPARTITION_BY_NUM" not in t.get("teaches")._jdf.queryExecution().toString()


def test_tasks_for(spark, monkeypatch):
    own = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = partitions.ROWS_PER_TASK
    assert [partitions.tasks_for(spark, r) for r in (0, n * own, n * own + 1, n * 500)] == [0, 0, own + 1, 500]
    assert partitions.tasks_for(spark, n * 10**9) == partitions.MOST_TASKS


def test_aqe_keeps_the_tasks_of_the_lines(spark, sources, monkeypatch):
    name = "link_teaches_rows"
    want = _rows(QUERIES[name].job(star_schema_tables(spark, sources)))
    own = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The session's own number of partitions leaves few enough rows to a task, if AQE doesn't join them.
    monkeypatch.setattr(partitions, "ROWS_PER_TASK", -(-LINES // (own - 1)))
    assert partitions.tasks_for(spark, LINES) == 0
    df = entry.queries()[name](spark, sources)
    assert _rows(df) == want
    dealt = re.findall(r"Exchange hashpartitioning\(instructor_id#\d+L, class_id#\d+L, (\d+)\), (\w+)", df._jdf.queryExecution().toString())
    assert set(dealt) == {(str(own), "REPARTITION_BY_NUM")}


def test_kept_tasks(spark, monkeypatch):
    n, own = partitions.ROWS_PER_TASK, int(spark.conf.get("spark.sql.shuffle.partitions"))
    few = partitions.AQE_TASKS
    assert [partitions.kept_tasks(spark, r) for r in (0, n, n * few, n * few + 1, n * own, n * own + 1)] == [0, 0, 0, own, own, own + 1]
    spark.conf.set("spark.sql.shuffle.partitions", "2000")
    try:
        assert [partitions.kept_tasks(spark, n * k) for k in (few, 10, 600, 3000)] == [0, 10 * partitions.SPARE, 2000, 3000]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", str(own))


def test_a_changed_table_keeps_its_size(spark, sources, monkeypatch):
    monkeypatch.setattr(partitions, "ROWS_PER_TASK", A_TASK)
    t = star_schema_tables(spark, sources)
    changed = t.replace(teaches=t.get("teaches").filter("class_id > 3"))
    assert changed.tasks("teaches") == t.tasks("teaches") == LINES // A_TASK
    assert "teaches" in t.dealt and "teaches" not in changed.dealt
