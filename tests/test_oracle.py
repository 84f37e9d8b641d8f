"""Every registered query against its DuckDB oracle on the sf0.001 tables (order-insensitive)."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import SF0001
from tools.check_oracle import RAW, rows_of

ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in RAW:
        p = f"{SF0001}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"create view {t} as select * from read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_matches_oracle(spark, con, name):
    df = entry.queries()[name](spark, SF0001)
    rows = [tuple(r) for r in df.collect()]
    if name not in ORACLES:
        assert len(rows) >= 0
        return
    cur = con.execute(ORACLES[name])
    o_cols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(o_cols)
    assert rows_of(df.columns, rows) == rows_of(o_cols, cur.fetchall())


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["class_id", "class_name", "sport_name", "capacity", "enrolled"]
    assert df.count() > 0


@pytest.mark.parametrize("name", ["unlink_one", "link_label_index", "link_enrollment", "occupancy", "cascade_person"])
def test_same_result_for_one_and_eight_partitions(spark, con, name):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        results = []
        for n in ("1", "8"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            df = entry.queries()[name](spark, SF0001)
            results.append(rows_of(df.columns, [tuple(r) for r in df.collect()]))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert results[0] == results[1]
