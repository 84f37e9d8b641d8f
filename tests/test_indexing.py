"""Distributed dense ids against a brute-force numbering."""

from pyspark.sql import functions as F

from roster.plans.indexing import dense_index


def _brute(rows, key):
    return {r: i + 1 for i, r in enumerate(sorted(rows, key=key))}


def test_dense_and_ordered(spark):
    rows = [(i % 37, (i * 7919) % 1000, i) for i in range(5000)]
    df = spark.createDataFrame(rows, "a int, b int, c int")
    out = dense_index(df, ["a", "b", "c"], num_partitions=7).collect()
    got = {(r.a, r.b, r.c): r.id for r in out}
    assert got == _brute(rows, lambda r: r)


def test_hot_key_and_partition_counts_agree(spark):
    # a third of the rows share one key; the tie-break lets the range partitioner split them
    rows = [(0 if i % 3 == 0 else i, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k int, u int")
    a = {(r.k, r.u): r.id for r in dense_index(df, ["k"], tiebreak=["u"], num_partitions=1).collect()}
    b = {(r.k, r.u): r.id for r in dense_index(df, ["k"], tiebreak=["u"], num_partitions=8).collect()}
    assert a == b == _brute(rows, lambda r: r)


def test_start_column_and_nulls_last(spark):
    df = spark.createDataFrame([(None,), (2,), (1,)], "x int")
    out = dense_index(df, ["x"], start=F.lit(10)).collect()
    assert {r.x: r.id for r in out} == {1: 10, 2: 11, None: 12}


def test_repeated_evaluation_is_consistent(spark):
    df = spark.range(20000).select((F.col("id") % 101).alias("k"), F.col("id").alias("v"))
    ix = dense_index(df, ["k", "v"])
    j = ix.alias("x").join(ix.alias("y"), "id")
    assert j.filter(F.col("x.v") != F.col("y.v")).count() == 0
    assert ix.agg(F.countDistinct("id"), F.max("id")).first() == (20000, 20000)


def test_allocated_ids_with_a_hot_tie(spark):
    from roster.operators.ids import allocate_ids
    batch = spark.range(6000).selectExpr("if(id % 3 = 0, 1, id) AS a", "if(id % 3 = 0, 1, 2) AS b")
    out = allocate_ids(spark.createDataFrame([(10,)], "id long"), batch, ["a", "b"])
    assert sorted(r.id for r in out.collect()) == list(range(11, 6011)) and out.columns == ["a", "b", "id"]
    pairs = [(r.a, r.b) for r in out.orderBy("id").collect()]
    assert pairs == sorted(pairs)
