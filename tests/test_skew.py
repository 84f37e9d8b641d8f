"""A class holding a third of all enrolments: results stay exact when AQE splits the hot partition."""

import contextlib
import io
from collections import Counter

import pytest

from roster.operators import linking, links, reports
from roster.sources.seed import tables_from_rows
from tests.seed_rows import SEED

HOT_CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",               # force shuffle joins
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


@pytest.fixture()
def hot(spark):
    old = {k: spark.conf.get(k, None) for k in HOT_CONF}
    for k, v in HOT_CONF.items():
        spark.conf.set(k, v)
    rows = dict(SEED)
    # 30000 enrolments: every third one goes to class 1, the rest spread over the five classes
    pairs = [(1 + i % 5, 1 if i % 3 == 0 else 1 + i % 5) for i in range(30000)]
    rows["enrollment"] = [{"student_id": s, "class_id": c} for s, c in pairs]
    yield tables_from_rows(spark, rows), pairs
    for k, v in old.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


def test_hot_class_counts_and_links_are_exact(hot):
    t, pairs = hot
    want = Counter(c for _, c in pairs)
    got = {r.class_id: r.enrolled for r in reports.occupancy(t).collect()}
    assert got == dict(want)
    listed = links.links(t, "enrollment", ordered=False)
    assert Counter((r.a, r.b) for r in listed.collect()) == Counter(pairs)
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        listed.explain()                         # the executed (final) adaptive plan
    assert "SortMergeJoin(skew=true)" in buf.getvalue()   # the hot partition was split, results unchanged


def test_hot_pair_unlink_and_labels(hot, spark):
    t, pairs = hot
    req = spark.createDataFrame([(1, 1)], "student_id long, class_id long")
    left = linking.unlink(t, "enrollment", req).table
    assert left.count() == len(pairs) - 1
    idx = {r.label: (r.a, r.b) for r in linking.resolve_labels(t, "enrollment").collect()}
    assert len(idx) == len(set(pairs))
