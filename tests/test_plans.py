"""Physical-plan properties that matter at scale, read from ``explain`` output."""

import contextlib
import io

import pytest

import __spark_entry__ as entry
from tests.conftest import SF0001


def _plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_no_cross_products(spark, name):
    plan = _plan(entry.queries()[name](spark, SF0001))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_occupancy_prunes_and_pre_aggregates(spark):
    plan = _plan(entry.queries()["occupancy"](spark, SF0001))
    assert "partial_count" in plan                                    # map-side combine before the shuffle
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint>" in plan   # only two lineitem columns
    assert "monotonically_increasing_id" not in plan                  # enrolment ids are not built


def test_lookup_by_list_pushes_filter(spark, star001):
    from roster.operators import rosters
    plan = _plan(rosters.lookup_class(star001, [7, 9]))
    assert "PushedFilters: [In(p_partkey, [7,9])" in plan or "In(p_partkey" in plan


def test_dimension_broadcast_only_after_check(spark, star001):
    from roster.plans.broadcast import bounded
    small = star001.get("billing_period", "id", "name").withColumnRenamed("id", "period_id")
    facts = star001.get("plan", "id", "period_id")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")   # only the checked hint may broadcast
    try:
        assert "BroadcastHashJoin" in _plan(facts.join(bounded(small, 1000), "period_id"))
        assert "BroadcastHashJoin" not in _plan(facts.join(bounded(small, 3), "period_id"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
