"""Expected values at sf0.01 from the fixture notes (computed there in Spark and DuckDB with plain SQL written
only for that check), reproduced here through the library jobs with the same change batches."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from roster.operators import cascade, changelog, counts, linking, reports
from roster.sources.adapter import star_schema_tables
from tests.conftest import SF001


@pytest.fixture(scope="module")
def t(spark):
    return star_schema_tables(spark, SF001)


def _report(res):
    return {r.item: r.n for r in cascade.change_report(res).collect()}


def test_reports(t):
    assert tuple(reports.kpi(t).first()) == (1500, 100, 2000, 25, 60000, 9962, 2000, 51183)
    assert reports.occupancy(t).count() == 1877
    inv = {r.status: (r.invoices, r.total) for r in reports.invoice_summary(t).collect()}
    assert inv == {"Paga": (4888, Decimal("1221400164.80")), "Pendente": (4931, Decimal("1241306164.43")),
                   "Atrasada": (5031, Decimal("1259901444.71"))}
    plans = {r.period_id: (r.plans, r.total) for r in reports.plan_revenue(t).collect()}
    assert plans == {1: (389, Decimal("369869.30")), 2: (379, Decimal("361118.40")), 3: (393, Decimal("373267.90")),
                     4: (415, Decimal("393468.80")), 5: (374, Decimal("354775.60"))}
    seats = sorted((r.category, r.seats) for r in reports.seats_by_category(t).collect())
    assert seats == [("Coletivo", 15225), ("Individual", 16217), ("Individual", 16583)]
    nxt = {r.table_name: r.next_id for r in counts.next_ids(t).collect()}
    assert nxt["person"] == 2999


def test_deletes(t):
    person = t.get("person", "id", "address_id")
    rep = _report(cascade.delete_cascade(t, "person", person.filter(F.col("address_id") == 3)))
    assert rep == {"person": 1530, "student": 1433, "instructor": 97, "guardian": 97, "enrollment": 57268,
                   "student_plan": 8183, "guardianship": 7705, "teaches": 50168, "qualified": 2425,
                   "keys_deleted": 70, "keys_rejected": 0}
    rep = _report(cascade.delete_cascade(t, "class_group", t.get("class_group", "id").filter(F.col("id") % 7 == 0)))
    assert (rep["class_group"], rep["session"], rep["enrollment"], rep["teaches"]) == (1714, 8550, 51385, 44316)
    rep = _report(cascade.delete_cascade(t, "sport", t.get("sport", "id")))
    assert (rep["keys_rejected"], rep["keys_deleted"], rep["qualified"]) == (24, 1, 2400)
    rep = _report(cascade.delete_cascade(t, "phone", t.get("phone", "id")))
    assert (rep["keys_rejected"], rep["keys_deleted"]) == (1350, 150)
    rep = _report(cascade.delete_cascade(t, "address", t.get("address", "id").filter(F.col("id") % 5 == 0)))
    assert (rep["person"], rep["person.address_id"]) == (1600, 1301)
    rep = _report(cascade.delete_cascade(t, "billing_period", t.get("billing_period", "id").filter(F.col("id") == 2)))
    assert (rep["plan"], rep["plan.period_id"]) == (2000, 1571)
    rep = _report(cascade.delete_cascade(t, "invoice_status", t.get("invoice_status", "id").filter(F.col("id") == 3)))
    assert (rep["invoice"], rep["invoice.status_id"]) == (15000, 9819)
    rep = _report(cascade.delete_cascade(t, "plan", t.get("plan", "id").filter(F.col("id") % 7 == 0)))
    assert rep["student_plan"] == 7335
    rep = _report(cascade.delete_cascade(t, "time_slot", t.get("time_slot", "id").filter(F.col("id") == 3)))
    assert rep["schedule_slot"] == 28


def test_links_and_log(t):
    pairs = t.get("enrollment", "student_id", "class_id").filter(F.col("class_id") % 100 == 0).distinct()
    left = linking.unlink(t, "enrollment", pairs).table
    assert tuple(left.agg(F.count(F.lit(1)), F.sum("id")).first()) == (59401, 1782255309)
    idx = linking.resolve_labels(t, "enrollment")
    assert tuple(idx.agg(F.count(F.lit(1)), F.sum("a"), F.sum("b")).first()) == (43176, 64918430, 47982959)
    state = changelog.apply_changes(None, t.source("events"), "user_id", ["ts", "event_id"], "event_type", ["error"],
                                    ["event_id"])
    assert tuple(state.agg(F.count(F.lit(1)), F.sum("event_id")).first()) == (120, 1183126)
