"""Semantic traps: NULL flags, inner versus left joins, colliding labels, duplicates, NULL keys."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from roster.functions import text
from roster.operators import linking, reports, rosters
from roster.sources.seed import tables_from_rows
from tests.seed_rows import SEED


def _with(spark, **over):
    rows = dict(SEED)
    rows.update(over)
    return tables_from_rows(spark, rows)


def test_null_team_flag_stays_a_separate_row(spark):
    t = _with(spark, sport=SEED["sport"] + [(6, "Xadrez", None, None)],
              class_group=SEED["class_group"] + [(6, "Xad-M", 7, 1, 6)])
    rows = sorted((r.category, r.seats) for r in reports.seats_by_category(t).collect())
    assert rows == [("Coletivo", 56), ("Individual", 7), ("Individual", 25)]


def test_inner_versus_left(spark):
    t = _with(spark, class_group=SEED["class_group"] + [(6, "Sem-Esporte", 5, 1, None)],
              invoice=SEED["invoice"] + [(6, Decimal("10.00"), dt.date(2024, 1, 1), None, None, "PIX")])
    assert 6 not in {r.class_id for r in reports.occupancy(t).collect()}
    roster = {r.id: r.sport for r in rosters.class_roster(t).collect()}
    assert roster[6] is None
    assert sum(r.invoices for r in reports.invoice_summary(t).collect()) == 5


def test_duplicate_enrolments_count_twice_and_unlink_removes_one(spark):
    t = _with(spark, enrollment=SEED["enrollment"] + [{"student_id": 1, "class_id": 1}])
    occ = {r.class_id: r.enrolled for r in reports.occupancy(t).collect()}
    assert occ[1] == 2
    pairs = spark.createDataFrame([(1, 1)], "student_id long, class_id long")
    left = linking.unlink(t, "enrollment", pairs).table
    ids = sorted(r.id for r in left.filter((F.col("student_id") == 1) & (F.col("class_id") == 1)).collect())
    assert ids == [8]      # the smallest id (1) went first


def test_colliding_link_labels_last_wins(spark):
    people = SEED["person"] + [(11, "Ana Clara", None, None, None, None, None)]
    t = _with(spark, person=people, student=SEED["student"] + [(11, None, "Apto")],
              enrollment=SEED["enrollment"] + [{"student_id": 11, "class_id": 4}])
    idx = {r.label: (r.a, r.b) for r in linking.resolve_labels(t, "enrollment").collect()}
    assert idx["Ana Clara na turma Bas-Iniciante-M"] == (11, 4)


def test_money_text(spark):
    df = spark.createDataFrame([(1270.0,), (0.135,), (-1270.5,), (None,)], "v double")
    got = [r.t for r in df.select(text.brl("v").alias("t")).collect()]
    assert got == ["R$ 1.270,00", "R$ 0,14", "R$ -1.270,50", ""]


def test_labels_null_name_is_null(spark):
    t = _with(spark, sport=SEED["sport"] + [(6, None, None, True)])
    lab = {r.id: r.label for r in rosters.labels(t, "sport").collect()}
    assert lab[6] is None and lab[1] == "1 - Natacao"


def test_null_fk_never_matches_a_delete(spark):
    from roster.operators.cascade import delete_cascade
    t = _with(spark, person=SEED["person"] + [(11, "Sem Endereco", None, None, None, None, None)])
    keys = spark.createDataFrame([(2,)], "id int")
    res = delete_cascade(t, "address", keys)
    people = {r.id: r.address_id for r in res.changed["person"].collect()}
    assert people[11] is None and people[2] is None and people[1] == 1 and len(people) == 11


def test_collation_option_orders_case_and_accent_insensitively(spark):
    people = [(i, n, None, None, None, None, None) for i, n in [(1, "ana"), (2, "Bia"), (3, "Álvaro"), (4, "Ana")]]
    t = _with(spark, person=people, student=[(i, None, None) for i in range(1, 5)])
    binary = [r.id for r in rosters.labels(t, "student").collect()]
    folded = [r.id for r in rosters.labels(t, "student", collation="UNICODE_CI_AI").collect()]
    assert binary == [4, 2, 1, 3]          # 'A' < 'B' < 'a' < 'Á'
    assert folded == [3, 1, 4, 2]          # Álvaro, ana, Ana (ties by id), Bia
