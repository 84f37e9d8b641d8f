"""Change jobs on the seed: cascades, restricts, set-null, links, inserts, updates, invariants."""

import datetime as dt

from pyspark.sql import functions as F

from roster.operators import cascade, changes, linking, quality


def _keys(spark, *ids, col="id", typ="long"):
    return spark.createDataFrame([(i,) for i in ids], f"{col} {typ}")


def _rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_delete_student_person(seed, spark):
    res = cascade.delete_cascade(seed, "person", _keys(spark, 1))
    ch = res.changed
    assert 1 not in {r.person_id for r in ch["student"].collect()}
    assert _rows(ch["enrollment"].filter(F.col("student_id") == 1), "student_id") == []
    assert ch["enrollment"].count() == 5
    assert ch["student_plan"].count() == 4 and ch["guardianship"].count() == 4
    assert res.rejected.count() == 0 and res.deleted.count() == 1


def test_delete_instructor_person_reaches_guardian_role(seed, spark):
    ch = cascade.delete_cascade(seed, "person", _keys(spark, 6)).changed
    assert ch["instructor"].count() == 4 and ch["guardian"].count() == 4
    assert (6, 1) not in _rows(ch["teaches"], "instructor_id", "class_id")
    assert (1, 6) not in _rows(ch["qualified"], "sport_id", "instructor_id")
    assert (1, 6) not in _rows(ch["guardianship"], "student_id", "guardian_id")


def test_delete_class(seed, spark):
    ch = cascade.delete_cascade(seed, "class_group", _keys(spark, 3)).changed
    assert ch["session"].filter(F.col("class_id") == 3).count() == 0
    assert _rows(ch["enrollment"].filter(F.col("class_id") == 3), "id") == []
    assert ch["enrollment"].count() == 5 and ch["teaches"].count() == 4


def test_restrict_sport_and_schedule(seed, spark):
    res = cascade.delete_cascade(seed, "sport", _keys(spark, 1, typ="int"))
    assert [(r.id, r.blocked_by) for r in res.rejected.collect()] == [(1, "class_group")]
    assert res.changed["sport"].count() == 5 and res.changed["qualified"].count() == 5
    res = cascade.delete_cascade(seed, "schedule", _keys(spark, 1, 5, typ="int"))
    assert res.rejected.count() == 2
    res = cascade.delete_cascade(seed, "time_slot", _keys(spark, 1, typ="int"))
    assert _rows(res.changed["schedule_slot"], "id") == [(2,), (3,), (4,), (5,)]


def test_restrict_phone_and_set_null(seed, spark):
    res = cascade.delete_cascade(seed, "phone", _keys(spark, 1))
    assert sorted(r.blocked_by for r in res.rejected.collect()) == ["person"]
    assert res.changed["phone"].count() == 5
    res = cascade.delete_cascade(seed, "address", _keys(spark, 2, typ="int"))
    nulled = {r.id for r in res.changed["person"].filter(F.col("address_id").isNull()).collect()}
    assert nulled == {2, 6, 10} and res.changed["person"].count() == 10
    res = cascade.delete_cascade(seed, "invoice_status", _keys(spark, 1, typ="int"))
    inv = res.changed["invoice"]
    assert {r.id for r in inv.filter(F.col("status_id").isNull()).collect()} == {1, 3, 5}
    t2 = res.tables
    from roster.operators import reports
    assert {r.status for r in reports.invoice_summary(t2).collect()} == {"Pendente", "Atrasada"}


def test_cascade_invariants(seed, spark):
    once = cascade.delete_cascade(seed, "person", _keys(spark, 1, 6))
    twice = cascade.delete_cascade(once.tables, "person", _keys(spark, 1, 6))
    for name, df in once.changed.items():
        assert _rows(df, *df.columns) == _rows(twice.tables.get(name), *df.columns), name
    report = {(r.rule, r.table_name, r.column_name): r.n_bad for r in quality.check_references(once.tables).collect()}
    assert all(v == 0 for v in report.values())


def test_link_outcomes(seed, spark):
    pairs = spark.createDataFrame([(6, 1), (6, 2), (6, 2), (99, 1), (7, 99)], "a long, b long")
    res = linking.link(seed, "teaches", pairs)
    got = _rows(res.outcomes, "instructor_id", "class_id", "outcome")
    assert got == [(6, 1, "exists"), (6, 2, "added"), (7, 99, "unknown_b"), (99, 1, "unknown_a")]
    assert res.table.count() == 6


def test_link_enrollment_allows_duplicates_and_numbers_them(seed, spark):
    pairs = spark.createDataFrame([(1, 1), (1, 1), (3, 5)], "a long, b long")
    res = linking.link(seed, "enrollment", pairs)
    assert _rows(res.outcomes, "id", "student_id", "class_id") == [(8, 1, 1), (9, 1, 1), (10, 3, 5)]
    assert res.table.count() == 10


def test_insert_people_defaults_and_rejects(seed, spark):
    batch = spark.createDataFrame(
        [("Nova Aluna", None, None, None, None, None), ("   ", None, None, None, None, None),
         ("Outro", "1", "o@x", dt.date(2001, 1, 1), dt.date(2024, 2, 2), "Asma")],
        "name string, tax_id string, email string, born_on date, enrolled_on date, health_note string")
    res = changes.insert_people(seed, "student", batch, run_date="2024-03-01")
    ins = {r.name: r for r in res.inserted.collect()}
    assert set(ins) == {"Nova Aluna", "Outro"}
    assert ins["Nova Aluna"].health_note == "Apto" and ins["Nova Aluna"].enrolled_on == dt.date(2024, 3, 1)
    assert ins["Outro"].health_note == "Asma"
    assert sorted(r.id for r in ins.values()) == [11, 12]
    assert res.rejected.count() == 1
    t = res.tables
    assert t.get("person").count() == 12 and t.get("student").count() == 7
    # insert then delete gives the original tables back
    back = cascade.delete_cascade(t, "person", res.inserted.select("id")).tables
    for name in ("person", "student"):
        assert _rows(back.get(name), *seed.get(name).columns) == _rows(seed.get(name), *seed.get(name).columns)


def test_insert_classes_checks_form_rules(seed, spark):
    batch = spark.createDataFrame([("A", 10, 1, 1), ("B", 0, 1, 1), ("C", 5, 9, 1), ("D", 5, 1, 9), ("", 5, 1, 1)],
                                  "name string, capacity int, sport_id int, schedule_id int")
    res = changes.insert_classes(seed, batch)
    assert _rows(res.inserted, "id", "name") == [(6, "A")]
    assert _rows(res.rejected, "name", "reason") == [("", "blank_name"), ("B", "capacity_below_1"),
                                                     ("C", "unknown_sport"), ("D", "unknown_schedule")]


def test_updates(seed, spark):
    ch = spark.createDataFrame([(2, "Futebol Society", None, True), (42, "x", None, False)],
                               "id int, name string, description string, is_team boolean")
    sp = {r.id: r for r in changes.update_sports(seed, ch).get("sport").collect()}
    assert sp[2].name == "Futebol Society" and sp[2].description is None and len(sp) == 5
    pc = spark.createDataFrame([(3, "Joao P.", None, "j@x", None, dt.date(2024, 1, 1), "Apto")],
                               "id long, name string, tax_id string, email string, born_on date, "
                               "enrolled_on date, health_note string")
    t = changes.update_people(seed, "student", pc)
    p = {r.id: r for r in t.get("person").collect()}
    s = {r.person_id: r for r in t.get("student").collect()}
    assert p[3].name == "Joao P." and p[3].tax_id is None and p[1].name == "Carlos Silva"
    assert s[3].health_note == "Apto" and s[3].enrolled_on == dt.date(2024, 1, 1)


def test_validation_flags_bad_rows(spark):
    from roster.sources.seed import tables_from_rows
    from tests.seed_rows import SEED
    rows = dict(SEED)
    rows["class_group"] = SEED["class_group"] + [(5, "Dup", 0, 1, 77)]
    rows["person"] = SEED["person"] + [(11, " ", None, None, dt.date(1800, 1, 1), None, None)]
    t = tables_from_rows(spark, rows)
    rep = {(r.rule, r.table_name, r.column_name): r.n_bad for r in quality.validate(t).collect()}
    assert rep[("pk_duplicate", "class_group", "id")] == 1
    assert rep[("fk_orphan", "class_group", "sport_id")] == 1
    assert rep[("capacity_below_1", "class_group", "capacity")] == 1
    assert rep[("blank_name", "person", "name")] == 1
    assert rep[("date_out_of_range", "person", "born_on")] == 1
    assert rep[("pk_duplicate", "person", "id")] == 0


def test_pinned_and_unpinned_deletes_agree(seed, spark):
    keys = _keys(spark, 1, 6, 9)
    pinned = cascade.change_report(cascade.delete_cascade(seed, "person", keys, materialize=True))
    plain = cascade.change_report(cascade.delete_cascade(seed, "person", keys, materialize=False))
    assert _rows(pinned, "item", "n") == _rows(plain, "item", "n")
    rep = dict(_rows(plain, "item", "n"))
    assert rep["person"] == 7 and rep["guardianship"] == 3 and rep["keys_deleted"] == 3   # (1,6) and (4,9) go
