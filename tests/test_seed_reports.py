"""Golden results on the seed tables, derived by hand from the seed rows."""


from roster.operators import counts, links, reports, rosters


def test_kpi(seed):
    row = reports.kpi(seed).collect()[0].asDict()
    assert row == {"students": 5, "instructors": 5, "classes": 5, "sports": 5, "enrollments": 7,
                   "open_invoices": 2, "plans": 5, "seats": 81}


def test_occupancy(seed):
    got = {r.class_id: r.enrolled for r in reports.occupancy(seed).collect()}
    assert got == {1: 1, 2: 2, 3: 2, 4: 1, 5: 1}
    first = reports.occupancy(seed).first()
    assert first.enrolled == 2 and first.class_id == 2   # most enrolled first, id breaks the tie


def test_invoice_summary(seed):
    rows = [(r.status, r.invoices, r.total_brl) for r in reports.invoice_summary(seed).collect()]
    assert rows == [("Paga", 3, "R$ 1.270,00"), ("Atrasada", 1, "R$ 150,00"), ("Pendente", 1, "R$ 100,00")]


def test_plan_revenue(seed):
    rows = [(r.period, r.plans, r.total_brl) for r in reports.plan_revenue(seed).collect()]
    assert rows == [("Anual", 1, "R$ 900,00"), ("Semestral", 1, "R$ 500,00"), ("Trimestral", 1, "R$ 270,00"),
                    ("Mensal", 2, "R$ 250,00")]


def test_seats_by_category(seed):
    rows = [(r.category, r.seats) for r in reports.seats_by_category(seed).collect()]
    assert rows == [("Coletivo", 56), ("Individual", 25)]


def test_instructor_load(seed):
    rows = reports.instructor_load(seed).collect()
    assert sorted((r.instructor_id, r.classes) for r in rows) == [(i, 1) for i in range(6, 11)]


def test_rosters_and_labels(seed):
    s = rosters.student_roster(seed).collect()
    assert [r.id for r in s] == [1, 2, 3, 4, 5]
    assert s[0].born_on == "10/05/2010" and s[0].enrolled_on == "10/01/2023"
    lab = rosters.labels(seed, "student").collect()
    assert lab[0].label == "4 - Ana Clara"     # ordered by name
    assert rosters.labels(seed, "class_group").first().label == "4 - Bas-Iniciante-M"
    sp = {r.id: r.category for r in rosters.sport_roster(seed).collect()}
    assert sp == {1: "Individual", 2: "Coletivo", 3: "Coletivo", 4: "Coletivo", 5: "Individual"}


def test_lookups_by_list_and_by_frame(seed, spark):
    one = rosters.lookup_student(seed, [3]).collect()
    assert len(one) == 1 and one[0].health_note == "Asma leve"
    keys = spark.createDataFrame([(6,), (6,), (99,)], "k long")
    got = rosters.lookup_instructor(seed, keys).collect()
    assert [r.id for r in got] == [6]   # duplicate requests do not multiply, unknown ids vanish
    cls = rosters.lookup_class(seed, [2]).first()
    assert (cls.capacity, cls.sport_id, cls.schedule_id) == (22, 2, 4)


def test_links(seed):
    e = links.links(seed, "enrollment").collect()
    assert len(e) == 7
    assert e[0].label == "Ana Clara na turma Bas-Iniciante-M"
    g = links.links(seed, "guardianship").first()
    assert g.label == "Ana Clara tem responsavel Marcos Paulo"
    q = links.links(seed, "qualified").collect()
    assert {r.label for r in q} >= {"Fernanda Lima apto em Natacao"}


def test_counts_and_next_ids(seed):
    c = {r.table_name: r.row_count for r in counts.table_counts(seed).collect()}
    assert sum(c.values()) == 122
    assert c["enrollment"] == 7 and c["person"] == 10
    n = {r.table_name: r.next_id for r in counts.next_ids(seed).collect()}
    assert n["person"] == 11 and n["enrollment"] == 8


def test_parameterised_lookups(seed):
    row = rosters.lookup_one(seed, "student", 3).collect()
    assert len(row) == 1 and row[0].health_note == "Asma leve"
    assert rosters.lookup_one(seed, "sport", 2).first().name == "Futebol"
    assert rosters.lookup_one(seed, "instructor", 99).count() == 0
