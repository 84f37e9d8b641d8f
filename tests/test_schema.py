from roster import schema


def test_table_and_key_counts():
    assert len(schema.TABLE_NAMES) == 23
    assert len(schema.FOREIGN_KEYS) == 22
    kinds = {}
    for fk in schema.FOREIGN_KEYS:
        kinds[fk.on_delete] = kinds.get(fk.on_delete, 0) + 1
    assert kinds == {schema.CASCADE: 16, schema.RESTRICT: 2, schema.NO_ACTION: 1, schema.SET_NULL: 3}


def test_every_fk_points_at_a_key_column():
    for fk in schema.FOREIGN_KEYS:
        assert fk.column in schema.table(fk.child).columns
        assert (fk.parent_column,) == schema.table(fk.parent).primary_key


def test_graph_facts():
    schema.check_graph_invariants()
    assert schema.blocking_parents() == {"sport", "schedule", "phone"}
    closure = schema.cascade_closure("person")
    assert closure[0] == "person"
    assert set(closure) == {"person", "student", "instructor", "guardian", "enrollment", "student_plan",
                            "guardianship", "teaches", "qualified"}
    # guardianship comes after both of its cascading parents
    assert closure.index("guardianship") > max(closure.index("student"), closure.index("guardian"))
    set_null = {(fk.parent, fk.child) for fk in schema.FOREIGN_KEYS if fk.on_delete == schema.SET_NULL}
    assert set_null == {("address", "person"), ("billing_period", "plan"), ("invoice_status", "invoice")}


def test_unlinked_tables_have_no_keys_pointing_anywhere():
    for name in ("attendance", "cancellation", "invoice"):
        assert all(fk.parent != "student" for fk in schema.parents_of(name))
    assert schema.parents_of("attendance") == [] and schema.parents_of("cancellation") == []
