"""Table registry: Spark schemas, primary keys and foreign keys of the 23-table class-management model.

Everything here is metadata. Spark does not enforce keys on file tables, so the rules are applied by the
change jobs (``operators.cascade``, ``operators.linking``) and checked by ``operators.quality``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

CASCADE = "CASCADE"
RESTRICT = "RESTRICT"
NO_ACTION = "NO ACTION"
SET_NULL = "SET NULL"

# Rules under which a parent row may not be deleted while a child still points at it.
BLOCKING = (RESTRICT, NO_ACTION)


@dataclass(frozen=True)
class ForeignKey:
    child: str
    column: str
    parent: str
    parent_column: str
    on_delete: str


@dataclass(frozen=True)
class Table:
    name: str
    schema: T.StructType
    primary_key: tuple[str, ...]
    # Declared text widths (the reference stores text as VARCHAR(n)); checked by the quality job.
    max_lengths: dict[str, int] = field(default_factory=dict)
    # Column holding the display name, when the table has one.
    name_column: str | None = None

    @property
    def columns(self) -> list[str]:
        return [f.name for f in self.schema.fields]


def _struct(*cols: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in cols])


L, I, S, D, B = T.LongType(), T.IntegerType(), T.StringType(), T.DateType(), T.BooleanType()
MONEY = T.DecimalType(18, 2)

# The column widths declared by the reference schema, per table and column.
_TABLES = [
    Table("phone", _struct(("id", L), ("phone", S)), ("id",), {"phone": 20}),
    Table("address", _struct(("id", I), ("street", S), ("district", S), ("city", S), ("complement", S)), ("id",),
          {"street": 150, "district": 80, "city": 80, "complement": 80}),
    Table("billing_period", _struct(("id", I), ("name", S), ("days", I)), ("id",), {"name": 40}, "name"),
    Table("invoice_status", _struct(("id", I), ("name", S)), ("id",), {"name": 40}, "name"),
    Table("sport", _struct(("id", I), ("name", S), ("description", S), ("is_team", B)), ("id",),
          {"name": 60, "description": 255}, "name"),
    Table("schedule", _struct(("id", I), ("name", S)), ("id",), {"name": 60}, "name"),
    Table("time_slot", _struct(("id", I), ("starts_at", S), ("ends_at", S)), ("id",)),
    Table("person", _struct(("id", L), ("name", S), ("tax_id", S), ("email", S), ("born_on", D),
                            ("phone_id", L), ("address_id", I)), ("id",),
          {"name": 120, "tax_id": 20, "email": 120}, "name"),
    Table("guardian", _struct(("person_id", L)), ("person_id",)),
    Table("instructor", _struct(("person_id", L)), ("person_id",)),
    Table("student", _struct(("person_id", L), ("enrolled_on", D), ("health_note", S)), ("person_id",),
          {"health_note": 120}),
    Table("class_group", _struct(("id", L), ("name", S), ("capacity", I), ("schedule_id", I), ("sport_id", I)),
          ("id",), {"name": 80}, "name"),
    Table("session", _struct(("id", L), ("held_on", D), ("was_held", B), ("class_id", L)), ("id",)),
    Table("enrollment", _struct(("id", L), ("student_id", L), ("class_id", L)), ("id",)),
    Table("attendance", _struct(("id", L), ("present", B)), ("id",)),
    Table("plan", _struct(("id", L), ("name", S), ("amount", MONEY), ("period_id", I), ("description", S)), ("id",),
          {"name": 80, "description": 255}, "name"),
    Table("invoice", _struct(("id", L), ("amount", MONEY), ("due_on", D), ("paid_on", D), ("status_id", I),
                             ("pay_method", S)), ("id",), {"pay_method": 40}),
    Table("schedule_slot", _struct(("id", I), ("weekday", I), ("slot_id", I), ("schedule_id", I)), ("id",)),
    Table("student_plan", _struct(("student_id", L), ("plan_id", L)), ("student_id", "plan_id")),
    Table("cancellation", _struct(("id", L), ("reason", S)), ("id",), {"reason": 255}),
    Table("guardianship", _struct(("student_id", L), ("guardian_id", L)), ("student_id", "guardian_id")),
    Table("teaches", _struct(("instructor_id", L), ("class_id", L)), ("instructor_id", "class_id")),
    Table("qualified", _struct(("sport_id", I), ("instructor_id", L)), ("sport_id", "instructor_id")),
]

TABLES: dict[str, Table] = {t.name: t for t in _TABLES}
TABLE_NAMES: list[str] = [t.name for t in _TABLES]

# The 22 foreign keys and their delete rules, as declared by the reference schema.
FOREIGN_KEYS: list[ForeignKey] = [
    ForeignKey("person", "phone_id", "phone", "id", NO_ACTION),
    ForeignKey("person", "address_id", "address", "id", SET_NULL),
    ForeignKey("guardian", "person_id", "person", "id", CASCADE),
    ForeignKey("instructor", "person_id", "person", "id", CASCADE),
    ForeignKey("student", "person_id", "person", "id", CASCADE),
    ForeignKey("class_group", "schedule_id", "schedule", "id", RESTRICT),
    ForeignKey("class_group", "sport_id", "sport", "id", RESTRICT),
    ForeignKey("session", "class_id", "class_group", "id", CASCADE),
    ForeignKey("enrollment", "student_id", "student", "person_id", CASCADE),
    ForeignKey("enrollment", "class_id", "class_group", "id", CASCADE),
    ForeignKey("plan", "period_id", "billing_period", "id", SET_NULL),
    ForeignKey("invoice", "status_id", "invoice_status", "id", SET_NULL),
    ForeignKey("schedule_slot", "slot_id", "time_slot", "id", CASCADE),
    ForeignKey("schedule_slot", "schedule_id", "schedule", "id", CASCADE),
    ForeignKey("student_plan", "student_id", "student", "person_id", CASCADE),
    ForeignKey("student_plan", "plan_id", "plan", "id", CASCADE),
    ForeignKey("guardianship", "student_id", "student", "person_id", CASCADE),
    ForeignKey("guardianship", "guardian_id", "guardian", "person_id", CASCADE),
    ForeignKey("teaches", "instructor_id", "instructor", "person_id", CASCADE),
    ForeignKey("teaches", "class_id", "class_group", "id", CASCADE),
    ForeignKey("qualified", "sport_id", "sport", "id", CASCADE),
    ForeignKey("qualified", "instructor_id", "instructor", "person_id", CASCADE),
]

# Tables whose id the reference generates itself (AUTO_INCREMENT); the others get max(id) + 1 from the app.
AUTO_INCREMENT = ("session", "enrollment", "attendance", "schedule_slot")


def table(name: str) -> Table:
    try:
        return TABLES[name]
    except KeyError:
        raise KeyError(f"unknown table {name!r}; known: {', '.join(TABLE_NAMES)}") from None


def children_of(parent: str) -> list[ForeignKey]:
    return [fk for fk in FOREIGN_KEYS if fk.parent == parent]


def parents_of(child: str) -> list[ForeignKey]:
    return [fk for fk in FOREIGN_KEYS if fk.child == child]


def cascade_closure(root: str) -> list[str]:
    """Tables reached from ``root`` over CASCADE edges, root first, each after all of its reached parents."""
    reached = {root}
    frontier = [root]
    while frontier:
        nxt = []
        for parent in frontier:
            for fk in children_of(parent):
                if fk.on_delete == CASCADE and fk.child not in reached:
                    reached.add(fk.child)
                    nxt.append(fk.child)
        frontier = nxt
    order: list[str] = []
    pending = set(reached)
    while pending:
        ready = sorted(t for t in pending
                       if all(fk.parent not in pending or fk.parent == t
                              for fk in parents_of(t) if fk.on_delete == CASCADE))
        if not ready:
            raise ValueError(f"cycle among cascade edges from {root}")
        order.extend(ready)
        pending.difference_update(ready)
    order.remove(root)
    return [root] + order


def blocking_parents() -> set[str]:
    return {fk.parent for fk in FOREIGN_KEYS if fk.on_delete in BLOCKING}


def check_graph_invariants() -> None:
    """The cascade job decides rejections at the root key only. That is exact as long as no cascade path
    reaches a table which itself has a blocking child; assert it so a schema change cannot break it silently."""
    blockers = blocking_parents()
    for name in TABLE_NAMES:
        for t in cascade_closure(name)[1:]:
            if t in blockers:
                raise AssertionError(f"cascade from {name} reaches {t}, which has RESTRICT/NO ACTION children")
