"""Registered jobs over stored state: change logs over a base, ids after deletes, deltas of reports, checks of a batch,
deletes row by row, resumed loads, and sorted outputs with their positions.

As in ``registry_jobs`` the batches are derived from the given tables, and the oracles say in plain SQL what the tables hold
afterwards.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from roster import schema
from roster.functions import text
from roster.operators import batch_checks, cascade, changes, counts, linking, reports, rosters
from roster.operators.report_state import ReportState, delta
from roster.plans.ordering import collated, in_order
from roster.registry import QUERIES, Query, register
from roster.registry_jobs import domains_sql, keys_sql, refs_sql
from roster.sources import parquet
from roster.sources.bucketed import BucketedTable
from roster.sources.tables import Tables

# ---------------------------------------------------------------- W8 over a stored base

BUCKETS = 16
#: A person's id from an event's user, so that changes meet customers, suppliers and new people.
_PERSON_OF_EVENT = "user_id * 25"


def _person_changes(t: Tables):
    return t.source("events").selectExpr(
        f"{_PERSON_OF_EVENT} AS id", "ts", "event_id", "event_type", "concat('Change ', event_id) AS name", "CAST(NULL AS string) AS tax_id",
        "props AS email", "CAST(ts AS date) AS born_on", "CAST(NULL AS bigint) AS phone_id", "CAST(NULL AS int) AS address_id")


@register("changelog_over_person", f"""
with log as (
  select {_PERSON_OF_EVENT} as id, 'Change ' || event_id as name, cast(null as varchar) as tax_id, props as email, cast(ts as date) as born_on,
         cast(null as bigint) as phone_id, cast(null as int) as address_id, event_type,
         row_number() over (partition by user_id order by ts desc, event_id desc) as turn from events where user_id is not null)
select * exclude (event_type, turn) from log where turn = 1 and event_type is distinct from 'error'
union all
select id, name, tax_id, email, born_on, phone_id, address_id from person where id not in (select id from log)
""")
def changelog_over_person(t: Tables):
    """The person table in hash buckets, after the log in two batches."""
    stored = BucketedTable.create(t.get("person"), parquet.fresh_model_folder(t.spark), "id", BUCKETS)
    log = _person_changes(t).filter("id IS NOT NULL")
    early = F.dayofmonth("ts") <= 15
    stored.apply(log.filter(early), 0, ["ts", "event_id"], "event_type", ["error"])
    stored.apply(log.filter(~early), 1, ["ts", "event_id"], "event_type", ["error"])
    return stored.read()


# ---------------------------------------------------------------- W2 ids after deletes

@register("relink_after_unlink", """
with mark as (select max(id) as top from enrollment),
asked as (select student_id, class_id from enrollment where student_id >= (select max(student_id) - 20 from enrollment)),
left_over as (select id, student_id, class_id from enrollment where student_id < (select max(student_id) - 20 from enrollment))
from left_over union all
select top + row_number() over (order by student_id, class_id) as id, student_id, class_id from asked, mark
""")
def relink_after_unlink(t: Tables):
    """The last students leave all their classes, the latest enrolments among them, and come back: no id is used again."""
    pairs = t.get("enrollment", "student_id", "class_id")
    last = pairs.agg((F.max("student_id") - 20).alias("s")).scalar()
    asked = pairs.filter(F.col("student_id") >= last)
    gone = linking.unlink(t, "enrollment", asked).tables
    back = linking.link(gone, "enrollment", asked).tables
    return back.get("enrollment")


# ---------------------------------------------------------------- reports from deltas

# The change: classes of every tenth id lose their enrolments, students join the class numbered like their plan; every
# fourth class gets a seat, every seventh is copied under a new id, every fiftieth goes with its enrolments; open invoices of
# every third id are paid.
_AFTER = """
after_enrollment as (
  select student_id, class_id from enrollment where class_id % 10 <> 0 and class_id % 50 <> 0
  union all select student_id, plan_id from student_plan where plan_id % 50 <> 0),
after_class as (
  select id, name, capacity + (id % 4 = 0)::int as capacity, sport_id from class_group where id % 50 <> 0
  union all select id + 100000000, name, capacity, sport_id from class_group where id % 7 = 0),
after_invoice as (select id, case when id % 3 = 0 and status_id = 2 then 1 else status_id end as status_id, amount from invoice)"""


def _report_deltas(t: Tables):
    e = t.get("enrollment", "student_id", "class_id")
    p = t.get("student_plan").select("student_id", F.col("plan_id").alias("class_id"))
    c = t.get("class_group", "id", "name", "capacity", "sport_id")
    i = t.get("invoice", "id", "amount", "status_id")
    paid = i.filter((F.col("id") % 3 == 0) & (F.col("status_id") == 2))
    seat, kept = F.col("id") % 4 == 0, F.col("id") % 50 != 0
    return {
        "enrollment": delta(e.filter((F.col("class_id") % 10 == 0) | (F.col("class_id") % 50 == 0)), p.filter(F.col("class_id") % 50 != 0)),
        "class_group": delta(c.filter(seat | ~kept), c.filter(seat & kept).withColumn("capacity", F.col("capacity") + 1).unionByName(
            c.filter(F.col("id") % 7 == 0).withColumn("id", F.col("id") + 100000000))),
        "invoice": delta(paid, paid.withColumn("status_id", F.lit(1))),
    }


def _state_after(t: Tables) -> ReportState:
    before = ReportState.build(t, parquet.fresh_model_folder(t.spark))
    return before.fold(_report_deltas(t), parquet.fresh_model_folder(t.spark))


register("occupancy_after_changes", f"""
with {_AFTER.strip()}, taken as (select class_id, count(student_id) as n from after_enrollment group by class_id)
select c.id as class_id, c.name as class_name, sport.name as sport_name, capacity, coalesce(n, 0) as enrolled
from after_class c join sport on sport.id = sport_id left join taken on class_id = c.id
""")(lambda t: _state_after(t).occupancy(t))

_OPEN = ", ".join(f"'{s}'" for s in text.OPEN_STATUSES)
register("kpi_after_changes", f"""
with {_AFTER.strip()}
select (select count(*) from student) as students, (select count(*) from instructor) as instructors,
       (select count(*) from after_class) as classes, (select count(*) from sport) as sports,
       (select count(*) from after_enrollment) as enrollments,
       (select count(*) from after_invoice where status_id in (select id from invoice_status where name in ({_OPEN}))) as open_invoices,
       (select count(*) from plan) as plans, (select coalesce(sum(capacity), 0)::bigint from after_class) as seats
""")(lambda t: _state_after(t).kpi(t))

# ---------------------------------------------------------------- W9 for a batch

# Classes: every fifth gets no seat, every ninth a sport that isn't there, every thirteenth goes, and every eleventh is inserted
# again under its own id with a blank name. Teaching links: each that points to an even class is repeated or new one further on.
_CLASS_UPDATES = """select id, name, case when id % 5 = 0 then 0 else capacity end as capacity, schedule_id,
       case when id % 9 = 0 then 999 else sport_id end as sport_id from class_group where id % 5 = 0 or id % 9 = 0"""
_AFTER_CLASSES = f"""select id, name, capacity, schedule_id, sport_id from class_group where id % 13 <> 0 and id % 5 <> 0 and id % 9 <> 0
  union all select * from ({_CLASS_UPDATES}) where id % 13 <> 0
  union all select id, ' ', capacity, schedule_id, sport_id from class_group where id % 11 = 0"""


def _class_batches(t: Tables) -> dict[str, batch_checks.Batch]:
    c = t.get("class_group")
    updates = c.filter("id % 5 = 0 OR id % 9 = 0").withColumns({
        "capacity": F.when(F.col("id") % 5 == 0, 0).otherwise(F.col("capacity")),
        "sport_id": F.when(F.col("id") % 9 == 0, 999).otherwise(F.col("sport_id"))})
    links = t.get("teaches").filter("class_id % 2 = 0").select("instructor_id", (F.col("class_id") + 1).alias("class_id"))
    return {"class_group": batch_checks.Batch(inserts=c.filter("id % 11 = 0").withColumn("name", F.lit(" ")), updates=updates,
                                              deletes=c.select("id").filter("id % 13 = 0")),
            "teaches": batch_checks.Batch(inserts=links)}


def _batch_oracle() -> str:
    """All rules over the tables after the batch, less those over the tables before."""
    names = {"class_group": "after_class", "teaches": "after_teaches"}
    edges = [fk for fk in schema.FOREIGN_KEYS if fk.child in names or fk.parent in names]
    after, before = (" union all ".join([keys_sql(list(names), m), domains_sql(list(names), m), refs_sql(edges, m)]) for m in (names, {}))
    return f"""with after_class as ({_AFTER_CLASSES}),
after_teaches as (select instructor_id, class_id from teaches union all select instructor_id, class_id + 1 from teaches where class_id % 2 = 0),
after_counts as ({after}), before_counts as ({before})
select a.rule, a.table_name, a.column_name, a.n_bad - b.n_bad as n_bad from after_counts a join before_counts b using (rule, table_name, column_name)
"""


register("check_batch", _batch_oracle())(lambda t: batch_checks.check_batch(t, _class_batches(t)))

# ---------------------------------------------------------------- W4 row by row


def _explained_sql(root: str, keys: str) -> str:
    """All chains of references from the deleted keys, by recursion over every edge."""
    pk = schema.table(root).primary_key[0]
    blocking = [fk for fk in schema.children_of(root) if fk.on_delete in schema.BLOCKING]

    def key(name: str) -> str:
        return " || ':' || ".join(f"cast(c.{c} as varchar)" for c in schema.table(name).primary_key)

    reach = {fk for chain in (c for chains in cascade.cascade_paths(root).values() for c in chains) for fk in chain}
    edges = " union all ".join(
        f"select '{fk.parent}' as parent, cast(c.{fk.column} as varchar) as parent_key, '{fk.child}' as child, {key(fk.child)} as child_key, "
        f"'{fk.child}.{fk.column}' as edge, {str(fk.on_delete == schema.CASCADE).lower()} as cascades from {fk.child} c where c.{fk.column} is not null"
        for fk in schema.FOREIGN_KEYS if fk in reach)
    blocked = " union all ".join(f"select cast({fk.column} as varchar) as k, '{fk.child}' as blocker from {fk.child}" for fk in blocking) or \
        "select cast(null as varchar) as k, '' as blocker where false"
    return f"""with recursive asked as (select distinct cast({pk} as varchar) as k from {root} where {pk} in ({keys})),
blocked as ({blocked}), edges as ({edges or "select '' as parent, '' as parent_key, '' as child, '' as child_key, '' as edge, true as cascades where false"}),
reach as (
  select '{root}' as tab, k, '' as path, true as goes from asked where k not in (select k from blocked where k is not null)
  union
  select child, child_key, case when path = '' then edge else path || ' > ' || edge end, cascades
  from reach join edges on parent = tab and parent_key = k where goes)
select tab as table_name, k as row_key, if(goes, 'deleted', 'set null') as outcome, string_agg(distinct path, ', ' order by path) as paths
from reach group by tab, k, goes
union all
select '{root}', k, 'refused', (select string_agg(distinct blocker, ', ' order by blocker) from blocked b where b.k = asked.k)
from asked where k in (select k from blocked where k is not null)
"""


for _name, _root, _keys, _sql in (
        ("cascade_person_rows", "person", lambda t: t.get("person", "id", "address_id").filter("address_id = 3"), "select id from person where address_id = 3"),
        ("cascade_class_rows", "class_group", lambda t: t.get("class_group", "id", "capacity").filter("capacity < 3"),
         "select id from class_group where capacity < 3"),
        ("restrict_sport_rows", "sport", lambda t: t.get("sport", "id"), "select id from sport"),
        ("restrict_phone_rows", "phone", lambda t: t.get("phone", "id"), "select id from phone"),
        ("set_null_address_rows", "address", lambda t: t.get("address", "id", "district").filter("district = 'ASIA'"),
         "select id from address where district = 'ASIA'"),
        ("cascade_schedule_slot_rows", "time_slot", lambda t: t.get("time_slot", "id").filter("id = 3"), "select id from time_slot where id = 3")):
    register(_name, _explained_sql(_root, _sql))(lambda t, _root=_root, _keys=_keys: cascade.explain_delete(t, _root, _keys(t)))

# ---------------------------------------------------------------- W1, W3 what the forms refuse

register("insert_classes_rejected", """
with b as (select name || ' II' as name, capacity - 1 as capacity, sport_id, schedule_id from class_group)
select *, case when capacity is null or capacity < 1 then 'capacity_below_1'
               when not exists (select 1 from sport s where s.id = b.sport_id) then 'unknown_sport' else 'unknown_schedule' end as reason
from b where not (coalesce(capacity >= 1, false) and exists (select 1 from sport s where s.id = b.sport_id)
                  and exists (select 1 from schedule h where h.id = b.schedule_id))
""")(lambda t: changes.insert_classes(t, t.get("class_group").select(
    F.concat("name", F.lit(" II")).alias("name"), (F.col("capacity") - 1).alias("capacity"), "sport_id", "schedule_id")).rejected)

_EDITS = """select id, case when id % 7 = 0 then ' ' else name end as name, tax_id, email,
       case when id % 11 = 0 then date '1850-01-01' else born_on end as born_on from person"""


def _person_edits(t: Tables):
    return t.get("person", "id", "name", "tax_id", "email", "born_on").withColumns({
        "name": F.when(F.col("id") % 7 == 0, " ").otherwise(F.upper("name")),
        "born_on": F.when(F.col("id") % 11 == 0, F.lit("1850-01-01").cast("date")).otherwise(F.col("born_on"))})


register("edit_people_rejected", f"""
select *, case when id % 7 = 0 then 'blank_name' else 'born_on_out_of_range' end as reason
from ({_EDITS.replace("else name end", "else upper(name) end")}) where id % 7 = 0 or id % 11 = 0
""")(lambda t: changes.edit_people(t, "instructor", _person_edits(t)).rejected)

register("edit_people_rows", """
select id, case when id % 7 = 0 or id % 11 = 0 then name else upper(name) end as name, tax_id, email, born_on, phone_id, address_id from person
""")(lambda t: changes.edit_people(t, "instructor", _person_edits(t)).tables.get("person"))

register("insert_sports_tables", """
with b as (select distinct p_type as name from part where coalesce(regexp_matches(p_type, '[^[:space:]]'), false))
select id, name, description, is_team from sport union all
select cast((select coalesce(max(id), 0) from sport) + row_number() over (order by name) as int), name, null, null from b
""")(lambda t: changes.insert_sports(t, t.source("part").select(
    F.col("p_type").alias("name"), F.lit(None).cast("string").alias("description"),
    F.lit(None).cast("boolean").alias("is_team")).distinct()).tables.get("sport"))

# ---------------------------------------------------------------- S3 / S5 a load that broke off


def _load_resumed(t: Tables):
    """Twelve tables are loaded, a thirteenth broke off after its rows were written and before its entry in the journal; the
    second run loads that one and the rest."""
    root, names = parquet.fresh_model_folder(t.spark), t.names()
    parquet.load_once(t, root, names[:12])
    t.get(names[12]).write.parquet(parquet.table_path(root, names[12]))
    again = parquet.load_once(t, root)
    found = counts.table_counts(parquet.read_tables(t.spark, root))
    noted = parquet.load_journal(t.spark, root).select("table_name", F.col("n").alias("noted"))
    return found.join(noted, "table_name").select("table_name", "row_count", "noted", F.col("table_name").isin(again).alias("second_run"))


register("load_resumed", " union all ".join(
    f"select '{n}' as table_name, count(*) as row_count, count(*) as noted, {str(i >= 12).lower()} as second_run from {n}"
    for i, n in enumerate(schema.TABLE_NAMES)))(_load_resumed)

# ---------------------------------------------------------------- O1 to O3 with positions

def _sort_keys(order: str):
    named = [(k.split()[0], " desc" in k) for k in order.split(", ")]
    return [F.col(c).desc_nulls_last() if falling else F.col(c).asc_nulls_last() for c, falling in named]


for _report, _order in (
        ("occupancy", "enrolled desc, class_id"), ("invoice_summary", "total desc nulls last, status_id"),
        ("plan_revenue", "total desc nulls last, period_id"), ("seats_by_category", "seats desc nulls last, is_team asc nulls last"),
        ("instructor_load", "classes desc, instructor_id")):
    QUERIES[f"{_report}_in_order"] = Query(
        lambda t, _report=_report, _order=_order: in_order(reports.REPORTS[_report](t, ordered=False), _sort_keys(_order)),
        f"select *, row_number() over (order by {_order}) as position from ({QUERIES[_report].oracle}) r")


def _labels_collated(t: Tables, kind: str):
    rows = rosters._role_people(t, kind, person_cols=("id", "name")) if kind in rosters.ROLE_TABLES else t.get(kind, "id", "name")
    placed = in_order(rows, [collated("name").asc_nulls_first(), F.col("id").asc()])
    return placed.select("id", text.label("id", "name").alias("label"), "position")


# DuckDB's own collations stand for the ICU one: for these names they order alike.
for _kind, _rows in (("student", "select id, name from person where id in (select person_id from student)"),
                     ("class_group", "select id, name from class_group"), ("sport", "select id, name from sport")):
    register(f"labels_{_kind}_collated", f"""
select id, format('{{}} - {{}}', id, name) as label, row_number() over (order by name collate nocase.noaccent nulls first, id) as position from ({_rows})
""")(lambda t, _kind=_kind: _labels_collated(t, _kind))


def _kpi_collated(t: Tables):
    """Open invoices by status names in any case, and instructors with the sports of their names, joined under the collation."""
    wanted = [F.lit(s.upper()) for s in text.OPEN_STATUSES]
    status = t.dim("invoice_status", "id", "name").filter(collated("name").isin([collated(w) for w in wanted]))
    found = t.get("invoice", "status_id").join(status.select(F.col("id").alias("status_id"), "name"), "status_id")
    typed = t.get("sport", "id", "name").select(collated(F.upper("name")).alias("sport_name"))
    named = t.get("sport", "id", "name").select(collated("name").alias("sport_name"), "id")
    return t.spark.range(1).select(
        found.agg(F.count(F.lit(1))).scalar().alias("open_invoices"),
        typed.join(named, "sport_name").agg(F.count(F.lit(1))).scalar().alias("sports_matched"))


register("kpi_collated", f"""
select (select count(*) from invoice where status_id in (select id from invoice_status where name in ({_OPEN}))) as open_invoices,
       (select count(*) from sport a join sport b on upper(a.name) = upper(b.name)) as sports_matched
""")(_kpi_collated)
