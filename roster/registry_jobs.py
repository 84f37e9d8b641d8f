"""Registered change jobs (W1-W10) with their oracle SQL.

The change batches are derived from the given tables (for example "delete every person living at address
3", "enrol each student in the class numbered like their plan"), so each job runs over whole tables and
its work grows with them. Cascade and validation oracles are generated from the foreign-key metadata as
plain NOT EXISTS / GROUP BY SQL, independent of the Spark join code.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from roster import schema
from roster.functions import text
from roster.operators import cascade, changelog, changes, counts, linking, quality, reports
from roster.operators.links import LINKS
from roster.registry import named_links_sql, register
from roster.sources import parquet
from roster.sources.tables import Tables

RUN_DATE = "2024-01-01"


# ---------------------------------------------------------------- W4 delete with FK rules

def _cascade_oracle(root: str, keys_sql: str) -> str:
    """NOT EXISTS formulation of delete_cascade + change_report for a single-column-key root."""
    pk = schema.table(root).primary_key[0]
    blocking = [fk for fk in schema.children_of(root) if fk.on_delete in schema.BLOCKING]
    refused = " or ".join(f"exists (select 1 from {fk.child} c where c.{fk.column} = r.{pk})" for fk in blocking)
    ctes = [f"tgt_{root} as (select r.{pk} from {root} r where r.{pk} in (select k.{pk} from ({keys_sql}) k))",
            f"del_{root} as (select r.{pk} from tgt_{root} r" + (f" where not ({refused})" if refused else "") + ")"]
    items = [(root, f"select count(*) from {root} x where not exists "
                    f"(select 1 from del_{root} d where d.{pk} = x.{pk})")]
    closure = schema.cascade_closure(root)
    for name in closure[1:]:
        incoming = [fk for fk in schema.parents_of(name) if fk.on_delete == schema.CASCADE and fk.parent in closure]
        hit = " or ".join(f"exists (select 1 from del_{fk.parent} d where d.{fk.parent_column} = x.{fk.column})"
                          for fk in incoming)
        tpk = schema.table(name).primary_key
        ctes.append(f"del_{name} as (select {', '.join('x.' + c for c in tpk)} from {name} x where {hit})")
        items.append((name, f"select count(*) from {name} x where not ({hit})"))
    nulls = []
    for parent in closure:
        for fk in schema.children_of(parent):
            if fk.on_delete == schema.SET_NULL:
                gone = f"exists (select 1 from del_{parent} d where d.{fk.parent_column} = x.{fk.column})"
                if fk.child not in closure:
                    items.append((fk.child, f"select count(*) from {fk.child} x"))
                nulls.append((f"{fk.child}.{fk.column}",
                              f"select count(case when x.{fk.column} is not null and not {gone} then 1 end) "
                              f"from {fk.child} x"))
    items += nulls
    items.append(("keys_deleted", f"select count(*) from del_{root}"))
    items.append(("keys_rejected", f"select (select count(*) from tgt_{root}) - (select count(*) from del_{root})"))
    body = " union all ".join(f"select '{item}' as item, cast(({q}) as bigint) as n" for item, q in items)
    return f"with {', '.join(ctes)} {body}"


def _register_delete(name: str, root: str, keys, keys_sql: str) -> None:
    def job(t: Tables):
        return cascade.change_report(cascade.delete_cascade(t, root, keys(t)))
    register(name, _cascade_oracle(root, keys_sql))(job)


_register_delete("cascade_person", "person",
                 lambda t: t.get("person", "id", "address_id").filter(F.col("address_id") == 3),
                 "select id from person where address_id = 3")
_register_delete("cascade_class", "class_group",
                 lambda t: t.get("class_group", "id", "capacity").filter(F.col("capacity") < 10),
                 "select id from class_group where capacity < 10")
_register_delete("restrict_sport", "sport", lambda t: t.get("sport", "id"), "select id from sport")
_register_delete("restrict_phone", "phone", lambda t: t.get("phone", "id"), "select id from phone")
_register_delete("restrict_schedule", "schedule", lambda t: t.get("schedule", "id"), "select id from schedule")
_register_delete("set_null_address", "address",
                 lambda t: t.get("address", "id", "district").filter(F.col("district") == "ASIA"),
                 "select id from address where district = 'ASIA'")
_register_delete("set_null_period", "billing_period",
                 lambda t: t.get("billing_period", "id").filter(F.col("id") == 2),
                 "select id from billing_period where id = 2")
_register_delete("set_null_status", "invoice_status",
                 lambda t: t.get("invoice_status", "id").filter(F.col("id") == 3),
                 "select id from invoice_status where id = 3")
_register_delete("cascade_plan", "plan",
                 lambda t: t.get("plan", "id", "amount").filter(F.col("amount") >= 990),
                 "select id from plan where amount >= 990")
_register_delete("cascade_schedule_slot", "time_slot",
                 lambda t: t.get("time_slot", "id").filter(F.col("id") == 3),
                 "select id from time_slot where id = 3")

# ---------------------------------------------------------------- W5 remove one link

register("unlink_one", """
with req as (select student_id, class_id from enrollment group by student_id, class_id having count(*) > 1),
gone as (select min(e.id) as id from enrollment e join req r on e.student_id = r.student_id
         and e.class_id = r.class_id group by e.student_id, e.class_id)
select e.id as id, e.student_id as student_id, e.class_id as class_id from enrollment e
where not exists (select 1 from gone g where g.id = e.id)
""")(lambda t: linking.unlink(
    t, "enrollment",
    t.get("enrollment", "student_id", "class_id").groupBy("student_id", "class_id").count()
     .filter(F.col("count") > 1).select("student_id", "class_id")).table)

# ---------------------------------------------------------------- W6 add links

_LINK_BATCHES = {
    # kind: (Spark batch over Tables, SQL batch); each shifts existing links to neighbouring keys, so the
    # batch holds links that exist, new valid links and links to keys that do not exist.
    "teaches": (lambda t: t.get("teaches").select("instructor_id", (F.col("class_id") + 1).alias("class_id")),
                "select instructor_id as a, class_id + 1 as b from teaches"),
    "qualified": (lambda t: t.get("qualified").select("instructor_id", (F.col("sport_id") + 1).alias("sport_id")),
                  "select instructor_id as a, sport_id + 1 as b from qualified"),
    "guardianship": (lambda t: t.get("guardianship").select(
                         "student_id", (F.col("guardian_id") + 2).alias("guardian_id")),
                     "select student_id as a, guardian_id + 2 as b from guardianship"),
    "student_plan": (lambda t: t.get("student_plan").select("student_id", (F.col("plan_id") + 1).alias("plan_id")),
                     "select student_id as a, plan_id + 1 as b from student_plan"),
    "enrollment": (lambda t: t.get("student_plan").select("student_id", F.col("plan_id").alias("class_id")),
                   "select student_id as a, plan_id as b from student_plan"),
}


def _link_oracle(kind: str, batch_sql: str) -> str:
    spec = LINKS[kind]
    fa = next(fk for fk in schema.parents_of(spec.table) if fk.column == spec.a)
    fb = next(fk for fk in schema.parents_of(spec.table) if fk.column == spec.b)
    keyed = set(schema.table(spec.table).primary_key) == {spec.a, spec.b}
    outcome = (f"case when not exists (select 1 from {fa.parent} p where p.{fa.parent_column} = q.a) then 'unknown_a' "
               f"when not exists (select 1 from {fb.parent} p where p.{fb.parent_column} = q.b) then 'unknown_b' ")
    if keyed:
        outcome += (f"when exists (select 1 from {spec.table} x where x.{spec.a} = q.a and x.{spec.b} = q.b) "
                    f"then 'exists' ")
    outcome += "else 'added' end"
    req = f"select distinct a, b from ({batch_sql}) s" if keyed else batch_sql
    lab = f"with req as ({req}), lab as (select a, b, {outcome} as outcome from req q) "
    if keyed:
        return lab + f"select a as {spec.a}, b as {spec.b}, outcome from lab"
    return lab + (f"select (select coalesce(max(id), 0) from {spec.table}) + row_number() over (order by a, b) as id, "
                  f"a as {spec.a}, b as {spec.b}, outcome from lab where outcome = 'added' union all "
                  f"select cast(null as bigint), a, b, outcome from lab where outcome <> 'added'")


for _kind, (_batch, _sql) in _LINK_BATCHES.items():
    register(f"link_{_kind}", _link_oracle(_kind, _sql))(
        lambda t, _kind=_kind, _batch=_batch: linking.link(t, _kind, _batch(t)).outcomes)

# The link tables after the same batches.
for _kind, (_batch, _sql) in _LINK_BATCHES.items():
    _spec = LINKS[_kind]
    register(f"link_{_kind}_rows", f"with res as ({_link_oracle(_kind, _sql)}) "
             f"select {_spec.a}, {_spec.b} from {_spec.table} union all "
             f"select {_spec.a}, {_spec.b} from res where outcome = 'added'")(
        lambda t, _kind=_kind, _batch=_batch: linking.link(t, _kind, _batch(t)).tables.get(LINKS[_kind].table, LINKS[_kind].a, LINKS[_kind].b))


# Unlinking by the same batches, which also ask for pairs that aren't there: rows left, and outcomes.
for _kind in ("teaches", "qualified", "guardianship", "student_plan"):
    _batch, _sql = _LINK_BATCHES[_kind]
    _spec = LINKS[_kind]
    register(f"unlink_{_kind}", f"from {_spec.table} x select {_spec.a}, {_spec.b} where not exists "
             f"(from ({_sql}) q where q.a = x.{_spec.a} and q.b = x.{_spec.b})")(
        lambda t, _kind=_kind, _batch=_batch: linking.unlink(t, _kind, _batch(t)).table.select(LINKS[_kind].a, LINKS[_kind].b))
    register(f"unlink_{_kind}_outcomes", f"""
with asked as (select a, b, row_number() over (partition by a, b) as turn from ({_sql}))
select a as {_spec.a}, b as {_spec.b}, if(turn = 1 and exists (from {_spec.table} x where x.{_spec.a} = asked.a and x.{_spec.b} = asked.b),
       'removed', 'not_found') as outcome from asked
""")(lambda t, _kind=_kind, _batch=_batch: linking.unlink(t, _kind, _batch(t)).outcomes)

# ---------------------------------------------------------------- W7 label -> key, last entry wins

for _kind in LINKS:
    _last = "row(a_name, id)" if _kind == "enrollment" else "row(a_name, a, b)"
    register("link_label_index" if _kind == "enrollment" else f"link_label_index_{_kind}", f"""
with named as ({named_links_sql(_kind)}), best as (select label, max({_last}) as last from named group by label)
select distinct label, a, b from named join best using (label) where {_last} = last
""")(lambda t, _kind=_kind: linking.resolve_labels(t, _kind))

# ---------------------------------------------------------------- W8 change log

register("latest_change", """
select user_id, event_id, ts, event_type, value, props from (
  select *, row_number() over (partition by user_id order by ts desc nulls last, event_id desc nulls last) as rn
  from events) x
where rn = 1 and not coalesce(event_type in ('error'), false)
""")(lambda t: changelog.apply_changes(
    None, t.source("events"), key="user_id", order=["ts", "event_id"], op_col="event_type", delete_ops=["error"],
    columns=["event_id", "ts", "event_type", "value", "props"]))


# ---------------------------------------------------------------- W1 / W10 inserts

register("insert_students", f"""
with b as (select c_name as name, cast(null as varchar) as tax_id, cast(null as varchar) as email,
                  cast(null as date) as born_on, date '{RUN_DATE}' as enrolled_on,
                  coalesce(case when c_mktsegment = 'BUILDING' then null else c_mktsegment end, 'Apto') as health_note
           from customer where coalesce(regexp_matches(c_name, '[^[:space:]]'), false))
select (select coalesce(max(id), 0) from person)
       + row_number() over (order by name, tax_id, email, born_on, enrolled_on, health_note) as id,
       name, tax_id, email, born_on, enrolled_on, health_note from b
""")(lambda t: changes.insert_people(t, "student", t.source("customer").select(
    F.col("c_name").alias("name"), F.lit(None).cast("string").alias("tax_id"),
    F.lit(None).cast("string").alias("email"), F.lit(None).cast("date").alias("born_on"),
    F.lit(None).cast("date").alias("enrolled_on"),
    F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).alias("health_note")),
    run_date=RUN_DATE).inserted)

register("insert_instructors", """
with b as (select s_name as name, cast(null as varchar) as tax_id,
                  'i' || cast(s_suppkey as varchar) || '@example.org' as email, cast(null as date) as born_on
           from supplier where coalesce(regexp_matches(s_name, '[^[:space:]]'), false))
select (select coalesce(max(id), 0) from person) + row_number() over (order by name, tax_id, email, born_on) as id,
       name, tax_id, email, born_on from b
""")(lambda t: changes.insert_people(t, "instructor", t.source("supplier").select(
    F.col("s_name").alias("name"), F.lit(None).cast("string").alias("tax_id"),
    F.concat(F.lit("i"), F.col("s_suppkey").cast("string"), F.lit("@example.org")).alias("email"),
    F.lit(None).cast("date").alias("born_on"))).inserted)

register("insert_classes", """
with b as (select name || ' II' as name, capacity - 1 as capacity, sport_id, schedule_id from class_group),
ok as (select * from b where coalesce(regexp_matches(name, '[^[:space:]]'), false) and coalesce(capacity >= 1, false)
       and exists (select 1 from sport s where s.id = b.sport_id)
       and exists (select 1 from schedule h where h.id = b.schedule_id))
select (select coalesce(max(id), 0) from class_group)
       + row_number() over (order by name, capacity, sport_id, schedule_id) as id,
       name, capacity, sport_id, schedule_id from ok
""")(lambda t: changes.insert_classes(t, t.get("class_group").select(
    F.concat("name", F.lit(" II")).alias("name"), (F.col("capacity") - 1).alias("capacity"),
    "sport_id", "schedule_id")).inserted)

register("insert_sports", """
with b as (select distinct p_type as name, cast(null as varchar) as description, cast(null as boolean) as is_team
           from part),
ok as (select * from b where coalesce(regexp_matches(name, '[^[:space:]]'), false))
select cast((select coalesce(max(id), 0) from sport) + row_number() over (order by name, description, is_team) as int)
       as id, name, description, is_team from ok
""")(lambda t: changes.insert_sports(t, t.source("part").select(
    F.col("p_type").alias("name"), F.lit(None).cast("string").alias("description"),
    F.lit(None).cast("boolean").alias("is_team")).distinct()).inserted)

# ---------------------------------------------------------------- W3 updates


def _update_students(t: Tables):
    s = t.get("student").join(t.get("guardianship", "student_id").withColumnRenamed("student_id", "person_id"),
                              "person_id", "left_semi")
    p = t.get("person")
    ch = s.join(p, F.col("person_id") == F.col("id")).select(
        "id", F.upper("name").alias("name"), "tax_id", "email", "born_on", "enrolled_on",
        F.lit(text.DEFAULT_HEALTH_NOTE).alias("health_note"))
    new = changes.update_people(t, "student", ch)
    ns, np_ = new.get("student"), new.get("person")
    return ns.join(np_, F.col("person_id") == F.col("id")).select("id", "name", "tax_id", "email", "born_on",
                                                       "enrolled_on", "health_note")


register("update_students", """
with ch as (select p.id, upper(p.name) as name, p.tax_id, p.email, p.born_on, a.enrolled_on, 'Apto' as health_note
            from student a join person p on a.person_id = p.id where p.id in (select student_id from guardianship)),
np as (select p.id, case when ch.id is not null then ch.name else p.name end as name,
              case when ch.id is not null then ch.tax_id else p.tax_id end as tax_id,
              case when ch.id is not null then ch.email else p.email end as email,
              case when ch.id is not null then ch.born_on else p.born_on end as born_on
       from person p left join ch on p.id = ch.id),
ns as (select a.person_id, case when ch.id is not null then ch.enrolled_on else a.enrolled_on end as enrolled_on,
              case when ch.id is not null then ch.health_note else a.health_note end as health_note
       from student a left join ch on a.person_id = ch.id)
select np.id, np.name, np.tax_id, np.email, np.born_on, ns.enrolled_on, ns.health_note
from ns join np on ns.person_id = np.id
""")(_update_students)


def _update_instructors(t: Tables):
    i = t.get("instructor").join(t.get("teaches", "instructor_id").withColumnRenamed("instructor_id", "person_id"),
                                 "person_id", "left_semi")
    p = t.get("person")
    ch = i.join(p, F.col("person_id") == F.col("id")).select("id", F.upper("name").alias("name"), "tax_id",
                                               F.lower("email").alias("email"), "born_on")
    new = changes.update_people(t, "instructor", ch)
    ni, np_ = new.get("instructor"), new.get("person")
    return ni.join(np_, F.col("person_id") == F.col("id")).select("id", "name", "tax_id", "email", "born_on")


register("update_instructors", """
with ch as (select p.id, upper(p.name) as name, p.tax_id, lower(p.email) as email, p.born_on
            from instructor i join person p on i.person_id = p.id
            where p.id in (select instructor_id from teaches)),
np as (select p.id, case when ch.id is not null then ch.name else p.name end as name,
              case when ch.id is not null then ch.tax_id else p.tax_id end as tax_id,
              case when ch.id is not null then ch.email else p.email end as email,
              case when ch.id is not null then ch.born_on else p.born_on end as born_on
       from person p left join ch on p.id = ch.id)
select np.id, np.name, np.tax_id, np.email, np.born_on from instructor i join np on i.person_id = np.id
""")(_update_instructors)


def _update_classes(t: Tables):
    occ = reports.occupancy(t, ordered=False)
    over = occ.filter(F.col("enrolled") > F.col("capacity")).select(F.col("class_id").alias("id"), "enrolled")
    c = t.get("class_group")
    ch = c.join(over, "id").select("id", "name", F.col("enrolled").cast("int").alias("capacity"),
                                   "sport_id", "schedule_id")
    return changes.update_classes(t, ch).get("class_group")


register("update_classes", """
with cnt as (select class_id, count(student_id) as n from enrollment group by class_id),
ch as (select t.id, t.name, cast(c.n as int) as capacity, t.sport_id, t.schedule_id
       from class_group t join sport e on t.sport_id = e.id join cnt c on c.class_id = t.id where c.n > t.capacity)
select t.id, case when ch.id is not null then ch.name else t.name end as name,
       case when ch.id is not null then ch.capacity else t.capacity end as capacity,
       case when ch.id is not null then ch.sport_id else t.sport_id end as sport_id,
       case when ch.id is not null then ch.schedule_id else t.schedule_id end as schedule_id
from class_group t left join ch on t.id = ch.id
""")(_update_classes)


def _update_sports(t: Tables):
    s = t.get("sport")
    ch = s.filter(F.col("is_team").isNull()).select("id", "name", "description",
                                                    F.lit(False).alias("is_team"))
    return changes.update_sports(t, ch).get("sport")


register("update_sports", """
with ch as (select id, name, description, false as is_team from sport where is_team is null)
select s.id, case when ch.id is not null then ch.name else s.name end as name,
       case when ch.id is not null then ch.description else s.description end as description,
       case when ch.id is not null then ch.is_team else s.is_team end as is_team
from sport s left join ch on s.id = ch.id
""")(_update_sports)

# ---------------------------------------------------------------- W9 validation


def keys_sql(tables: list[str], stored: dict[str, str]) -> str:
    """Key rules of the tables; ``stored`` names the views that hold some of them."""
    parts = []
    for t in tables:
        pk, held = schema.table(t).primary_key, stored.get(t, t)
        cols = ", ".join(pk)
        parts.append(f"select 'pk_duplicate' as rule, '{t}' as table_name, '{','.join(pk)}' as column_name, "
                     f"count(*) as n_bad from (select {cols} from {held} group by {cols} having count(*) > 1) x")
        nulls = " or ".join(f"{c} is null" for c in pk)
        parts.append(f"select 'pk_null', '{t}', '{','.join(pk)}', count(case when {nulls} then 1 end) from {held}")
    return " union all ".join(parts)


def refs_sql(edges: list[schema.ForeignKey], stored: dict[str, str]) -> str:
    return " union all ".join(
        f"select 'fk_orphan' as rule, '{fk.child}' as table_name, '{fk.column}' as column_name, count(*) as n_bad "
        f"from {stored.get(fk.child, fk.child)} c where c.{fk.column} is not null and not exists "
        f"(select 1 from {stored.get(fk.parent, fk.parent)} p where p.{fk.parent_column} = c.{fk.column})"
        for fk in edges)


def domains_sql(tables: list[str], stored: dict[str, str]) -> str:
    def held(n: str) -> str:
        return stored.get(n, n)

    parts = [f"select 'blank_name' as rule, '{n}' as table_name, 'name' as column_name, "
             f"count(case when not coalesce(regexp_matches(name, '[^[:space:]]'), false) then 1 end) as n_bad from {held(n)}"
             for n in quality.NAMED_FORMS if n in tables]
    if "class_group" in tables:
        parts.append(f"select 'capacity_below_1', 'class_group', 'capacity', count(*) from {held('class_group')} where capacity is null or capacity < 1")
        parts += [f"select 'missing_parent', 'class_group', '{c}', count(*) from {held('class_group')} where {c} is null"
                  for c in ("sport_id", "schedule_id")]
    for n, c in quality.DATE_COLUMNS:
        if n in tables:
            parts.append(f"select 'date_out_of_range', '{n}', '{c}', count(case when {c} < date '{quality.DATE_MIN}' "
                         f"or {c} > date '{quality.DATE_MAX}' then 1 end) from {held(n)}")
    for t in tables:
        for c, w in schema.table(t).max_lengths.items():
            parts.append(f"select 'too_long', '{t}', '{c}', count(case when length({c}) > {w} then 1 end) from {held(t)}")
    return " union all ".join(parts)


register("check_pk", keys_sql(schema.TABLE_NAMES, {}))(quality.check_keys)
register("check_fk", refs_sql(schema.FOREIGN_KEYS, {}))(quality.check_references)
register("check_domains", domains_sql(schema.TABLE_NAMES, {}))(quality.check_domains)


# ---------------------------------------------------------------- S3 / S5 load once, S4 catalog


def _load_counts(t: Tables):
    root = parquet.fresh_model_folder(t.spark)
    parquet.load_once(t, root)
    return counts.table_counts(parquet.read_tables(t.spark, root))


register("load_counts", " union all ".join(
    f"select '{n}' as table_name, count(*) as row_count from {n}" for n in schema.TABLE_NAMES))(_load_counts)


def _catalog_oracle() -> str:
    refs = {(fk.child, fk.column): fk.parent for fk in schema.FOREIGN_KEYS}
    parts = []
    for n in schema.TABLE_NAMES:
        spec = schema.table(n)
        for f in spec.schema.fields:
            ref = refs.get((n, f.name))
            parts.append(f"select '{n}' as table_name, '{f.name}' as column_name, "
                         f"'{f.dataType.simpleString()}' as data_type, {str(f.name in spec.primary_key).lower()} as is_key, "
                         f"{repr(ref) if ref else 'cast(null as varchar)'} as references_table, "
                         f"count({f.name}) as non_null from {n}")
    return " union all ".join(parts)


register("schema_catalog", _catalog_oracle())(counts.schema_catalog)
