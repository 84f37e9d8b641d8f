"""Registered queries: name -> (job over ``Tables``, DuckDB oracle SQL or None).

Every job reads the model tables built from the given star-schema tables, so its work grows with them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from roster.functions import text
from roster.operators import counts, links, reports, rosters
from roster.oracle import with_views
from roster.sources.tables import Tables


@dataclass(frozen=True)
class Query:
    job: Callable[[Tables], DataFrame]
    oracle: str | None


QUERIES: dict[str, Query] = {}


def register(name: str, oracle: str | None):
    def wrap(fn):
        QUERIES[name] = Query(fn, with_views(oracle) if oracle else None)
        return fn
    return wrap


def _brl_sql(expr: str) -> str:
    """Money text of a decimal, from its whole part and its cents."""
    whole = f"cast(floor(abs(cast({expr} as decimal(38,2)))) as bigint)"
    cents = f"cast((abs(cast({expr} as decimal(38,2))) - {whole}) * 100 as integer)"
    return (f"coalesce('{text.MONEY_PREFIX}' || case when {expr} < 0 then '-' else '' end "
            f"|| replace(format('{{:,}}', {whole}), ',', '.') || ',' || lpad(cast({cents} as varchar), 2, '0'), '')")


def _category_sql(flag: str) -> str:
    return f"if(coalesce({flag}, false), '{text.TEAM}', '{text.INDIVIDUAL}')"


# ---------------------------------------------------------------- reports

def _single_row(**figures: str) -> str:
    """One row of independent figures, each a one-row subquery."""
    return "select * from " + ", ".join(f"(select cast({sql} as bigint) as {name} {rest})"
                                        for name, (sql, rest) in ((n, f.split(" ", 1)) for n, f in figures.items()))


_OPEN = ", ".join(f"'{s}'" for s in text.OPEN_STATUSES)
register("kpi", _single_row(
    students="count(*) from student", instructors="count(*) from instructor", classes="count(*) from class_group",
    sports="count(*) from sport", enrollments="count(*) from enrollment",
    open_invoices=f"count(*) from invoice where status_id in (select id from invoice_status where name in ({_OPEN}))",
    plans="count(*) from plan", seats="coalesce(sum(capacity),0) from class_group"))(reports.kpi)

register("occupancy", """
with taken as (select class_id, count(student_id) as n from enrollment group by class_id)
select c.id as class_id, c.name as class_name, sport.name as sport_name, capacity, coalesce(n, 0) as enrolled
from class_group c join sport on sport.id = sport_id left join taken on class_id = c.id
""")(reports.occupancy)


def _money_report(fact: str, key: str, dim: str, label: str, counted: str) -> str:
    """Amounts of a fact table added up by a lookup key, then named; lookup rows without facts don't show."""
    return f"""
with sums as (select {key}, count(id) as {counted}, sum(amount) as amount from {fact} group by {key})
select {key}, {dim}.name as {label}, {counted}, cast(amount as decimal(38,2)) as total, {_brl_sql("amount")} as total_brl
from {dim} join sums on sums.{key} = {dim}.id
"""


register("invoice_summary", _money_report("invoice", "status_id", "invoice_status", "status", "invoices"))(reports.invoice_summary)
register("plan_revenue", _money_report("plan", "period_id", "billing_period", "period", "plans"))(reports.plan_revenue)

register("seats_by_category", f"""
with seats as (select sport_id, sum(capacity) as n, count(*) as classes from class_group group by sport_id)
select is_team, any_value({_category_sql("is_team")}) as category, cast(sum(n) as bigint) as seats
from sport, seats where seats.sport_id = sport.id group by is_team
""")(reports.seats_by_category)

register("instructor_load", """
with load as (select instructor_id, count(class_id) as classes from teaches group by instructor_id)
select instructor_id, name as instructor, classes from load join person on id = instructor_id
where instructor_id in (from instructor select person_id)
""")(reports.instructor_load)

# ---------------------------------------------------------------- rosters, labels


def _day_sql(column: str) -> str:
    return f"strftime({column}, '%d/%m/%Y') as {column}"


def _people_sql(role: str, columns: list[str], role_columns: list[str] = []) -> str:  # noqa: B006 - not changed
    """People who hold a role, with columns of the role's own table."""
    return f"from {role} natural join (select *, id as person_id from person) select {', '.join([*columns, *role_columns])}"


register("student_roster", _people_sql("student", ["id", "name", "tax_id", "email", _day_sql("born_on")],
                                       [_day_sql("enrolled_on"), "health_note"]))(rosters.student_roster)
register("instructor_roster", _people_sql("instructor", ["id", "name", "tax_id", "email", _day_sql("born_on")]))(
    rosters.instructor_roster)

register("class_roster", """
select id, name, capacity, (select s.name from sport s where s.id = sport_id) as sport,
       (select h.name from schedule h where h.id = schedule_id) as schedule from class_group
""")(rosters.class_roster)

register("sport_roster", f"from sport select id, name, description, {_category_sql('is_team')} as category")(rosters.sport_roster)

_LABEL_SQL = "select id, format('{} - {}', id, name) as label from"
for _role in rosters.ROLE_TABLES:
    register(f"labels_{_role}", f"{_LABEL_SQL} person where id in (from {_role} select person_id)")(
        lambda t, _role=_role: rosters.labels(t, _role))

for _key, _tbl in (("class", "class_group"), ("sport", "sport"), ("plan", "plan"), ("schedule", "schedule")):
    register(f"labels_{_key}", f"{_LABEL_SQL} {_tbl}")(lambda t, _tbl=_tbl: rosters.labels(t, _tbl))

# Lookups: the batch of requested ids comes from another table (the editing flows of the reference
# pick an id from a list; here the requests are every id that table references).
def _requested(rows: str, column: str, link: str) -> str:
    """The rows whose id some link refers to."""
    return f"with records as ({rows}) from records semi join (select {column} as id from {link}) using (id)"


register("lookup_student", _requested(
    _people_sql("student", ["id", "name", "tax_id", "email", "born_on"], ["enrolled_on", "health_note"]),
    "student_id", "guardianship"))(lambda t: rosters.lookup_student(t, t.get("guardianship", "student_id")))
register("lookup_instructor", _requested("from person select id, name, tax_id, email, born_on", "instructor_id", "qualified"))(
    lambda t: rosters.lookup_instructor(t, t.get("qualified", "instructor_id")))
register("lookup_class", _requested("from class_group select id, name, capacity, sport_id, schedule_id", "class_id", "teaches"))(
    lambda t: rosters.lookup_class(t, t.get("teaches", "class_id")))
register("lookup_sport", _requested("from sport select id, name, description, is_team", "sport_id", "class_group"))(
    lambda t: rosters.lookup_sport(t, t.get("class_group", "sport_id")))

# A single record by a bound id.
for _kind, _rows in (("student", _people_sql("student", ["id", "name", "tax_id", "email", "born_on"], ["enrolled_on", "health_note"])),
                     ("instructor", "from person select id, name, tax_id, email, born_on"),
                     ("class_group", "from class_group select id, name, capacity, sport_id, schedule_id"),
                     ("sport", "from sport select id, name, description, is_team")):
    register(f"lookup_one_{_kind}", f"with records as ({_rows}) from records where id = 12")(
        lambda t, _kind=_kind: rosters.lookup_one(t, _kind, 12))

# ---------------------------------------------------------------- links


def named_links_sql(kind: str) -> str:
    """Every row of a link table as (a, b, a_name, label), from the link's specification."""
    spec = links.LINKS[kind]
    return (f"select x.{spec.a} as a, x.{spec.b} as b, one.name as a_name, "
            f"one.name || '{text.LINK_PHRASES[kind]}' || other.name as label{', x.id as id' if kind == 'enrollment' else ''} "
            f"from {spec.table} x join person one on one.id = x.{spec.a} join {spec.b_table} other on other.{spec.b_key} = x.{spec.b}")


for _kind in links.LINKS:
    register(f"links_{_kind}", f"select a, b, label from ({named_links_sql(_kind)})")(
        lambda t, _kind=_kind: links.links(t, _kind))

# ---------------------------------------------------------------- counts and ids

register("table_counts", " union all ".join(
    f"select '{n}' as table_name, count(*) as row_count from {n}" for n in
    ["phone", "address", "billing_period", "invoice_status", "sport", "schedule", "time_slot", "person",
     "guardian", "instructor", "student", "class_group", "session", "enrollment", "attendance", "plan",
     "invoice", "schedule_slot", "student_plan", "cancellation", "guardianship", "teaches", "qualified"]))(
    counts.table_counts)

register("next_ids", " union all ".join(
    f"select '{n}' as table_name, cast(coalesce(max(id), 0) as bigint) + 1 as next_id from {n}" for n in
    ["phone", "address", "billing_period", "invoice_status", "sport", "schedule", "time_slot", "person",
     "class_group", "session", "enrollment", "attendance", "plan", "invoice", "schedule_slot", "cancellation"]))(
    counts.next_ids)


# Change jobs register themselves on import (they use ``register`` above).
from roster import registry_jobs, registry_state  # noqa: E402,F401
