"""DuckDB SQL equivalents of the registered queries, for the correctness gate.

The driver registers only the raw star-schema tables, so each oracle text inlines the model views it needs
as CTEs (``with_views``). The view texts are the adapter specification of the fixtures.
"""

from __future__ import annotations

import re

# The five status names and the days of the billing periods are fixed values, as in sources/adapter.py.
VIEW_SQL = {
    "phone": "select c_custkey as id, concat('27', lpad(cast(c_custkey as string), 9, '0')) as phone from customer",
    "address": "select n_nationkey as id, n_name as street, r_name as district, n_name as city, "
               "cast(null as string) as complement from nation join region on n_regionkey = r_regionkey",
    "billing_period": "select id, name, case id when 1 then 30 when 2 then 60 when 3 then 90 when 4 then 180 "
                      "else 365 end as days from (select distinct cast(substring(o_orderpriority, 1, 1) as int) "
                      "as id, o_orderpriority as name from orders) x",
    "invoice_status": "select id, name from (values (1,'Paga'), (2,'Pendente'), (3,'Atrasada'), (4,'Cancelada'), "
                      "(5,'Isenta')) as t(id, name)",
    "sport": "select id, name, cast(null as string) as description, case when id % 3 = 0 then true "
             "when id % 3 = 1 then false else null end as is_team from (select distinct "
             "cast(substring(p_brand, 7) as int) as id, p_brand as name from part) x",
    "schedule": "select cast(row_number() over (order by name) as int) as id, name from "
                "(select distinct p_type as name from part) x",
    "time_slot": "select h + 1 as id, concat(lpad(cast(h as string), 2, '0'), ':00:00') as starts_at, "
                 "concat(lpad(cast(h + 1 as string), 2, '0'), ':00:00') as ends_at from "
                 "(select distinct cast(hour(ts) as int) as h from events) x",
    "person": "select c_custkey * 2 as id, c_name as name, lpad(cast(c_custkey as string), 11, '0') as tax_id, "
              "concat('c', cast(c_custkey as string), '@example.org') as email, "
              "date '1960-01-01' + cast(c_custkey % 15000 as int) as born_on, "
              "case when c_custkey % 10 = 0 then null else c_custkey end as phone_id, "
              "c_nationkey as address_id from customer union all select s_suppkey * 2 + 1, s_name, "
              "lpad(cast(s_suppkey as string), 11, '9'), concat('s', cast(s_suppkey as string), '@example.org'), "
              "date '1960-01-01' + cast(s_suppkey % 15000 as int), cast(null as bigint), s_nationkey from supplier",
    "student": "select c_custkey * 2 as person_id, cast(min(o_orderdate) as date) as enrolled_on, "
               "min(c_mktsegment) as health_note from customer left join orders on o_custkey = c_custkey "
               "group by c_custkey",
    "instructor": "select s_suppkey * 2 + 1 as person_id from supplier",
    "guardian": "select s_suppkey * 2 + 1 as person_id from supplier",
    "class_group": "select p_partkey as id, p_name as name, p_size as capacity, s.id as schedule_id, "
                   "case when p_partkey % 50 = 0 or p_brand = 'Brand#25' then null "
                   "else cast(substring(p_brand, 7) as int) end as sport_id from part join schedule s "
                   "on s.name = p_type",
    "session": "select event_id as id, cast(ts as date) as held_on, event_type <> 'error' as was_held, "
               "user_id as class_id from events",
    "attendance": "select event_id as id, event_type in ('view', 'click') as present from events",
    "cancellation": "select event_id as id, props as reason from events where event_type = 'error'",
    "enrollment": "select row_number() over (order by o_custkey, l_partkey) as id, o_custkey * 2 as student_id, "
                  "l_partkey as class_id from lineitem join orders on l_orderkey = o_orderkey",
    "plan": "select p_partkey as id, p_name as name, cast(p_retailprice as decimal(18,2)) as amount, "
            "case when p_partkey % 40 = 0 then null else p_size % 5 + 1 end as period_id, "
            "p_type as description from part",
    "invoice": "select o_orderkey as id, cast(o_totalprice as decimal(18,2)) as amount, "
               "cast(o_orderdate as date) as due_on, case when o_orderstatus = 'F' then cast(o_orderdate as date) "
               "else null end as paid_on, case when o_orderkey % 100 = 0 then null when o_orderstatus = 'F' "
               "then 1 when o_orderstatus = 'O' then 2 else 3 end as status_id, case o_orderkey % 3 "
               "when 0 then 'PIX' when 1 then 'Boleto' else 'Cartao de Credito' end as pay_method from orders",
    "schedule_slot": "select s.id * 100 + t.id as id, 2 + t.id % 5 as weekday, t.id as slot_id, "
                     "s.id as schedule_id from schedule s join time_slot t on t.id % 5 = s.id % 5",
    "student_plan": "select distinct o_custkey * 2 as student_id, l_partkey as plan_id from lineitem join orders "
                    "on l_orderkey = o_orderkey where l_linenumber = 1",
    "guardianship": "select distinct o_custkey * 2 as student_id, l_suppkey * 2 + 1 as guardian_id from lineitem "
                    "join orders on l_orderkey = o_orderkey where l_linenumber = 2",
    "teaches": "select distinct l_suppkey * 2 + 1 as instructor_id, l_partkey as class_id from lineitem",
    "qualified": "select distinct cast(substring(p_brand, 7) as int) as sport_id, t.instructor_id from teaches t "
                 "join part on p_partkey = t.class_id",
}

VIEW_ORDER = list(VIEW_SQL)


def _deps(name: str) -> set[str]:
    body = VIEW_SQL[name]
    return {v for v in VIEW_SQL if v != name and re.search(rf"\b(from|join)\s+{v}\b", body)}


def with_views(sql: str) -> str:
    """Prefix ``sql`` with the CTEs of every model view it (transitively) reads."""
    needed: set[str] = set()
    todo = [v for v in VIEW_SQL if re.search(rf"\b(from|join)\s+{v}\b", sql)]
    while todo:
        v = todo.pop()
        if v not in needed:
            needed.add(v)
            todo.extend(_deps(v))
    ctes = [f"{v} as ({VIEW_SQL[v]})" for v in VIEW_ORDER if v in needed]
    body = sql.strip()
    if not ctes:
        return body
    if own := re.match(r"(?i)with\s+(recursive\s+)?", body):
        return f"with {own[1] or ''}{', '.join(ctes)}, {body[own.end():]}"
    return f"with {', '.join(ctes)} {body}"
