"""The 23 model tables derived from the star-schema test data (region, nation, customer, supplier, part,
orders, lineitem, events). The mapping is the fixture specification; every view is a plain DataFrame
expression, so Catalyst prunes columns and pushes filters down to the Parquet scans.

Scale notes: the large views (person, student, enrollment, teaches, guardianship, student_plan, session)
are scans, joins and aggregates that partition on their keys. Derived dimensions (sport, schedule,
billing_period) are broadcast only behind a row-count check. The enrollment id uses the distributed
dense index, and only when the id column is requested.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roster import schema
from roster.plans import broadcast as bc
from roster.plans.indexing import dense_index
from roster.plans.partitions import kept_tasks, spread
from roster.sources.tables import Tables

SOURCE_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}

# Fixed values of the fixture mapping: status names (ids 1-5), the days of each billing period id,
# and the person e-mail domain.
STATUS_NAMES = [(1, "Paga"), (2, "Pendente"), (3, "Atrasada"), (4, "Cancelada"), (5, "Isenta")]
PERIOD_DAYS = {1: 30, 2: 60, 3: 90, 4: 180}
PERIOD_DAYS_OTHER = 365
EMAIL_DOMAIN = "@example.org"
BIRTH_BASE = "1960-01-01"


#: The source tables each model table is derived from.
DERIVED_FROM = {
    "phone": ("customer",), "address": ("nation", "region"), "billing_period": ("orders",), "invoice_status": (),
    "sport": ("part",), "schedule": ("part",), "time_slot": ("events",), "person": ("customer", "supplier"),
    "guardian": ("supplier",), "instructor": ("supplier",), "student": ("customer", "orders"), "class_group": ("part",),
    "session": ("events",), "enrollment": ("lineitem", "orders"), "attendance": ("events",), "plan": ("part",),
    "invoice": ("orders",), "schedule_slot": ("part", "events"), "student_plan": ("lineitem", "orders"),
    "cancellation": ("events",), "guardianship": ("lineitem", "orders"), "teaches": ("lineitem",), "qualified": ("lineitem", "part"),
}

#: The source table whose rows bound those of a model table; the small ones are left out.
SIZED_BY = {
    "phone": "customer", "person": "customer", "student": "customer", "class_group": "part", "plan": "part", "session": "events",
    "attendance": "events", "cancellation": "events", "invoice": "orders", "enrollment": "lineitem", "student_plan": "lineitem",
    "guardianship": "lineitem", "teaches": "lineitem",
}


def read_source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SOURCE_SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _case(col, mapping: dict, other):
    expr = None
    for k, v in mapping.items():
        expr = (F.when(col == k, F.lit(v)) if expr is None else expr.when(col == k, F.lit(v)))
    return expr.otherwise(F.lit(other))


def _brand_no(col="p_brand"):
    return F.expr(f"substring({col}, 7)").cast("int")


def _typed(df: DataFrame, name: str) -> DataFrame:
    """Project to the registry schema (names, order, types) of ``name``."""
    return df.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.table(name).schema.fields])


def star_schema_tables(spark: SparkSession, sf_dir: str) -> Tables:
    src = lru_cache(maxsize=None)(lambda name: read_source(spark, sf_dir, name))
    holder: dict[str, Tables] = {}
    # Parquet keeps row counts in its footers.
    rows = lru_cache(maxsize=None)(lambda name: src(name).count())

    def lines() -> int:
        return kept_tasks(spark, rows("lineitem"))

    def t() -> Tables:
        return holder["tables"]

    def phone(cols):
        c = src("customer")
        return _typed(c.select(F.col("c_custkey").alias("id"),
                               F.concat(F.lit("27"), F.lpad(F.col("c_custkey").cast("string"), 9, "0"))
                               .alias("phone")), "phone")

    def address(cols):
        n, r = src("nation"), src("region")
        j = n.join(r, F.col("n_regionkey") == F.col("r_regionkey"))
        return _typed(j.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("street"),
                               F.col("r_name").alias("district"), F.col("n_name").alias("city"),
                               F.lit(None).cast("string").alias("complement")), "address")

    def billing_period(cols):
        names = src("orders").select(F.col("o_orderpriority").alias("name")).distinct()
        pid = F.substring("name", 1, 1).cast("int")
        return _typed(names.select(pid.alias("id"), "name", _case(pid, PERIOD_DAYS, PERIOD_DAYS_OTHER).alias("days")),
                      "billing_period")

    def invoice_status(cols):
        return spark.createDataFrame(STATUS_NAMES, schema.table("invoice_status").schema)

    def sport(cols):
        brands = src("part").select("p_brand").distinct()
        sid = _brand_no()
        team = F.when(sid % 3 == 0, F.lit(True)).when(sid % 3 == 1, F.lit(False))
        return _typed(brands.select(sid.alias("id"), F.col("p_brand").alias("name"),
                                    F.lit(None).cast("string").alias("description"), team.alias("is_team")), "sport")

    def schedule(cols):
        names = src("part").select(F.col("p_type").alias("name")).distinct()
        return _typed(dense_index(names, ["name"]), "schedule")

    def time_slot(cols):
        hours = src("events").select(F.hour("ts").alias("h")).distinct()
        hh = lambda c: F.concat(F.lpad(c.cast("string"), 2, "0"), F.lit(":00:00"))
        return _typed(hours.select((F.col("h") + 1).alias("id"), hh(F.col("h")).alias("starts_at"),
                                   hh(F.col("h") + 1).alias("ends_at")), "time_slot")

    def person(cols):
        base = F.to_date(F.lit(BIRTH_BASE))
        c = src("customer")
        k = F.col("c_custkey")
        cust = c.select((k * 2).alias("id"), F.col("c_name").alias("name"),
                        F.lpad(k.cast("string"), 11, "0").alias("tax_id"),
                        F.concat(F.lit("c"), k.cast("string"), F.lit(EMAIL_DOMAIN)).alias("email"),
                        F.date_add(base, (k % 15000).cast("int")).alias("born_on"),
                        F.when(k % 10 == 0, F.lit(None)).otherwise(k).alias("phone_id"),
                        F.col("c_nationkey").alias("address_id"))
        s = src("supplier")
        k = F.col("s_suppkey")
        supp = s.select((k * 2 + 1).alias("id"), F.col("s_name").alias("name"),
                        F.lpad(k.cast("string"), 11, "9").alias("tax_id"),
                        F.concat(F.lit("s"), k.cast("string"), F.lit(EMAIL_DOMAIN)).alias("email"),
                        F.date_add(base, (k % 15000).cast("int")).alias("born_on"),
                        F.lit(None).cast("bigint").alias("phone_id"),
                        F.col("s_nationkey").alias("address_id"))
        return _typed(cust.unionByName(supp), "person")

    def _supplier_role(name):
        return lambda cols: _typed(src("supplier").select((F.col("s_suppkey") * 2 + 1).alias("person_id")), name)

    def student(cols):
        # Aggregate orders per customer before the join; both sides end up hash-partitioned on the
        # customer key, so the join adds no further shuffle.
        first = src("orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("first_order"))
        cust = src("customer").groupBy("c_custkey").agg(F.min("c_mktsegment").alias("health_note"))
        j = cust.join(first, F.col("c_custkey") == F.col("o_custkey"), "left")
        return _typed(j.select((F.col("c_custkey") * 2).alias("person_id"),
                               F.col("first_order").cast("date").alias("enrolled_on"), "health_note"), "student")

    def class_group(cols):
        p = src("part")
        sid = F.when((F.col("p_partkey") % 50 == 0) | (F.col("p_brand") == "Brand#25"), F.lit(None)) \
               .otherwise(_brand_no())
        own = [F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_size").alias("capacity"),
               sid.alias("sport_id")]
        if cols is not None and "schedule_id" not in cols:
            # Every type has a schedule, so without its number only parts without a type drop out.
            typed = p.filter(F.col("p_type").isNotNull())
            return _typed(typed.select(*own, F.lit(None).alias("schedule_id")), "class_group")
        sched = t().dim("schedule", "id", "name").select(F.col("id").alias("__sched"),
                                                          F.col("name").alias("__sched_name"))
        j = p.join(sched, F.col("__sched_name") == F.col("p_type"))
        return _typed(j.select(*own, F.col("__sched").alias("schedule_id")), "class_group")

    def session(cols):
        e = src("events")
        return _typed(e.select(F.col("event_id").alias("id"), F.col("ts").cast("date").alias("held_on"),
                               (F.col("event_type") != "error").alias("was_held"),
                               F.col("user_id").alias("class_id")), "session")

    def attendance(cols):
        e = src("events")
        return _typed(e.select(F.col("event_id").alias("id"),
                               F.col("event_type").isin("view", "click").alias("present")), "attendance")

    def cancellation(cols):
        e = src("events").filter(F.col("event_type") == "error")
        return _typed(e.select(F.col("event_id").alias("id"), F.col("props").alias("reason")), "cancellation")

    def _line_orders(line_filter=None):
        li = src("lineitem")
        if line_filter is not None:
            li = li.filter(line_filter)
        return li.join(spread(src("orders"), lines(), "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))

    def _distinct_pairs(pairs, name):
        # Nearly every line has a pair of its own, so little is lost by dealing them out before they are made distinct.
        return _typed(spread(pairs, lines(), *pairs.columns).distinct(), name)

    def enrollment(cols):
        pairs = _line_orders().select((F.col("o_custkey") * 2).alias("student_id"),
                                      F.col("l_partkey").alias("class_id"),
                                      "o_custkey", "l_orderkey", "l_linenumber")
        if cols is not None and "id" not in cols:
            return pairs.select(F.lit(None).cast("bigint").alias("id"), "student_id", "class_id")
        # Order (customer, part) fixes both output columns; order key and line number only refine it so
        # the range partitioner can split a hot customer over several partitions.
        numbered = dense_index(pairs, ["o_custkey", "class_id"], tiebreak=["l_orderkey", "l_linenumber"],
                               num_partitions=lines() or None)
        return _typed(numbered, "enrollment")

    def plan(cols):
        p = src("part")
        period = F.when(F.col("p_partkey") % 40 == 0, F.lit(None)).otherwise(F.col("p_size") % 5 + 1)
        return _typed(p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"),
                               F.col("p_retailprice").cast(schema.MONEY).alias("amount"),
                               period.alias("period_id"), F.col("p_type").alias("description")), "plan")

    def invoice(cols):
        o = src("orders")
        k, st = F.col("o_orderkey"), F.col("o_orderstatus")
        day = F.col("o_orderdate").cast("date")
        status = F.when(k % 100 == 0, F.lit(None)).when(st == "F", 1).when(st == "O", 2).otherwise(3)
        method = F.when(k % 3 == 0, "PIX").when(k % 3 == 1, "Boleto").otherwise("Cartao de Credito")
        return _typed(o.select(k.alias("id"), F.col("o_totalprice").cast(schema.MONEY).alias("amount"),
                               day.alias("due_on"), F.when(st == "F", day).alias("paid_on"),
                               status.alias("status_id"), method.alias("pay_method")), "invoice")

    def schedule_slot(cols):
        s = t().dim("schedule", "id").withColumn("k", F.col("id") % 5)
        # time_slot holds one row per hour of the day (at most 25 with NULL): fixed bound.
        ts = bc.fixed(t().get("time_slot", "id").withColumnRenamed("id", "slot").withColumn("k", F.col("slot") % 5))
        j = s.join(ts, "k")
        return _typed(j.select((F.col("id") * 100 + F.col("slot")).alias("id"),
                               (2 + F.col("slot") % 5).alias("weekday"), F.col("slot").alias("slot_id"),
                               F.col("id").alias("schedule_id")), "schedule_slot")

    def student_plan(cols):
        j = _line_orders(F.col("l_linenumber") == 1)
        return _distinct_pairs(j.select((F.col("o_custkey") * 2).alias("student_id"), F.col("l_partkey").alias("plan_id")), "student_plan")

    def guardianship(cols):
        j = _line_orders(F.col("l_linenumber") == 2)
        return _distinct_pairs(j.select((F.col("o_custkey") * 2).alias("student_id"),
                                        (F.col("l_suppkey") * 2 + 1).alias("guardian_id")), "guardianship")

    def teaches(cols):
        li = src("lineitem")
        return _distinct_pairs(li.select((F.col("l_suppkey") * 2 + 1).alias("instructor_id"), F.col("l_partkey").alias("class_id")), "teaches")

    def qualified(cols):
        # The pairs are distinct at the end; making those of ``teaches`` distinct first would only add an exchange of its size.
        li, p = src("lineitem").select("l_suppkey", "l_partkey"), src("part").select("p_partkey", "p_brand")
        j = li.join(p, F.col("l_partkey") == F.col("p_partkey"))
        return _typed(j.select(_brand_no().alias("sport_id"), (F.col("l_suppkey") * 2 + 1).alias("instructor_id")).distinct(), "qualified")

    builders = {
        "phone": phone, "address": address, "billing_period": billing_period, "invoice_status": invoice_status,
        "sport": sport, "schedule": schedule, "time_slot": time_slot, "person": person,
        "guardian": _supplier_role("guardian"), "instructor": _supplier_role("instructor"), "student": student,
        "class_group": class_group, "session": session, "enrollment": enrollment, "attendance": attendance,
        "plan": plan, "invoice": invoice, "schedule_slot": schedule_slot, "student_plan": student_plan,
        "cancellation": cancellation, "guardianship": guardianship, "teaches": teaches, "qualified": qualified,
    }
    sources = {name: (lambda name=name: src(name)) for name in SOURCE_SCHEMAS}
    # Enrollment ids are row numbers 1..n, so the largest id is the row count: no numbering needed.
    max_ids = {"enrollment": lambda: t().get("enrollment", "class_id").agg(F.count(F.lit(1)).cast("bigint")).scalar()}
    holder["tables"] = Tables(spark, builders, sources, origin=sf_dir, max_ids=max_ids,
                              projection_aware={"enrollment", "class_group"},
                              lineage={n: [f"{sf_dir}/{s}.parquet" for s in own] for n, own in DERIVED_FROM.items()},
                              sizes={n: (lambda s=s: rows(s)) for n, s in SIZED_BY.items()},
                              dealt={"student_plan", "guardianship", "teaches"})
    return holder["tables"]
