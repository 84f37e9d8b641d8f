"""The six management reports (indicators, occupancy, invoice status, plan revenue, seats by category,
instructor load).

Each grouped report aggregates the large table on its key first (partial aggregation on the map side, so a
hot key costs one row per task) and joins names afterwards. Small lookups (sport, status, billing period)
are broadcast behind a row-count check. ``ordered=False`` skips the presentation sort for pipelines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roster import schema
from roster.functions import text
from roster.sources.tables import Tables

SUM_MONEY = "decimal(38,2)"


def _count(df: DataFrame):
    return df.agg(F.count(F.lit(1))).scalar()


def kpi(t: Tables) -> DataFrame:
    """One row of eight indicators, each a scalar subquery (Catalyst merges those over the same table)."""
    status = (t.dim("invoice_status", "id", "name").filter(F.col("name").isin(*text.OPEN_STATUSES))
              .select(F.col("id").alias("__status")))
    inv = t.get("invoice", "status_id")
    open_invoices = inv.join(status, F.col("status_id") == F.col("__status")).agg(F.count(F.lit(1))).scalar()
    classes = t.get("class_group", "capacity")
    seats = classes.agg(F.coalesce(F.sum("capacity"), F.lit(0)).cast("bigint")).scalar()
    return t.spark.range(1).select(
        _count(t.get("student", "person_id")).alias("students"),
        _count(t.get("instructor", "person_id")).alias("instructors"),
        _count(classes).alias("classes"),
        _count(t.get("sport", "id")).alias("sports"),
        _count(t.get("enrollment", "class_id")).alias("enrollments"),
        open_invoices.alias("open_invoices"),
        _count(t.get("plan", "id")).alias("plans"),
        seats.alias("seats"),
    )


def occupancy(t: Tables, ordered: bool = True) -> DataFrame:
    """Classes that have a sport, with capacity and the number of enrolments (duplicates counted)."""
    enrolled = (t.get("enrollment", "student_id", "class_id")
                .groupBy("class_id").agg(F.count("student_id").alias("enrolled")))
    cls = t.get("class_group", "id", "name", "capacity", "sport_id").select(
        F.col("id").alias("class_id"), F.col("name").alias("class_name"), "capacity", "sport_id")
    sport = t.dim("sport", "id", "name").select(F.col("id").alias("__sport"), F.col("name").alias("sport_name"))
    named = cls.join(sport, F.col("sport_id") == F.col("__sport")).select(
        "class_id", "class_name", "sport_name", "capacity")
    out = (named.join(enrolled, "class_id", "left")
           .select("class_id", "class_name", "sport_name", "capacity",
                   F.coalesce(F.col("enrolled"), F.lit(0)).alias("enrolled")))
    return out.orderBy(F.col("enrolled").desc(), "class_id") if ordered else out


def _money_report(facts: DataFrame, key: str, count_col: str, count_alias: str, lookup: DataFrame,
                  key_alias: str, name_alias: str, ordered: bool) -> DataFrame:
    agg = facts.groupBy(key).agg(F.count(count_col).alias(count_alias),
                                 F.sum("amount").cast(SUM_MONEY).alias("total"))
    lk = lookup.select(F.col("id").alias("__lk"), F.col("name").alias(name_alias))
    out = agg.join(lk, F.col(key) == F.col("__lk")).select(
        F.col("__lk").alias(key_alias), name_alias, count_alias, "total", text.brl("total").alias("total_brl"))
    return out.orderBy(F.col("total").desc_nulls_last(), key_alias) if ordered else out


def invoice_summary(t: Tables, ordered: bool = True) -> DataFrame:
    """Invoices per status: count, total and the total as money text. Invoices without a status drop out."""
    return _money_report(t.get("invoice", "id", "amount", "status_id"), "status_id", "id", "invoices",
                         t.dim("invoice_status", "id", "name"), "status_id", "status", ordered)


def plan_revenue(t: Tables, ordered: bool = True) -> DataFrame:
    """Plans per billing period: count, total and money text. Plans without a period drop out."""
    return _money_report(t.get("plan", "id", "amount", "period_id"), "period_id", "id", "plans",
                         t.dim("billing_period", "id", "name"), "period_id", "period", ordered)


def seats_by_category(t: Tables, ordered: bool = True) -> DataFrame:
    """Seats of classes per team flag of their sport. Grouped on the raw flag, labelled afterwards, so
    FALSE and NULL stay two rows that both read 'Individual'."""
    per_sport = (t.get("class_group", "sport_id", "capacity")
                 .groupBy("sport_id").agg(F.sum("capacity").alias("seats")))
    sport = t.dim("sport", "id", "is_team").select(F.col("id").alias("__sport"), "is_team")
    j = per_sport.join(sport, F.col("sport_id") == F.col("__sport"))
    out = (j.groupBy("is_team").agg(F.sum("seats").cast("bigint").alias("seats"))
           .select("is_team", text.category("is_team").alias("category"), "seats"))
    return out.orderBy(F.col("seats").desc_nulls_last(), F.col("is_team").asc_nulls_last()) if ordered else out


def instructor_load(t: Tables, ordered: bool = True) -> DataFrame:
    """Classes per instructor; instructors without classes are absent (inner joins)."""
    load = t.get("teaches").groupBy("instructor_id").agg(F.count("class_id").alias("classes"))
    ins = t.get("instructor", "person_id").select(F.col("person_id").alias("__ins"))
    person = t.get("person", "id", "name").select(F.col("id").alias("__pid"), F.col("name").alias("instructor"))
    j = load.join(ins, F.col("instructor_id") == F.col("__ins")).join(person, F.col("__ins") == F.col("__pid"))
    out = j.select(F.col("__pid").alias("instructor_id"), "instructor", "classes")
    return out.orderBy(F.col("classes").desc(), "instructor_id") if ordered else out


REPORTS = {
    "kpi": kpi, "occupancy": occupancy, "invoice_summary": invoice_summary, "plan_revenue": plan_revenue,
    "seats_by_category": seats_by_category, "instructor_load": instructor_load,
}

__all__ = list(REPORTS) + ["REPORTS", "schema"]
