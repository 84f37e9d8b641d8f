"""Insert (W1, W10) and update-by-key (W3) jobs over change batches.

An insert batch carries the fields of new entities without ids. Rows failing the form rules of the
reference (blank name, dates out of range, capacity below 1, unknown sport or schedule) go to ``rejected`` with a reason; the
rest get dense ids after the current maximum and are appended. A person and its role row come from the
same numbered batch, so a person can never be left without its role.

Edits follow the same form rules: rows that break one go to ``rejected`` with the reason. The others overwrite every listed
column for the keys present in the change set (a key with no row is a no-op), through a left join on the table key.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roster import schema
from roster.functions import text
from roster.operators.ids import allocate_ids
from roster.operators.quality import DATE_MAX, DATE_MIN
from roster.sources.tables import Tables

PERSON_INPUT = ("name", "tax_id", "email", "born_on")
STUDENT_INPUT = PERSON_INPUT + ("enrolled_on", "health_note")
CLASS_INPUT = ("name", "capacity", "sport_id", "schedule_id")
SPORT_INPUT = ("name", "description", "is_team")


@dataclass
class InsertResult:
    tables: Tables
    inserted: DataFrame   # new rows with their ids
    rejected: DataFrame   # input rows with a reason


def _cast_to(df: DataFrame, table_name: str, cols) -> DataFrame:
    st = schema.table(table_name).schema
    return df.select(*[F.col(c).cast(st[c].dataType).alias(c) for c in cols])


def _split(batch: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    tagged = batch.withColumn("reason", reason)
    return (tagged.filter(F.col("reason").isNull()).drop("reason"),
            tagged.filter(F.col("reason").isNotNull()))


def _person_reason(cols) -> Column:
    """Why the form of a person refuses a row; NULL if it doesn't."""
    reason = F.when(~text.non_blank("name"), F.lit("blank_name"))
    for c in ("born_on", "enrolled_on"):
        if c in cols:
            reason = reason.when(~F.col(c).cast("date").between(F.lit(DATE_MIN).cast("date"), F.lit(DATE_MAX).cast("date")),
                                 f"{c}_out_of_range")
    return reason


def _class_split(t: Tables, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Class rows that the form takes, and the others with a reason."""
    sport = t.get("sport", "id").select(F.col("id").alias("sport_id")).withColumn("__sport", F.lit(True))
    sched = t.get("schedule", "id").select(F.col("id").alias("schedule_id")).withColumn("__sched", F.lit(True))
    checked = rows.join(sport, "sport_id", "left").join(sched, "schedule_id", "left")
    reason = (F.when(~text.non_blank("name"), "blank_name")
              .when(F.coalesce(F.col("capacity") < 1, F.lit(True)), "capacity_below_1")
              .when(F.col("__sport").isNull(), "unknown_sport")
              .when(F.col("__sched").isNull(), "unknown_schedule"))
    good, rejected = _split(checked, reason)
    return good.select(*rows.columns), rejected.select(*rows.columns, "reason")


def insert_people(t: Tables, role: str, batch: DataFrame, run_date: dt.date | str | None = None) -> InsertResult:
    """New people with a role (``student`` or ``instructor``). Student defaults: health note 'Apto' and
    the enrolment date of the run (a job argument rather than the clock, so reruns agree)."""
    if role == "student":
        if run_date is None:
            raise ValueError("run_date is needed: it is the enrolment date of students without one")
        day = F.lit(str(run_date)).cast("date")
        batch = (batch.withColumn("enrolled_on", F.coalesce(F.col("enrolled_on").cast("date"), day))
                 .withColumn("health_note", F.coalesce(F.col("health_note"),
                                                       F.lit(text.DEFAULT_HEALTH_NOTE))))
        cols = STUDENT_INPUT
    elif role == "instructor":
        cols = PERSON_INPUT
    else:
        raise ValueError(f"no insert form for role {role!r}")
    role_schema = schema.table(role).schema
    typed = batch.select(*[F.col(c).cast(schema.table("person").schema[c].dataType if c in PERSON_INPUT
                                         else role_schema[c].dataType).alias(c) for c in cols])
    good, rejected = _split(typed, _person_reason(cols))
    numbered = allocate_ids(t.max_id("person"), good, list(cols))
    person_rows = numbered.select("id", *PERSON_INPUT, F.lit(None).cast("bigint").alias("phone_id"),
                                  F.lit(None).cast("int").alias("address_id"))
    role_cols = [c for c in schema.table(role).columns if c != "person_id"]
    role_rows = _cast_to(numbered.withColumnRenamed("id", "person_id"), role, ["person_id", *role_cols])
    new = t.replace(person=t.get("person").unionByName(person_rows),
                    **{role: t.get(role).unionByName(role_rows)})
    return InsertResult(new, numbered.select("id", *cols), rejected)


def insert_classes(t: Tables, batch: DataFrame) -> InsertResult:
    """New classes; a class needs a name, at least one seat, and an existing sport and schedule."""
    good, rejected = _class_split(t, _cast_to(batch, "class_group", CLASS_INPUT))
    numbered = allocate_ids(t.max_id("class_group"), good, list(CLASS_INPUT))
    rows = numbered.select("id", *CLASS_INPUT)
    return InsertResult(t.replace(class_group=t.get("class_group").unionByName(rows)), rows, rejected)


def insert_sports(t: Tables, batch: DataFrame) -> InsertResult:
    typed = _cast_to(batch, "sport", SPORT_INPUT)
    good, rejected = _split(typed, F.when(~text.non_blank("name"), F.lit("blank_name")))
    numbered = allocate_ids(t.max_id("sport"), good, list(SPORT_INPUT))
    rows = _cast_to(numbered, "sport", ["id", *SPORT_INPUT])
    return InsertResult(t.replace(sport=t.get("sport").unionByName(rows)), rows, rejected)


def update_by_key(table: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Overwrite ``columns`` (NULLs included) of the rows whose ``key`` appears in ``changes``. A key that
    appears twice fails the job: which of its rows is meant can't be told (``changelog.latest_per_key`` reduces
    a log by a given order first)."""
    once = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit(f"a {key} appears twice in the changes"))).otherwise(F.lit(True))
    ch = changes.groupBy(key).agg(*[F.any_value(c).alias(f"__new_{c}") for c in columns], once.alias("__hit"))
    j = table.join(ch, key, "left")
    out = [(F.when(F.col("__hit"), F.col(f"__new_{c}")).otherwise(F.col(c))
            .cast(table.schema[c].dataType).alias(c)) if c in columns else F.col(c) for c in table.columns]
    return j.select(*out)


@dataclass
class EditResult:
    tables: Tables
    rejected: DataFrame   # change rows with a reason


def edit_people(t: Tables, role: str, changes: DataFrame) -> EditResult:
    """The edit forms: person fields, plus the student fields for ``role == 'student'``. Keys are person ids (``id``)."""
    fields = STUDENT_INPUT if role == "student" else PERSON_INPUT
    good, rejected = _split(changes.select("id", *fields), _person_reason(fields))
    frames = {"person": update_by_key(t.get("person"), good, "id", list(PERSON_INPUT))}
    if role == "student":
        frames["student"] = update_by_key(t.get("student"), good.drop("reason").withColumnRenamed("id", "person_id"),
                                          "person_id", ["enrolled_on", "health_note"])
    return EditResult(t.replace(**frames), rejected)


def edit_classes(t: Tables, changes: DataFrame) -> EditResult:
    good, rejected = _class_split(t, _cast_to(changes, "class_group", ["id", *CLASS_INPUT]))
    return EditResult(t.replace(class_group=update_by_key(t.get("class_group"), good, "id", list(CLASS_INPUT))), rejected)


def edit_sports(t: Tables, changes: DataFrame) -> EditResult:
    good, rejected = _split(changes.select("id", *SPORT_INPUT), F.when(~text.non_blank("name"), F.lit("blank_name")))
    return EditResult(t.replace(sport=update_by_key(t.get("sport"), good, "id", list(SPORT_INPUT))), rejected)


def update_people(t: Tables, role: str, changes: DataFrame) -> Tables:
    return edit_people(t, role, changes).tables


def update_classes(t: Tables, changes: DataFrame) -> Tables:
    return edit_classes(t, changes).tables


def update_sports(t: Tables, changes: DataFrame) -> Tables:
    return edit_sports(t, changes).tables
