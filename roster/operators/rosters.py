"""Rosters, selection labels and key lookups.

Lookups take their keys as a DataFrame (a batch of requested ids, joined with ``left_semi`` so duplicate
requests never multiply rows) or as a list of ids (pushed down to the scan as an ``IN`` filter).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roster.functions import text
from roster.sources.tables import Tables

PERSON_FIELDS = ("id", "name", "tax_id", "email", "born_on")
ROLE_TABLES = ("student", "instructor", "guardian")
NAMED_TABLES = ("class_group", "sport", "plan", "schedule")


def _role_people(t: Tables, role: str, person_cols=PERSON_FIELDS, role_cols=()) -> DataFrame:
    r = t.get(role, "person_id", *role_cols)
    p = t.get("person", *person_cols)
    return r.join(p, F.col("person_id") == F.col("id")).select(*person_cols, *role_cols)


def student_roster(t: Tables, ordered: bool = True) -> DataFrame:
    j = _role_people(t, "student", role_cols=("enrolled_on", "health_note"))
    out = j.select("id", "name", "tax_id", "email", text.br_date("born_on").alias("born_on"),
                   text.br_date("enrolled_on").alias("enrolled_on"), "health_note")
    return out.orderBy("id") if ordered else out


def instructor_roster(t: Tables, ordered: bool = True) -> DataFrame:
    j = _role_people(t, "instructor")
    out = j.select("id", "name", "tax_id", "email", text.br_date("born_on").alias("born_on"))
    return out.orderBy("id") if ordered else out


def class_roster(t: Tables, ordered: bool = True) -> DataFrame:
    """Every class, with its sport and schedule names (NULL when missing: left joins)."""
    cls = t.get("class_group", "id", "name", "capacity", "sport_id", "schedule_id")
    sport = t.dim("sport", "id", "name").withColumnRenamed("id", "s_id").withColumnRenamed("name", "sport")
    sched = t.dim("schedule", "id", "name").withColumnRenamed("id", "h_id").withColumnRenamed("name", "schedule")
    j = (cls.join(sport, F.col("sport_id") == F.col("s_id"), "left")
         .join(sched, F.col("schedule_id") == F.col("h_id"), "left"))
    out = j.select("id", "name", "capacity", "sport", "schedule")
    return out.orderBy("id") if ordered else out


def sport_roster(t: Tables, ordered: bool = True) -> DataFrame:
    s = t.get("sport", "id", "name", "description", "is_team")
    out = s.select("id", "name", "description", text.category("is_team").alias("category"))
    return out.orderBy("id") if ordered else out


def name_order(col: str, collation: str | None = None):
    """Sort key for a name: binary order by default (as DuckDB), or a Spark collation such as
    'UNICODE_CI_AI' for the case- and accent-insensitive order of the source database."""
    c = F.collate(F.col(col), collation) if collation else F.col(col)
    return c.asc_nulls_first()


def labels(t: Tables, kind: str, ordered: bool = True, collation: str | None = None) -> DataFrame:
    """'<id> - <name>' selection labels, by name. ``kind`` is a role (student, instructor, guardian) or a
    named table (class_group, sport, plan, schedule)."""
    if kind in ROLE_TABLES:
        base = _role_people(t, kind, person_cols=("id", "name"))
    elif kind in NAMED_TABLES:
        base = t.get(kind, "id", "name")
    else:
        raise ValueError(f"no labels for {kind!r}")
    out = base.select("id", text.label("id", "name").alias("label"), "name")
    if ordered:
        out = out.orderBy(name_order("name", collation), "id")
    return out.select("id", "label")


def _keyed(df: DataFrame, key: str, keys: DataFrame | Iterable[int]) -> DataFrame:
    if isinstance(keys, DataFrame):
        k = keys.select(F.col(keys.columns[0]).alias(key))
        return df.join(k, key, "left_semi")
    return df.filter(F.col(key).isin(list(keys)))


def lookup_student(t: Tables, keys: DataFrame | Iterable[int]) -> DataFrame:
    """Editable fields of the requested students (person joined with its student row)."""
    s = t.get("student", "person_id", "enrolled_on", "health_note")
    p = t.get("person", *PERSON_FIELDS)
    j = s.join(p, F.col("person_id") == F.col("id")).select("id", "name", "tax_id", "email", "born_on",
                                                            "enrolled_on", "health_note")
    return _keyed(j, "id", keys)


def lookup_instructor(t: Tables, keys: DataFrame | Iterable[int]) -> DataFrame:
    """Editable fields of the requested people; like the reference, the instructor role is not checked."""
    return _keyed(t.get("person", *PERSON_FIELDS), "id", keys)


def lookup_class(t: Tables, keys: DataFrame | Iterable[int]) -> DataFrame:
    return _keyed(t.get("class_group", "id", "name", "capacity", "sport_id", "schedule_id"), "id", keys)


def lookup_sport(t: Tables, keys: DataFrame | Iterable[int]) -> DataFrame:
    return _keyed(t.get("sport", "id", "name", "description", "is_team"), "id", keys)


def lookup_one(t: Tables, kind: str, ident: int) -> DataFrame:
    """One record's editable fields; the id travels as a named parameter of a fixed statement."""
    everyone = {
        "student": lambda: _role_people(t, "student", role_cols=("enrolled_on", "health_note")),
        "instructor": lambda: t.get("person", *PERSON_FIELDS),
        "class_group": lambda: t.get("class_group", "id", "name", "capacity", "sport_id", "schedule_id"),
        "sport": lambda: t.get("sport", "id", "name", "description", "is_team"),
    }
    return t.spark.sql("FROM {records} |> WHERE id <=> :wanted", args={"wanted": ident}, records=everyone[kind]())
