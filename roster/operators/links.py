"""Link listings: each row of a link table with both ends named ('<a> na turma <b>' and friends).

One generic job with five specs. The link table is the large side; each end is joined on its key (shuffle
joins that AQE splits when one key is hot, or broadcasts when the other side is small).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roster.functions import text
from roster.plans.partitions import hashed
from roster.sources.tables import Tables


@dataclass(frozen=True)
class LinkSpec:
    table: str
    a: str            # link column shown first (always a person)
    b: str            # second link column
    b_table: str      # table named by b
    b_key: str = "id"


LINKS = {
    "enrollment": LinkSpec("enrollment", "student_id", "class_id", "class_group"),
    "teaches": LinkSpec("teaches", "instructor_id", "class_id", "class_group"),
    "qualified": LinkSpec("qualified", "instructor_id", "sport_id", "sport"),
    "guardianship": LinkSpec("guardianship", "student_id", "guardian_id", "person"),
    "student_plan": LinkSpec("student_plan", "student_id", "plan_id", "plan"),
}


def named_links(t: Tables, kind: str) -> DataFrame:
    """(a, b, a_name, label) for every row of the link table, duplicates kept."""
    spec = LINKS[kind]
    link = t.get(spec.table, spec.a, spec.b)
    pa = t.get("person", "id", "name").select(F.col("id").alias("_pa"), F.col("name").alias("a_name"))
    pb_src = t.dim(spec.b_table, spec.b_key, "name") if spec.b_table == "sport" else t.get(spec.b_table, spec.b_key, "name")
    pb = pb_src.select(F.col(spec.b_key).alias("_pb"), F.col("name").alias("b_name"))
    tasks = t.tasks(spec.table)
    # Links are many a person and a class: hashing those leaves the links unsorted.
    pb = pb if spec.b_table == "sport" else hashed(pb, tasks)
    j = link.join(hashed(pa, tasks), F.col(spec.a) == F.col("_pa")).join(pb, F.col(spec.b) == F.col("_pb"))
    return j.select(F.col(spec.a).alias("a"), F.col(spec.b).alias("b"), "a_name",
                    text.link_label(kind, "a_name", "b_name").alias("label"))


def links(t: Tables, kind: str, ordered: bool = True, collation: str | None = None) -> DataFrame:
    out = named_links(t, kind)
    if ordered:
        c = F.collate(F.col("a_name"), collation) if collation else F.col("a_name")
        out = out.orderBy(c.asc_nulls_first(), "a", "b")
    return out.select("a", "b", "label")
