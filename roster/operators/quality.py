"""Data validation (W9): the key, reference and domain rules of the model, checked over whole tables.

Each check gives (``rule, table_name, column_name, n_bad``), all unioned into one report:

* ``pk_duplicate``: key values held by more than one row (grouped count, partial aggregation);
  ``pk_null``: rows with a NULL key column;
* ``fk_orphan``: child rows whose non-NULL reference has no parent row (one tagged union over all tables, see below);
* ``blank_name``, ``capacity_below_1`` (or NULL), ``missing_parent`` (a class without sport or schedule), ``date_out_of_range`` (1900-01-01 to 2100-12-31, the form bounds)
  and ``too_long`` (declared text widths).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roster import schema
from roster.functions import text
from roster.plans.partitions import spread
from roster.sources.tables import Tables

# The date bounds of the reference forms.
DATE_MIN = "1900-01-01"
DATE_MAX = "2100-12-31"
DATE_COLUMNS = (("person", "born_on"), ("student", "enrolled_on"))
NAMED_FORMS = ("person", "class_group", "sport")
# A class can't be saved without these.
REQUIRED_PARENTS = ("sport_id", "schedule_id")


def _row(rule: str, table: str, column: str | None, counted: DataFrame) -> DataFrame:
    return counted.select(F.lit(rule).alias("rule"), F.lit(table).alias("table_name"),
                          F.lit(column).cast("string").alias("column_name"), F.col("n_bad").cast("bigint"))


def check_keys(t: Tables) -> DataFrame:
    parts = []
    for name in t.names():
        pk = list(schema.table(name).primary_key)
        # One grouped pass gives both checks: key values held by several rows, and rows whose key has a NULL.
        keys = t.get(name, *pk) if name in t.dealt else spread(t.get(name, *pk), t.tasks(name), *pk)
        groups = keys.groupBy(*pk).agg(F.count(F.lit(1)).alias("c"))
        has_null = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in pk])
        both = groups.agg(F.count(F.when(F.col("c") > 1, F.lit(1))).alias("pk_duplicate"),
                          F.coalesce(F.sum(F.when(has_null, F.col("c"))), F.lit(0)).alias("pk_null"))
        long = both.unpivot([], ["pk_duplicate", "pk_null"], "rule", "n_bad")
        parts.append(long.select("rule", F.lit(name).alias("table_name"),
                                 F.lit(",".join(pk)).alias("column_name"), F.col("n_bad").cast("bigint")))
    return reduce(DataFrame.unionByName, parts)


def check_references(t: Tables) -> DataFrame:
    """All references in one exchange. Every table is read once and emits, by its keys and references, (parent table, key,
    slot): slot -1 says that the parent has the key, any other that an edge into the parent refers to it. One aggregate
    over (parent, key) adds them up, map-side first, so a hot key costs one row a task; keys without a parent row are left."""
    edges = [fk for fk in schema.FOREIGN_KEYS if fk.child in t and fk.parent in t]
    number = {name: i for i, name in enumerate(dict.fromkeys(fk.parent for fk in edges))}
    slot = {fk: [e for e in edges if e.parent == fk.parent].index(fk) for fk in edges}
    tagged = []
    for name in t.names():
        entries = [(fk.column, number[fk.parent], slot[fk]) for fk in edges if fk.child == name]
        entries += [(c, number[name], -1) for c in dict.fromkeys(fk.parent_column for fk in edges if fk.parent == name)]
        if entries:
            rows = F.array(*[F.struct(F.lit(p).alias("parent"), F.col(c).cast("bigint").alias("key"), F.lit(i).alias("slot"))
                             for c, p, i in entries])
            tagged.append(t.get(name, *dict.fromkeys(c for c, _, _ in entries)).select(F.inline(rows)).filter(F.col("key").isNotNull()))
    if not tagged:
        return _row("fk_orphan", "", None, t.spark.range(0).select(F.lit(0).alias("n_bad")))
    slots = range(max(slot.values()) + 1)
    keys = reduce(DataFrame.unionByName, tagged).groupBy("parent", "key").agg(
        F.max(F.col("slot") == -1).alias("present"), *[F.count_if(F.col("slot") == i).alias(f"n{i}") for i in slots])
    missing = keys.filter(~F.col("present")).agg(
        *[F.coalesce(F.sum(F.when(F.col("parent") == number[fk.parent], F.col(f"n{slot[fk]}"))), F.lit(0)).alias(f"e{i}")
          for i, fk in enumerate(edges)])
    return missing.select(F.inline(F.array(*[
        F.struct(F.lit("fk_orphan").alias("rule"), F.lit(fk.child).alias("table_name"), F.lit(fk.column).alias("column_name"),
                 F.col(f"e{i}").alias("n_bad")) for i, fk in enumerate(edges)])))


def domain_rules(name: str) -> dict[tuple[str, str], Column]:
    """(rule, column) -> the condition of a bad row, for one table."""
    rules: dict[tuple[str, str], Column] = {}
    if name in NAMED_FORMS:
        rules["blank_name", "name"] = ~text.non_blank("name")
    if name == "class_group":
        rules["capacity_below_1", "capacity"] = ~F.coalesce(F.col("capacity") >= 1, F.lit(False))
        for c in REQUIRED_PARENTS:
            rules["missing_parent", c] = F.col(c).isNull()
    for table, c in DATE_COLUMNS:
        if table == name:
            rules["date_out_of_range", c] = ~F.col(c).between(F.lit(DATE_MIN).cast("date"), F.lit(DATE_MAX).cast("date"))
    for c, width in schema.table(name).max_lengths.items():
        rules["too_long", c] = F.length(c) > width
    return rules


def check_domains(t: Tables) -> DataFrame:
    """All rules of a table in one pass: one aggregate with a count a rule, unpivoted to rows."""
    parts = []
    for name in t.names():
        rules = domain_rules(name)
        if not rules:
            continue
        counted = t.get(name, *dict.fromkeys(c for _, c in rules)).agg(
            *[F.count(F.when(bad, F.lit(1))).alias(f"{rule}:{c}") for (rule, c), bad in rules.items()])
        rows = counted.unpivot([], [f"{rule}:{c}" for rule, c in rules], "what", "n_bad")
        parts.append(rows.select(F.split_part("what", F.lit(":"), F.lit(1)).alias("rule"), F.lit(name).alias("table_name"),
                                 F.split_part("what", F.lit(":"), F.lit(2)).alias("column_name"), F.col("n_bad").cast("bigint")))
    return reduce(DataFrame.unionByName, parts)


def validate(t: Tables) -> DataFrame:
    return check_keys(t).unionByName(check_references(t)).unionByName(check_domains(t))
