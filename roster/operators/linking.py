"""Link jobs: add links (W6), remove links (W5), resolve link labels to keys (W7).

* ``link`` labels every requested pair with one outcome: ``unknown_a`` / ``unknown_b`` (no parent row),
  ``exists`` (already linked; tables with a composite key) or ``added``. Requests are de-duplicated
  first, except for enrollment, whose duplicates are legal rows. Parents are joined on their unique key, so
  no request row is ever multiplied.
* ``unlink`` removes one row per request. For enrollment (no key on the pair) these are the rows with the
  smallest ids: for a pair asked for once a grouped ``min`` (a pair holding a third of all rows still costs one
  row per task), for one asked for several times the first places of the distributed dense index. They go by an anti
  join on the unique id.
* ``resolve_labels`` keeps, per label, the last pair in (name, id) order, with ``max_by`` (again partial
  aggregation, never a whole group in one task).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roster import schema
from roster.functions import text
from roster.operators.ids import allocate_ids
from roster.operators.links import LINKS, named_links
from roster.plans.indexing import dense_index
from roster.plans.partitions import hashed, spread
from roster.sources.tables import Tables


@dataclass
class LinkResult:
    tables: Tables
    table: DataFrame       # new version of the link table
    outcomes: DataFrame    # every request with its outcome (and id for enrollment)


def _parent_fk(link_table: str, column: str) -> schema.ForeignKey:
    return next(fk for fk in schema.parents_of(link_table) if fk.column == column)


def link(t: Tables, kind: str, pairs: DataFrame) -> LinkResult:
    spec = LINKS[kind]
    a, b = spec.a, spec.b
    keyed = set(schema.table(spec.table).primary_key) == {a, b}
    req = pairs.select(F.col(pairs.columns[0]).alias(a), F.col(pairs.columns[1]).alias(b))
    tasks = t.tasks(spec.table)
    out = req
    if keyed:
        # Both sides are dealt out by the pair, so this join goes first and moves neither.
        req = spread(req, tasks, a, b).distinct()
        out = req.join(t.get(spec.table, a, b).withColumn("__exists", F.lit(True)), [a, b], "left")
    for col, flag in ((a, "__has_a"), (b, "__has_b")):
        fk = _parent_fk(spec.table, col)
        parent = t.get(fk.parent, fk.parent_column).select(F.col(fk.parent_column).alias(col)) \
                  .withColumn(flag, F.lit(True))
        out = out.join(hashed(parent, tasks), col, "left")
    outcome = (F.when(F.col("__has_a").isNull(), "unknown_a")
               .when(F.col("__has_b").isNull(), "unknown_b"))
    if keyed:
        outcome = outcome.when(F.col("__exists"), "exists")
    out = out.withColumn("outcome", outcome.otherwise("added")).select(a, b, "outcome")
    added = out.filter(F.col("outcome") == "added").select(a, b)
    if keyed:
        new_table = t.get(spec.table).unionByName(added)
        outcomes = out
    else:
        # Enrollment rows carry a generated id (AUTO_INCREMENT in the reference).
        numbered = allocate_ids(t.high_water(spec.table), added, [a, b])
        new_table = t.get(spec.table).unionByName(numbered.select("id", a, b))
        outcomes = (numbered.select("id", a, b, F.lit("added").alias("outcome"))
                    .unionByName(out.filter(F.col("outcome") != "added")
                                 .select(F.lit(None).cast("bigint").alias("id"), a, b, "outcome")))
    return LinkResult(t.replace(**{spec.table: new_table}), new_table, outcomes)


def unlink(t: Tables, kind: str, pairs: DataFrame) -> LinkResult:
    spec = LINKS[kind]
    a, b = spec.a, spec.b
    req = pairs.select(F.col(pairs.columns[0]).alias(a), F.col(pairs.columns[1]).alias(b))
    current = t.get(spec.table)
    keyed = set(schema.table(spec.table).primary_key) == {a, b}
    # Copies of a pair can be many where the pair is no key: those joins are left to Spark's exchange.
    asked = spread(req, t.tasks(spec.table) if keyed else 0, a, b).groupBy(a, b).agg(F.count(F.lit(1)).alias("asked"))
    if keyed:
        held = current.select(a, b).withColumn("held", F.lit(1).cast("bigint"))
        new_table = current.join(asked.select(a, b), [a, b], "left_anti")
    else:
        # As many copies go as are asked for, those with the smallest ids. Pairs asked for once lose their smallest id, an
        # aggregate. The copies of the others are numbered across tasks, and a copy's place is its number less the pair's first.
        copies = current.select("id", a, b).join(asked, [a, b])
        held = copies.groupBy(a, b).agg(F.count(F.lit(1)).alias("held"))
        gone = copies.filter("asked = 1").groupBy(a, b).agg(F.min("id").alias("id")).select("id")
        several = copies.filter("asked > 1")
        if not several.isEmpty():
            placed = dense_index(several, [a, b, "id"], id_col="place")
            first = placed.groupBy(a, b).agg(F.min("place").alias("first"))
            gone = gone.unionByName(placed.join(first, [a, b]).filter("place - first < asked").select("id"))
        new_table = current.join(gone, "id", "left_anti")
    outcome = F.when(F.col("turn") <= F.coalesce("held", F.lit(0)), "removed").otherwise("not_found")
    outcomes = (asked.join(held, [a, b], "left").withColumn("turn", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("asked"))))
                .select(a, b, outcome.alias("outcome")))
    return LinkResult(t.replace(**{spec.table: new_table}), new_table, outcomes)


def resolve_labels(t: Tables, kind: str) -> DataFrame:
    """label -> (a, b) of the last row in (a's name, row id) order; for tables without a row id, the pair
    itself is the tie-break."""
    tasks = t.tasks(LINKS[kind].table)
    if kind == "enrollment":
        ids = t.get("enrollment", "id", "student_id", "class_id")
        spec = LINKS[kind]
        pa = t.get("person", "id", "name").select(F.col("id").alias("_pa"), F.col("name").alias("a_name"))
        cl = t.get("class_group", "id", "name").select(F.col("id").alias("_pb"), F.col("name").alias("b_name"))
        named = (ids.join(hashed(pa, tasks), F.col(spec.a) == F.col("_pa")).join(hashed(cl, tasks), F.col(spec.b) == F.col("_pb"))
                 .select(F.col(spec.a).alias("a"), F.col(spec.b).alias("b"), "a_name", "id",
                         text.link_label(kind, "a_name", "b_name").alias("label")))
        order = F.struct("a_name", "id")
    else:
        named = named_links(t, kind)
        order = F.struct("a_name", "a", "b")
    if tasks:
        # Texts are aggregated by sorting. Each of so many even parts keeps the last pair of its labels, and only those are
        # dealt out by label: a hot label costs one row a part.
        part = F.pmod(F.xxhash64(*named.columns), F.lit(tasks)).cast("int")
        best = (named.withColumn("part", part).repartitionById(tasks, "part").groupBy("part", "label")
                .agg(F.max_by(F.struct(*named.columns), order).alias("r")))
        named = spread(best.select("r.*"), tasks, "label")
    picked = named.groupBy("label").agg(F.max_by(F.struct("a", "b"), order).alias("p"))
    return picked.select("label", "p.a", "p.b")
