"""Jobs over stored state against recomputation: references, batch checks, id marks, report deltas, explained deletes, the load
journal, balanced reads, positions, and the form rules of edits."""

from __future__ import annotations

import os
import random
import sys
from collections import Counter

import pytest
from pyspark.sql import functions as F

from roster import schema
from roster.operators import batch_checks, cascade, changes, counts, ids, linking, quality, reports
from roster.operators.batch_checks import Batch
from roster.operators.report_state import ReportState, delta
from roster.plans import broadcast
from roster.plans.ordering import collated, in_order
from roster.sources import files, jdbc, parquet


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def counted(report):
    return {(r.rule, r.table_name, r.column_name): r.n_bad for r in report.collect()}


# ---------------------------------------------------------------- W9 references in one exchange

def orphans(t):
    """By anti joins, edge by edge."""
    out = {}
    for fk in schema.FOREIGN_KEYS:
        parent = t.get(fk.parent, fk.parent_column).select(F.col(fk.parent_column).alias(fk.column))
        out["fk_orphan", fk.child, fk.column] = t.get(fk.child, fk.column).filter(F.col(fk.column).isNotNull()).join(
            parent, fk.column, "left_anti").count()
    return out


def test_references_equal_anti_joins(spark, seed):
    bad = seed.replace(
        enrollment=seed.get("enrollment").unionByName(spark.createDataFrame([(90, 1, 99), (91, 98, 99), (92, None, 3)], seed.get("enrollment").schema)),
        person=seed.get("person").filter("id <> 6"), sport=seed.get("sport").limit(0))
    found = counted(quality.check_references(bad))
    assert found == orphans(bad) and sum(found.values()) > 8
    assert set(counted(quality.check_references(seed)).values()) == {0}


def test_references_take_one_exchange_and_read_each_table_once(star001):
    plan = quality.check_references(star001)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" not in plan
    # Two grouped steps: by (parent, key), and all together; the other aggregates make the model's views.
    assert plan.count("Generate inline") >= 20 and plan.count("Aggregate [parent#") == 1


# ---------------------------------------------------------------- W9 for a batch

def after(t, batches):
    frames = {}
    for name, b in batches.items():
        pk = list(schema.table(name).primary_key)
        rows, base = t.get(name), t.get(name, *pk)
        for df in (b.deletes, b.updates):
            if df is not None:
                rows = rows.join(df.select(*pk), pk, "left_anti")
        if b.updates is not None:
            come = b.updates.join(base, pk, "left_semi")
            rows = rows.unionByName(come.join(b.deletes.select(*pk), pk, "left_anti") if b.deletes is not None else come)
        frames[name] = rows.unionByName(b.inserts) if b.inserts is not None else rows
    return t.replace(**frames)


def batches_of_seed(spark, seed):
    def frame(name, rows):
        return spark.createDataFrame(rows, seed.get(name).schema)

    person = seed.get("person").filter("id IN (2, 3)").withColumn("name", F.lit("\t")).unionByName(
        frame("person", [(777, "no row", None, None, None, None, None)]))
    return {
        "person": Batch(updates=person, deletes=spark.createDataFrame([(6,), (3,), (12345,)], "id long"),
                        inserts=frame("person", [(20, "x" * 200, None, None, None, 4444, 2), (1, "twice", None, None, None, None, None),
                                                 (None, "no id", None, None, None, None, None)])),
        "class_group": Batch(updates=seed.get("class_group").filter("id < 3").withColumn("sport_id", F.lit(50)).withColumn("capacity", F.lit(0)),
                             deletes=spark.createDataFrame([(4,)], "id long")),
        "teaches": Batch(inserts=frame("teaches", [(6, 1), (99, 1), (7, 88)]), deletes=seed.get("teaches").limit(1)),
        "enrollment": Batch(deletes=spark.createDataFrame([(1,)], "id long"), inserts=frame("enrollment", [(50, 6, 4), (50, 1, 1)])),
    }


@pytest.mark.parametrize("names", [("person",), ("class_group", "teaches"), ("person", "class_group", "teaches", "enrollment")])
def test_batch_check_equals_full_validation(spark, seed, names):
    batches = {n: b for n, b in batches_of_seed(spark, seed).items() if n in names}
    before, then = counted(quality.validate(seed)), counted(quality.validate(after(seed, batches)))
    found = counted(batch_checks.check_batch(seed, batches))
    assert {k: n for k, n in found.items() if n} == {k: then[k] - before[k] for k in then if then[k] != before[k]}


def test_the_filter_of_a_batch_stands_at_the_scan(spark, seed, scratch):
    parquet.write_tables(seed, scratch, ["person"])
    stored = parquet.read_table(spark, scratch, "person")
    keys = spark.createDataFrame([(1,), (5,), (None,)], "id long")
    found = batch_checks.touched_rows(stored, keys, ["id"])
    assert sorted(r.id for r in found.collect()) == [1, 5]

    def filters(node):
        """Conditions of filters right above a scan."""
        below = [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName() == "Filter" and below[0].nodeName() == "LogicalRelation":
            yield node.condition().toString()
        for child in below:
            yield from filters(child)

    assert any("xxhash64(id" in c and "scalar-subquery" in c for c in filters(found._jdf.queryExecution().optimizedPlan()))


def test_the_filter_lets_no_key_be_missed_and_few_others_through(spark):
    rows = spark.range(20_000).withColumn("other", F.col("id").cast("string"))
    keys = rows.filter("id % 97 = 0")
    through = rows.filter(batch_checks.bloom(keys, ["id", "other"]))
    assert through.join(keys, "id", "left_semi").count() == keys.count() and through.count() < keys.count() + 400
    assert rows.filter(batch_checks.bloom(keys.limit(0), ["id"])).count() == 0


# ---------------------------------------------------------------- W2 marks and reserved ids

def test_ids_of_deleted_rows_are_not_used_again(spark, seed, scratch):
    top = seed.get("enrollment").orderBy(F.desc("id")).limit(2)
    asked = top.select("student_id", "class_id")
    last = seed.get("enrollment").agg(F.max("id")).first()[0]
    gone = linking.unlink(seed, "enrollment", asked).tables
    assert gone.get("enrollment").agg(F.max("id")).first()[0] < last
    parquet.write_tables(gone, scratch)
    for t in (gone, parquet.read_tables(spark, scratch), gone.replace(person=gone.get("person"))):
        back = linking.link(t, "enrollment", asked)
        assert sorted(r.id for r in back.outcomes.filter("id IS NOT NULL").collect()) == [last + 1, last + 2]
        assert {r.table_name: r.next_id for r in counts.next_ids(t).collect()}["enrollment"] == last + 1
    again = linking.link(linking.unlink(back.tables, "enrollment", asked).tables, "enrollment", asked)
    assert min(r.id for r in again.outcomes.filter("id IS NOT NULL").collect()) == last + 3


def test_ids_are_reserved_without_moving_rows(spark):
    batch = spark.range(0, 1000, numPartitions=7).withColumn("v", F.col("id") * 3).filter("id % 5 <> 0").drop("id")
    given = ids.reserve_ids(spark.createDataFrame([(41,)], "id long"), batch)
    found = given.collect()
    assert sorted(r.id for r in found) == list(range(42, 842)) and {r.id: r.v for r in given.collect()} == {r.id: r.v for r in found}
    assert ids.reserve_ids(spark.createDataFrame([], "id long"), batch.limit(0)).count() == 0


# ---------------------------------------------------------------- reports from deltas

def test_reports_after_changes_equal_recomputation(spark, seed, scratch):
    e, c, i = seed.get("enrollment"), seed.get("class_group"), seed.get("invoice")
    deltas = {
        "enrollment": delta(e.filter("class_id = 1"), e.filter("class_id = 2").withColumn("class_id", F.lit(3).cast("bigint"))),
        "class_group": delta(c.filter("id IN (1, 2)"), c.filter("id = 2").withColumn("name", F.lit("renamed")).withColumn("capacity", F.lit(1))
                             .unionByName(c.filter("id = 1").withColumn("id", F.lit(70).cast("bigint")))),
        "invoice": delta(i.filter("id <= 2"), i.filter("id = 1").withColumn("status_id", F.lit(5)).withColumn("amount", F.lit("0.35").cast("decimal(18,2)"))),
        "student": delta(seed.get("student").limit(1)),
        "teaches": delta(seed.get("teaches").limit(1)),
        "plan": delta(come=seed.get("plan").limit(1).withColumn("id", F.lit(99).cast("bigint"))),
    }
    changed = {}
    for name, d in deltas.items():
        kept = seed.get(name).exceptAll(d.filter("sign = -1").select(*seed.get(name).columns))
        changed[name] = kept.unionByName(d.filter("sign = 1").select(*kept.columns))
    t = seed.replace(**changed)
    state = ReportState.build(seed, os.path.join(scratch, "a")).fold(deltas, os.path.join(scratch, "b"))
    for name in ("kpi", "occupancy", "invoice_summary", "plan_revenue"):
        assert rows_of(getattr(state, name)(seed)) == rows_of(reports.REPORTS[name](t)), name
    assert rows_of(state.instructor_load(t)) == rows_of(reports.instructor_load(t).select("instructor_id", "classes"))
    undone = {name: d.withColumn("sign", -F.col("sign")) for name, d in deltas.items()}
    back = state.fold(undone, os.path.join(scratch, "c"))
    assert rows_of(back.occupancy(seed)) == rows_of(reports.occupancy(seed)) and rows_of(back.kpi(seed)) == rows_of(reports.kpi(seed))


def test_a_report_after_changes_reads_the_state_only(spark, seed, scratch):
    parquet.write_tables(seed, os.path.join(scratch, "model"))
    t = parquet.read_tables(spark, os.path.join(scratch, "model"))
    state = ReportState.build(t, os.path.join(scratch, "state"))
    read = {e.split("/")[-2] for e in state.occupancy(t).inputFiles()}
    assert read == {"class_rows", "enrolled", "sport"}


# ---------------------------------------------------------------- W4 row by row

def test_deletes_are_explained(spark, seed):
    keys = spark.createDataFrame([(1,), (6,)], "id long")
    told = cascade.explain_delete(seed, "person", keys).collect()
    by = {(r.table_name, r.row_key): r.paths for r in told}
    both = [p for (name, _), p in by.items() if name == "guardianship" and ", " in p]
    assert both and all(p == "guardian.person_id > guardianship.guardian_id, student.person_id > guardianship.student_id" for p in both) or \
        {p for (name, _), p in by.items() if name == "guardianship"} <= {
            "guardian.person_id > guardianship.guardian_id", "student.person_id > guardianship.student_id"}
    done = cascade.delete_cascade(seed, "person", keys)
    gone = Counter(r.table_name for r in told if r.outcome == "deleted")
    assert gone == {n: seed.get(n).count() - done.tables.get(n).count() for n in done.touched
                    if seed.get(n).count() > done.tables.get(n).count()}


def test_rows_reached_twice_and_refused_keys(spark, seed):
    one = seed.replace(guardian=spark.createDataFrame([(1,), (2,)], "person_id long"),
                       guardianship=spark.createDataFrame([(1, 1), (1, 2), (3, 1)], "student_id long, guardian_id long"))
    told = {(r.row_key, r.paths) for r in cascade.explain_delete(one, "person", spark.createDataFrame([(1,)], "id long")).collect()
            if r.table_name == "guardianship"}
    guardian, student = "guardian.person_id > guardianship.guardian_id", "student.person_id > guardianship.student_id"
    assert told == {("1:1", f"{guardian}, {student}"), ("1:2", student), ("3:1", guardian)}
    refused = cascade.explain_delete(seed, "phone", spark.createDataFrame([(1,), (999,)], "id long")).collect()
    assert [(r.row_key, r.outcome, r.paths) for r in refused] == [("1", "refused", "person")]
    cleared = cascade.explain_delete(seed, "address", spark.createDataFrame([(2,)], "id int")).collect()
    assert {(r.table_name, r.outcome) for r in cleared} == {("address", "deleted"), ("person", "set null")}


def test_delete_reports_build_no_enrolment_ids(star001, monkeypatch):
    from roster.sources import adapter

    def refuse(*args, **kwargs):
        raise AssertionError("ids are built")

    monkeypatch.setattr(adapter, "dense_index", refuse)
    keys = star001.get("person", "id", "address_id").filter("address_id = 3")
    assert cascade.change_report(cascade.delete_cascade(star001, "person", keys)).count() == 11


# ---------------------------------------------------------------- S3 / S5 load journal

def test_a_broken_load_goes_on(seed, spark, scratch, monkeypatch):
    root, written = os.path.join(scratch, "m"), []
    whole = parquet._load

    def breaks(t, root, name, df):
        if name == "plan":
            raise OSError("lost")
        written.append(name)
        whole(t, root, name, df)

    monkeypatch.setattr(parquet, "_load", breaks)
    with pytest.raises(OSError, match="lost"):
        parquet.load_once(seed, root, at_once=1)
    monkeypatch.undo()
    rest = parquet.load_once(seed, root)
    assert "plan" in rest and not set(rest) & set(written) and set(rest) | set(written) == set(schema.TABLE_NAMES)
    assert {r.table_name: r.n for r in parquet.load_journal(spark, root).collect()} == {n: seed.get(n).count() for n in schema.TABLE_NAMES}


def test_a_changed_input_is_loaded_again(spark, scratch):
    from roster.sources.tables import Tables

    source, root = os.path.join(scratch, "in"), os.path.join(scratch, "m")
    spark.createDataFrame([(1, "a")], "id int, name string").write.parquet(source)
    builders = {"schedule": lambda cols: spark.read.schema(schema.table("schedule").schema).parquet(source),
                "invoice_status": lambda cols: spark.createDataFrame([(1, "Paga")], schema.table("invoice_status").schema)}

    def tables():
        return Tables(spark, builders, lineage={"schedule": [source]})

    assert parquet.load_once(tables(), root) == ["invoice_status", "schedule"]
    assert parquet.load_once(tables(), root) == []
    spark.createDataFrame([(2, "b")], "id int, name string").write.mode("append").parquet(source)
    assert parquet.load_once(tables(), root) == ["schedule"]
    assert rows_of(parquet.read_table(spark, root, "schedule")) == [(1, "a"), (2, "b")]
    files.delete(spark, parquet.journal_path(root, "invoice_status"))
    assert parquet.load_once(tables(), root) == ["invoice_status"]


# ---------------------------------------------------------------- S2 balanced reads

def key_cases():
    rng = random.Random(6)
    skewed = [(int(rng.paretovariate(0.6)) % 100_000, rng.randrange(10**6)) for _ in range(6000)]
    hot = [(7, i) for i in range(4000)] + [(rng.randrange(50), rng.randrange(1000)) for _ in range(4000)] + [(9, -i) for i in range(3000)]
    return {"dense": [(i, 0) for i in range(5000)], "gaps": [(i ** 3, 0) for i in range(3000)], "skewed": skewed, "hot": hot,
            "nulls": [(None, 1), (1, None), (1, 2), (None, None)] * 300, "few": [(1, 2)], "none": [], "one value": [(3, i) for i in range(2000)]}


@pytest.mark.parametrize("case", key_cases())
def test_predicates_split_rows_evenly_and_exactly(spark, case):
    rows = key_cases()[case]
    keys = spark.createDataFrame(rows, "a long, b long")
    if case in ("dense", "gaps"):
        keys = keys.select("a")
    parts = 8
    predicates = jdbc.equi_depth(keys, parts)
    hits = keys.select(*[F.coalesce(F.expr(p), F.lit(False)).cast("int").alias(f"p{i}") for i, p in enumerate(predicates)])
    per_row = hits.select(sum(F.col(c) for c in hits.columns).alias("n")).groupBy("n").count().collect()
    assert {r.n for r in per_row} <= {1}
    sizes = hits.agg(*[F.sum(c) for c in hits.columns]).first()
    if case not in ("nulls", "few", "none"):
        assert max(sizes) <= 2 * len(rows) / parts and len(predicates) <= 4 * parts


# ---------------------------------------------------------------- O1 to O3

def test_positions_and_collations(spark):
    df = spark.createDataFrame([("b", 1), ("Á", 2), ("a", 3), (None, 4), ("B", 5)], "name string, id int")
    placed = in_order(df, [collated("name").asc_nulls_first(), F.col("id").desc()])
    assert [r.id for r in placed.orderBy("position").collect()] == [4, 3, 2, 5, 1]
    falling = in_order(df.repartition(4), [F.desc_nulls_last("id")])
    assert sorted((r.position, r.id) for r in falling.collect()) == [(i + 1, 5 - i) for i in range(5)]
    assert df.join(spark.createDataFrame([("A",)], "other string"), collated("name") == collated("other")).count() == 2


# ---------------------------------------------------------------- W3 form rules, broadcasts, the entry

def test_edits_follow_the_form_rules(spark, seed):
    people = spark.createDataFrame([(1, " ", None, None, None, None, None), (2, "ok", "1", "e", None, None, "x")],
                                   "id long, name string, tax_id string, email string, born_on date, enrolled_on date, health_note string")
    res = changes.edit_people(seed, "student", people.unionByName(people.filter("id = 2").withColumn("id", F.lit(3).cast("long"))
                                                                  .withColumn("enrolled_on", F.lit("2101-01-01").cast("date"))))
    assert {r.id: r.reason for r in res.rejected.collect()} == {1: "blank_name", 3: "enrolled_on_out_of_range"}
    assert {r.id: r.name for r in res.tables.get("person").filter("id <= 3").collect()} == {
        **{r.id: r.name for r in seed.get("person").filter("id <= 3").collect()}, 2: "ok"}
    classes = seed.get("class_group").filter("id <= 3").withColumn("capacity", F.when(F.col("id") == 1, 0).otherwise(9)).withColumn(
        "sport_id", F.when(F.col("id") == 2, 99).otherwise(F.col("sport_id")))
    res = changes.edit_classes(seed, classes)
    assert {r.id: r.reason for r in res.rejected.collect()} == {1: "capacity_below_1", 2: "unknown_sport"}
    assert {r.id for r in res.tables.get("class_group").filter("capacity = 9").collect()} >= {3}
    assert changes.edit_sports(seed, seed.get("sport").withColumn("name", F.lit(""))).rejected.count() == seed.get("sport").count()


def test_broadcasts_are_bounded_by_bytes(spark):
    wide = spark.range(10).select(F.repeat(F.lit("x"), 1000).alias("v"))
    assert broadcast.row_bound_holds(wide, 10) and not broadcast.row_bound_holds(wide, 9) and not broadcast.row_bound_holds(wide, 10, 5000)
    assert broadcast.row_bound_holds(wide.limit(0), 0)


def test_the_entry_works_without_the_corpus_package(monkeypatch):
    import __spark_entry__ as entry

    monkeypatch.setitem(sys.modules, "roster.llm.registry", None)        # as with its folder gone, or a leftover of it
    assert not [n for n in entry.queries() if n.startswith("op") or n == "pipeline"] and len(entry.queries()) > 90
    assert set(entry.oracle_sql()) == set(entry.queries())


def test_the_newest_state_is_read_after_an_idle_batch(spark, scratch):
    from roster.streaming.changelog_stream import latest_state, version_path

    class Query:
        lastProgress = {"batchId": 5}

    assert latest_state(spark, scratch, Query, spark.range(0).schema) is None
    for v in (1, 3, 7):
        spark.range(v).write.parquet(version_path(scratch, v))
    assert latest_state(spark, scratch, Query, spark.range(0).schema).count() == 3
