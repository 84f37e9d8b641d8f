"""Exact dedup by distributed MSD radix partitioning (operator 9).

Documents are split by successive runs of bytes of their normalised text, most significant first. A round
takes the next run (the "digit") of every unresolved document and partitions each group by it. A group with
one member is resolved; a group whose members ended within the run is a class of equal texts; the others go
on to the next run. Runs grow fourfold, so a text of n bytes takes about log4(n) rounds. Groups are told
apart by the bytes themselves; no digest decides equality.

* Round 0 compares only the first 256 bytes of every text and lets documents leave that share them with no
  other; only the rest is written out once, with row ids, for the later rounds.
* Groups are counted with map-side combining, so a group with a third of all rows costs one row per task.
  Group numbers return to the members by a shuffle join whose hot keys AQE splits. No group meets in a task.
* Every round is written to the shared checkpoint folder, so the loss of an executor repeats one round.

Defined cases: a null text counts as empty; empty texts are one class. Rows that repeat a ``doc_id`` are rows
of their own: all count in ``group_size`` and of equal rows exactly one is kept. A null ``doc_id`` ranks below
every other. An empty table gives an empty result. Further columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roster.llm.shared import ascii_lower, pin

HEAD_BYTES = 256
FIRST_RUN = 1024
GROWTH = 4


def _run(start: int, width: int):
    return F.expr(f"substring(cast(norm AS binary), {start + 1}, {width})")


def exact_dedup(docs: DataFrame, first_run: int = FIRST_RUN, growth: int = GROWTH) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text)."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    head = F.expr(f"substring(cast(head AS binary), 1, {HEAD_BYTES})")
    heads = docs.select(ascii_lower(F.substring("text", 1, HEAD_BYTES)).alias("head")).select(head.alias("digit"))
    shared = pin(heads.groupBy("digit").count().filter("count > 1").select("digit", F.lit(True).alias("shared")), "radix-heads")
    rows = (docs.select("doc_id", ascii_lower(F.col("text")).alias("norm"))
            .withColumn("digit", F.expr(f"substring(cast(norm AS binary), 1, {HEAD_BYTES})"))
            .join(shared, "digit", "left")
            .select("doc_id", F.sha2("norm", 256).alias("text_sha256"), F.when(F.col("shared"), F.col("norm")).alias("norm")))
    rows = pin(rows.withColumn("rid", F.monotonically_increasing_id()), "radix-rows")

    resolved = _partition(rows.filter(F.col("norm").isNotNull()), first_run, growth)
    return (rows.select("rid", "doc_id", "text_sha256").join(resolved, "rid", "left")
            .select("doc_id",
                    F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
                    F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
                    F.coalesce(F.col("keep_rid") == F.col("rid"), F.lit(True)).alias("kept"),
                    "text_sha256"))


def _partition(rows: DataFrame, width: int, growth: int) -> DataFrame:
    """(rid, n, keep_id, keep_rid) of the rows (rid, doc_id, norm) whose text another row has too."""
    start, open_groups, resolved = 0, None, None
    while True:
        digits = (rows.filter(F.octet_length("norm") >= start)
                  .select("rid", "doc_id", _run(start, width).alias("digit")))
        if open_groups is None:
            members = digits.withColumn("g", F.lit(0).cast("long"))
        else:
            members = open_groups.join(digits, "rid")
        groups = (members.groupBy("g", "digit")   # written, so that AQE can split the join below
                  .agg(F.count(F.lit(1)).alias("n"), F.min("rid").alias("first"), F.max("doc_id").alias("keep_id"),
                       F.coalesce(F.max_by("rid", "doc_id"), F.max("rid")).alias("keep_rid"))
                  .filter("n > 1"))
        split = pin(members.select("rid", "g", "digit").join(pin(groups, "radix-groups"), ["g", "digit"])
                    .select("rid", F.col("first").alias("g"), "n", "keep_id", "keep_rid",
                            (F.octet_length("digit") < width).alias("ended")), "radix-round")
        done = split.filter("ended").select("rid", "n", "keep_id", "keep_rid")
        resolved = done if resolved is None else resolved.unionByName(done)
        open_groups = split.filter("NOT ended").select("rid", "g")
        if open_groups.isEmpty():
            return resolved
        start, width = start + width, width * growth
