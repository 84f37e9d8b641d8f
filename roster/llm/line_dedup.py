"""Line dedup (operator 1), in DataFrame functions only.

Every text is split at newlines and exploded with positions. A line's key is the line without ASCII white
space at both ends and with A-Z lower-cased; keys of ``min_chars`` code points or more are hashed (128 bits of
SHA-256). Keys found in ``min_docs`` or more different documents lose all their lines, except in the largest
``doc_id`` that holds them. The positions to drop are gathered per document and the rest is joined again in
order of position.

* Only (document, position, 16 bytes) are written and shuffled per line, never the line itself; the table of
  hashed lines is written once and read by both the count and the lookup.
* Documents per key are counted by a distinct aggregate with map-side combining at both steps; the lookup of
  repeated keys is a shuffle join, so a line in a third of all documents is split by AQE.
* Texts move once, in the join of the documents with their dropped positions.

Defined cases: a null or empty text is one empty line. Rows repeating a ``doc_id`` belong to one document for the
counts; each keeps its own text. Rows with a null ``doc_id`` form one document that ranks below all others.
Repeats within a single document don't count. An empty table gives an empty result; further columns
are ignored unless named in ``carry``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roster.llm.shared import SPACES, ascii_lower, pin

MIN_CHARS = 40
MIN_DOCS = 5


def _keyed(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, version, pos, h) of every line with a long enough key; version tells texts apart that share a doc_id."""
    lines = docs.select("doc_id", F.xxhash64("text").alias("version"),
                        F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    lines = lines.withColumn("line", F.btrim("line", F.lit(SPACES))).filter(F.char_length("line") >= min_chars)
    digest = F.unhex(F.sha2(ascii_lower(F.col("line")), 256))
    return lines.select("doc_id", "version", "pos", F.substring(digest, 1, 16).alias("h"))


def dropped_positions(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, version, drops): the positions of the lines to drop, for documents that lose any."""
    keyed = pin(_keyed(docs, min_chars), "line-keys")
    per_doc = keyed.select("h", "doc_id").distinct()
    repeated = (per_doc.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keep_id"))
                .filter(F.col("n") >= min_docs).select("h", "keep_id"))
    # Written, so that AQE can split the join's hot keys.
    hits = keyed.join(pin(repeated, "line-repeats"), "h").filter(~F.col("doc_id").eqNullSafe(F.col("keep_id")))
    return hits.groupBy("doc_id", "version").agg(F.collect_set("pos").alias("drops"))


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS,
               carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, text (what is left), n_lines (before), n_dropped, then the columns named in ``carry``."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.struct(F.lit(0).alias("_"), *carry).alias("carry"))
    drops = dropped_positions(docs.select("doc_id", "text"), min_chars, min_docs).withColumnsRenamed(
        {"doc_id": "drop_id", "version": "drop_version"})
    lines = (docs.withColumn("version", F.xxhash64("text"))
             .join(drops, F.col("doc_id").eqNullSafe(F.col("drop_id")) & (F.col("version") == F.col("drop_version")), "left")
             .select("doc_id", "text", "carry", "drops", F.split("text", "\n", -1).alias("lines")))
    kept = lines.withColumn("kept", F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("drops")))
    text = F.when(F.col("drops").isNull(), F.col("text")).otherwise(
        F.array_join(F.transform("kept", lambda i: F.element_at("lines", i + 1)), "\n"))
    return kept.select("doc_id", text.alias("text"), F.size("lines").cast("long").alias("n_lines"),
                       F.coalesce(F.array_size("drops"), F.lit(0)).cast("long").alias("n_dropped"),
                       *[F.col("carry")[c].alias(c) for c in carry])
