"""Corpus pipeline: language ID, line dedup, near-dedup, secret redaction, packing.

Each stage takes (spark, docs, sf_dir) with docs in the columns of ``documents`` and returns a DataFrame that is
written as Parquet and read again as the next stage's docs. All stages but the last return the columns of
``documents``; ``n_chars`` is the length of the text a stage returns. Extra columns of the input are dropped, missing
ones are an error. Each stage handles null and empty texts as its operator says.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roster.llm import langid, line_dedup, near_dup, packing, secret_scan
from roster.llm.shared import pin, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Least posterior of the predicted language.
LEAST_SCORE = 0.5
#: Least similarity of near-duplicates, in percent of their five-word shingles (op8's contract has 85).
NEAR_PERCENT = 80


def _as_documents(df: DataFrame) -> DataFrame:
    return df.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter and those that no language explains better than all others together.
    The models are learned from the labelled rows of the stage's own documents. Without any labelled row there is nothing to
    judge by, and all documents stay."""
    model = langid.train(docs)
    if not model.languages:
        return _as_documents(docs)
    judged = langid.identify(docs.withColumn("kept_text", F.col("text")), model, carry=["kept_text", "lang", "source"])
    kept = judged.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return _as_documents(kept.withColumnRenamed("kept_text", "text"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that five or more documents share, except in the last of them. Documents whose every line goes stay,
    with an empty text."""
    return _as_documents(line_dedup.line_dedup(docs, carry=["lang", "source"]))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near-duplicates (five-word shingles, similarity 0.8 or more) stays, the one with
    the smallest doc_id."""
    return _as_documents(near_dup.one_of_each(docs, percent=NEAR_PERCENT, carry=["lang", "source"]))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret found by a mark; all documents stay."""
    return _as_documents(secret_scan.redact(secret_scan.scan(docs, carry=["lang", "source"])))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences for training, one row per piece."""
    pieces = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "loss_tokens",
                         "sequence_id", "offset")


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("secrets", secrets), ("packed", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = pin(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: The models, the near-duplicate components and the packing are not expressible in SQL; tests compare with brute force.
ORACLE_SQL = None
