"""The registered queries of this package: one per operator over its whole table, in the contracted columns."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roster.llm import (
    bpe, conversations, exact_dedup, langid, line_dedup, near_dup, packing, phrases, pii, quality, secret_scan, toxicity, whitening)
from roster.llm.oracles import ORACLES
from roster.llm.shared import table

__all__ = ["ORACLES", "QUERIES"]

Query = Callable[[SparkSession, str], DataFrame]
#: Of the registered query over synthetic tables only. Who knows a key can find the values behind surrogates by trial: real
#: data need a secret one.
DEMO_KEY = "surrogates"


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels").filter(~toxicity.held_out()))
    return toxicity.score(docs, model).select(
        "doc_id", toxicity.held_out().alias("held_out"), "score",
        F.when(F.col("score") >= toxicity.THRESHOLD, 1).otherwise(0).alias("predicted"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = secret_scan.scan(table(spark, sf_dir, "documents"))
    base = [r.kind for r in secret_scan.BASE_RULES]

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return scanned.select("doc_id", *map(count, base),
                          F.sha2(joined(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
                          joined(F.col("spans")).alias("spans"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    model, table_of_bytes = (spark.sparkContext.broadcast(x) for x in (bpe.model_bytes(tokens), tokens))
    encoded = bpe.bpe_encode(table(spark, sf_dir, "documents"), model, public_tokenizers.PATTERN)
    decoded = bpe.bpe_decode(encoded, table_of_bytes)
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                          F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
                          F.sha2("bytes", 256).alias("decoded_sha256"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.filter(~langid.held_out()))
    return langid.identify(docs, model).withColumn("held_out", langid.held_out())


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "loss_tokens",
                         "sequence_id", "offset")


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_dedup(table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op10_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_pii(table(spark, sf_dir, "documents"), DEMO_KEY)


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = whitening.fixed_point(table(spark, sf_dir, "embeddings"))
    model = whitening.fit(x)
    shares = F.array(*[F.lit(e) for e in model.explained()]).cast("array<double>")
    rows = whitening.whiten(x, model).select("id", "deviation", F.posexplode("whitened").alias("i", "whitened"))
    # Beyond 64 bits only the exact decimal column holds the deviation.
    return rows.select(F.col("id").alias("vec_id"), (F.col("i") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"),
                       F.col("deviation").try_cast("long").alias("deviation"), F.col("deviation").alias("deviation_exact"), "whitened",
                       F.get(shares, F.col("i")).alias("explained"), F.lit(model.identity_error).alias("identity_error"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations")
    return conversations.repair(conversations.damage(given), every=given)


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = phrases.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_line_dedup, op2_toxicity, op3_secret_scan, op4_quality_rules, op5_byte_bpe, op6_language_id, op7_packing, op8_near_dedup,
    op9_exact_dedup, op10_pii_surrogates, op11_embedding_whitening, op12_conversation_repair, op13_decontamination)}
