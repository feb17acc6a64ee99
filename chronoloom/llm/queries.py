"""The registered query of each corpus operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.llm.chat_format import format_conversations, read_back
from chronoloom.llm.embedding_dedup import embedding_components
from chronoloom.llm.fm_decontam import find_contamination
from chronoloom.llm.license_scan import scan_licenses
from chronoloom.llm.maxent_lm import score_texts
from chronoloom.llm.merkle_manifest import manifest
from chronoloom.llm.ngram_jaccard import ngram_jaccard_components
from chronoloom.llm.oracle import SQL
from chronoloom.llm.pii_weak import ADDED, KINDS, find_personal_data
from chronoloom.llm.prefix_trie import prefix_trie
from chronoloom.llm.quality_qda import score_quality
from chronoloom.llm.source_mix import mix_sources
from chronoloom.llm.syncmers import compare_with_next
from chronoloom.llm.toxicity_chain import score_toxicity


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_components(_read(spark, sf_dir, "documents"))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    n_hit = F.aggregate("removal_spans", F.lit(0).cast("long"), lambda t, s: t + s["end"] - s["start"])
    return find_contamination(docs, _read(spark, sf_dir, "benchmark")).select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(_read(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(_read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "labels"))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_components(_read(spark, sf_dir, "embeddings"))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    talks = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(own)
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read_back(format_conversations(talks)).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_read(spark, sf_dir, "documents")).drop("places")


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_read(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(_read(spark, sf_dir, "documents"), keep=("doc_id",))

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS))
    def number_of(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts, added = map(number_of, KINDS), map(number_of, ADDED)
    return found.select("doc_id", *counts, F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), *added)


def op11_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(_read(spark, sf_dir, "documents"))


def op12_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(_read(spark, sf_dir, "conversations"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(_read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_ngram_jaccard_join, op2_benchmark_decontamination, op3_lm_scoring, op4_quality_classifier, op5_embedding_near_dedup, op6_chat_formatting,
        op7_license_scan, op8_source_mixing, op9_toxicity, op10_pii, op11_document_fingerprints, op12_conversation_prefix_trie, op13_merkle_manifest,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
