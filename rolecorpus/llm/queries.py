"""The registered queries of this subpackage: each applies one operator, with production parameters, to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, extraction, jaccard, language, line_dedup, manifest, mixing, neighbours, phrases, privacy, quality, suffixes, vectors
from .sql import ORACLES


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffixes.dedup_substrings(_table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["length"])
    return cut.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


#: For tests and checks; a deployment passes a secret of its own.
SAMPLE_KEY = "pseudonym-key-for-checks"


def op3_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return privacy.pseudonymize(docs, SAMPLE_KEY)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = quality.held_out(F.col("doc_id"), 4, 2)
    profiles = language.learn_profiles(docs.filter(~out))
    found = language.identify_languages(docs.select("doc_id", "text"), profiles)
    return found.select("doc_id", out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = quality.held_out(F.col("doc_id"), 5, 0)
    model = quality.fit_quality(docs, _table(spark, sf_dir, "labels").filter(~out))
    scored = quality.score_quality(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", out.alias("held_out"), F.col("quality_score").alias("score"), F.col("quality_pred").alias("predicted"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = extraction.extract_main_text(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs)


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(_table(spark, sf_dir, "documents")).drop("row_key")


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), F.col("mix_taken").alias("taken"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contained_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("row_key")


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"))


def op12_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_copies(_table(spark, sf_dir, "embeddings"))


def op13_dataset_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.verify_documents(_table(spark, sf_dir, "documents"), tampered=F.crc32(F.col("doc_id").cast("string")) % 5 == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_suffix_array_dedup, op2_nearest_neighbours, op3_pii_pseudonyms, op4_language_id, op5_quality_classifier, op6_html_extraction, op7_line_dedup, op8_ngram_jaccard_join, op9_source_mixing, op10_decontamination, op11_phrase_collocations, op12_embedding_dedup, op13_dataset_manifest)}


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in ORACLES.items() if k in queries()}
