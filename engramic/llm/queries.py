"""The registered query of each operator, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprints, language_id, license_scan, mixing, near_dedup, packing, passages, quality, token_index, topk
from .common import documents

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_dedup.near_duplicates(documents(spark, sf_dir))
    return groups.select("doc_id", near_dedup.fingerprint_hex().alias("fingerprint"), "component_id")


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    fps = fingerprints.fingerprint_classes(documents(spark, sf_dir))
    own, other = fingerprints.hex_of("f0", "f1"), fingerprints.hex_of("e0", "e1")
    return fps.select("doc_id", "n_chars", "edited_sha256", own.alias("fingerprint"), other.alias("edited_fingerprint"), "near_edited", "near_next", "class_id")


def op3_token_id_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    root, _ = token_index.write_tokens(documents(spark, sf_dir), tokenizer_path())
    return token_index.read_tokens(spark, root)


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predicted_languages(documents(spark, sf_dir)).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "copies", "part_words")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_length_bucket_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(documents(spark, sf_dir), tokenizer_path())


def op9_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(documents(spark, sf_dir)).drop("text_hash")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(documents(spark, sf_dir)).drop("spans")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of corpus_pipeline.py, one after the other."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_document_fingerprints": op2_document_fingerprints,
    "op3_token_id_index": op3_token_id_index,
    "op4_exact_top_k": op4_exact_top_k,
    "op5_language_id": op5_language_id,
    "op6_source_mixing": op6_source_mixing,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_length_bucket_packing": op8_length_bucket_packing,
    "op9_paragraph_dedup": op9_paragraph_dedup,
    "op10_license_scan": op10_license_scan,
    "pipeline": pipeline,
}
ORACLE_SQL: dict[str, str] = {
    "op4_exact_top_k": """WITH v AS (
 SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS q FROM embeddings
 WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10""",
}
