"""The queries opN_<name>: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language_id, quality_model, sql
from ._shared import shared_dir, table
from .fingerprints import edit_likeness
from .line_dedup import line_dedup
from .lm_scoring import lm_score
from .mixing import mix
from .ngram_join import ngram_join
from .packing import best_fit_packing
from .quality_rules import quality_rules
from .warc import read_archive, write_archive


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/archive"
    write_archive(table(spark, sf_dir, "pages"), path)
    return read_archive(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_tokens", "log_prob", "mean_log_prob")


def op5_bradley_terry_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = quality_model.train(docs, labels.where(~held_out))
    return quality_model.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = language_id.train(docs.where(~held_out))
    return language_id.identify(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op8_lz_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = edit_likeness(table(spark, sf_dir, "documents").select("doc_id", "text"))
    edited = F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256")
    return out.select("doc_id", "n_chars", edited, "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents").select("doc_id", "text"), n=4, percent=85)


def op10_pareto_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_line_dedup": op2_line_dedup,
    "op3_warc": op3_warc,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_bradley_terry_quality": op5_bradley_terry_quality,
    "op6_quality_rules": op6_quality_rules,
    "op7_language_id": op7_language_id,
    "op8_lz_fingerprints": op8_lz_fingerprints,
    "op9_ngram_jaccard": op9_ngram_jaccard,
    "op10_pareto_mixing": op10_pareto_mixing,
}

ORACLE = {
    "op2_line_dedup": sql.LINE_DEDUP,
    "op3_warc": sql.WARC,
    "op6_quality_rules": sql.QUALITY_RULES,
    "op9_ngram_jaccard": sql.NGRAM_JACCARD,
}
