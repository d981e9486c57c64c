"""The registered queries of this subpackage and the SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, table
from .cotraining import classify
from .embedding_dedup import embedding_links
from .html_crf import extract_main_text
from .language_id import identify
from .mixing import mix_digest
from .near_dedup import near_duplicates
from .oracles import ORACLES  # noqa: F401
from .packing import pack_documents
from .quality_rules import quality_rules
from .substring_dedup import remove_repeats
from .token_files import token_files
from .tokens import default_path


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return table(spark, sf_dir, name)


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(_read(spark, sf_dir, "pages"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_read(spark, sf_dir, "documents"), default_path())


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_links(_read(spark, sf_dir, "embeddings"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_read(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_digest(_read(spark, sf_dir, "documents"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_read(spark, sf_dir, "documents"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(_read(spark, sf_dir, "documents"), default_path())


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classify(_read(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), passed=["doc_id"])
    return found.withColumnsRenamed({"quality_text": "text_score", "quality_meta": "meta_score", "quality_score": "score", "quality_kept": "kept"})


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(_read(spark, sf_dir, "documents"))


def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5's columns that no model decides."""
    found = op5_quality_rules(spark, sf_dir)
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6's columns that no draw decides."""
    return op6_source_mixing(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_html_extraction, op2_substring_dedup, op3_best_fit_packing, op4_embedding_near_dedup, op5_quality_rules, op6_source_mixing, op7_minhash_near_dedup,
        op8_token_files, op9_quality_classifier, op10_language_id, quality_counts, mix_targets,
    )
}
