"""From documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes
what a stage returns as Parquet into the shared folder, rereads it as the
next one's docs and removes what no later stage reads.  All but the last return
the columns of documents; the last returns the packed pieces.

Defined results: rows with null or empty texts pass the classifier by its
score, each of them stays in near_dedup unless its doc_id and text repeat, and
the mix takes none of their words, so they end there; rows with null doc_ids
are documents each, of which near_dedup keeps none beside a copy that has one;
repeated doc_ids with different texts are documents each; columns besides those
that a stage needs are carried along; empty tables give empty results.  Stages
bound the session's Arrow batches (common.bounded_batches).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from huegrid.llm.common import bounded_batches, scratch, staged, table
from huegrid.llm.cotraining import without_rejected
from huegrid.llm.mixing import mix_documents
from huegrid.llm.near_dedup import without_near_duplicates
from huegrid.llm.packing import pack_documents
from huegrid.llm.substring_dedup import without_repeats
from huegrid.llm.tokens import default_path


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier keeps."""
    bounded_batches(spark)
    return without_rejected(docs, table(spark, sf_dir, "labels"))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    bounded_batches(spark)
    return without_near_duplicates(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that repeat among them."""
    bounded_batches(spark)
    return without_repeats(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources, a row for each take of a document's part of a block."""
    bounded_batches(spark)
    return mix_documents(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens and their places in sequences."""
    bounded_batches(spark)
    return pack_documents(docs, default_path())


STAGES = [
    ("quality_classifier", quality_classifier),
    ("minhash_near_dedup", minhash_near_dedup),
    ("substring_dedup", substring_dedup),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]

#: SQL expresses neither a trained classifier nor the tokenizer; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    with scratch(spark) as made:
        for name, stage in STAGES[:-1]:
            docs = staged(stage(spark, docs, sf_dir), name)
            made.keep(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
