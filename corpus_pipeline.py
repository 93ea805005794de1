"""Corpus pipeline: quality, exact and near duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; ``run`` writes it as Parquet and
rereads it as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from meshloom.llm import exact_dedup, keep, packing, quality, secret_scan, simhash
from meshloom.llm.common import Scratch, table
from meshloom.llm.queries import tokenizer


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or score below the threshold go."""
    return quality.keep_quality(docs, quality.trusted_ids(table(spark, sf_dir, "labels")))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the longest original, then the smallest id, stays: one row of each content."""
    decided = exact_dedup.exact_dedup(docs).withColumnRenamed("text_sha256", "key")
    return keep.without_rows(docs, exact_dedup.content_digest(F.col("text")), decided, "exact_stage")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every SimHash component the smallest id stays, a row without an id where none has one."""
    return keep.without_rows(docs, simhash.text_digest(F.col("text")), simhash.simhash_keepers(docs), "near_stage")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret's span is replaced by a mark; no document goes."""
    return secret_scan.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts' token pieces, each with its sequence and its place there."""
    return packing.pack_documents(docs, tokenizer("word_bpe_49k.json"), capacity=4096)


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_duplicates),
    ("simhash_near_dedup", near_duplicates),
    ("secret_scan", secrets),
    ("best_fit_packing", pack_sequences),
]

# Hashing, SimHash, inferred formats and tokenisation have no SQL equivalent; the tests hold the
# stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        newer = scratch.put(stage(spark, docs, sf_dir), name)
        scratch.drop(docs)
        docs = newer
    return docs
