"""The text pipeline: documents through the stages of STAGES, each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelloom.llm import mixing, pii_bootstrap, quality_outliers, sentencepiece_scan, simhash
from panelloom.llm.common import importable, read, shared_folder, tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor their distance to the rest of their group reject."""
    return quality_outliers.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component, the one with the smallest doc_id."""
    return simhash.keep_one(docs, simhash.SHINGLE, simhash.RADIUS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    return pii_bootstrap.redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, lang, source, chunk, n_chunks, n_tokens, ids`` for every document and chunk."""
    coded = sentencepiece_scan.encode(docs.select("doc_id", "lang", "source", "text"), tokenizer_path("piece_bpe_32k.model"))
    return coded.select("row.doc_id", "row.lang", "row.source", "chunk", "n_chunks", F.size("ids").alias("n_tokens"), "ids")


STAGES = [
    ("quality rules", quality_rules),
    ("simhash near-duplicates", near_duplicates),
    ("personal data", personal_data),
    ("source mix", source_mix),
    ("sentencepiece", token_ids),
]
#: Neither robust estimates nor fingerprints can be stated in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents; each works on what the one before wrote."""
    docs = read(importable(spark), sf_dir, "documents")
    folder = shared_folder(spark, "corpus-pipeline")
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
    return docs
