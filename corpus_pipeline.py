"""From raw documents to packed training sequences: five stages, each written as Parquet and read again by the next.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept; all but the last return the
columns of documents. No documents, or none left, give no rows at any stage. Rows that share an id go through all stages
but near_dedup, which keeps one of them. Further columns are kept up to packing, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wikiloom.llm import decontam, langid, minhash, packing, secrets
from wikiloom.llm.common import production, stage, table
from wikiloom.llm.registry import tokenizer

#: SQL can't express trained centroids, tokenizers and packing; tests hold run() against a brute-force version.
ORACLE_SQL = None


def _sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else docs


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language: those without a letter or too far from all centroids go (operator 1).

    Null and empty texts go, null ids don't matter; without a labelled row nothing can be learned and nothing stays.
    """
    production(spark)
    return langid.accepted(docs, langid.train(docs, "doc_id", "text", "lang"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, five-word shingles at 0.8 (operator 9).

    Null ids and texts without words stay; the least id of a group is the one that stays.
    """
    production(spark)
    return minhash.without_duplicates(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents that are mostly benchmark go (operator 8).

    Null and empty texts have nothing to cut; n_chars is counted anew.
    """
    return _sized(decontam.remove_benchmark(docs, table(spark, sf_dir, "benchmark")))


def secret_masks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Owner-specific credentials are masked, widely copied examples stay (operator 7).

    Null and empty texts stay as they are; a null source is one owner; n_chars is counted anew.
    """
    production(spark)
    return _sized(secrets.mask_secrets(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens (operator 10).

    Null and empty texts are the separator alone; null ids and repeated rows are packed like others.
    """
    production(spark)
    return packing.pack(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [("language_id", language), ("near_dedup", near_duplicates), ("decontamination", benchmark), ("secret_scans", secret_masks), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs
