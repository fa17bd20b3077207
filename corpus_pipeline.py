"""A corpus pipeline: quality rules, near-duplicates, benchmark decontamination, mixing, token files.

Every stage takes what its predecessor kept, written as Parquet and read again. All but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from basketry.llm import decontaminate, mixing, near, quality, tokens
from basketry.llm.common import read, stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the fixed rules and the cutoffs of their language and source keep."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (Jaccard 0.8 of five-word shingles), the one with the smallest doc_id.

    SimHash balls and MinHash bands show which documents may have near ones, and every link is verified.
    """
    return near.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark text, neither as it is nor with other values."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.resampled(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token-id files of all documents, and each document's place in them as read back."""
    return tokens.encoded(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing", mix),
    ("token files", token_files),
]

#: Fingerprints, template matches, rounding and tokenizers have no SQL; tests/llm/test_pipeline.py compares with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; the rows of the last."""
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"stage-{k}")
    return docs
