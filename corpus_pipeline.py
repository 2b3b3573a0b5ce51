"""The corpus pipeline: documents through quality rules, line dedup, near-dedup, secret scans and packing.

Every stage works on what its predecessor kept. All but the last return the columns of ``documents``; the last returns
the packed pieces of the documents that are left, with their ids and places.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitemigrate.llm import line_dedup, packing, quality, secret_scan, simhash
from sitemigrate.llm.common import WORD, materialize, read_table
from sitemigrate.llm.queries import vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the boosted trees keep; the trees learn from ``labels``."""
    return quality.keep_good(docs, quality.train(docs, read_table(spark, sf_dir, "labels")))


def line_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat an earlier passage; one that has lost lines and has no word left goes."""
    left = line_dedup.dedup_lines(spark, docs).filter((F.col("n_removed") == 0) | F.col("text").rlike(WORD))
    return _with_length(left, docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component, that with the smallest id."""
    return simhash.drop_near_duplicates(spark, docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mask."""
    return _with_length(secret_scan.redact(docs, secret_scan.train(docs)), docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences of 4096 tokens."""
    return packing.pack_documents(spark, docs, vocabulary(), with_ids=True)


def _with_length(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``n_chars`` follows the text."""
    return docs.select(*(F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in columns))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_windows),
    ("SimHash near-dedup", near_duplicates),
    ("secret scans", secrets),
    ("best-fit packing", best_fit_packing),
]

#: The trees, the fingerprints, the Markov models and the tokenizer are beyond SQL; tests hold the result against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(spark, docs, f"stage_{i}")
    return docs
