"""From raw documents to packed training sequences.

Each stage takes the documents that its predecessor kept.  All but the last return the
columns of documents; the last returns one row for each packed piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terrella.llm import near_dup, packing, quality, rules, substring
from terrella.llm.scratch import materialize
from terrella.session import share_code, table


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    share_code(spark)
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def regular(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    share_code(spark)
    return rules.keep_regular(docs, table(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: five-word shingles, similarity 0.8."""
    share_code(spark)
    return near_dup.drop_near_duplicates(docs)


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that an earlier one has."""
    share_code(spark)
    return substring.remove_repeats(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents with their sequences and places."""
    share_code(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("quality_classifier", good),
    ("quality_rules", regular),
    ("near_dedup", distinct),
    ("substring_dedup", unrepeated),
    ("best_fit_packing", packed),
]
#: No SQL expresses the stages; tests/llm compares them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``, each one's result written in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
