"""The queries opN_<name>: each applies one operator to its whole table and returns its whole result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terrella.session import table

from . import kneser_ney, langid, near_dup, packing, pieces, quality, rules, sharding, substring, topk


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups: three-word shingles, links at 85 of 100."""
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, num=85, den=100)


def op2_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), leaves=8)


def op3_ball_tree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), every=50, k=5)


def op4_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bigrams: all n-grams of the training rows are kept, and those of order 2 fit the disk allowed."""
    return kneser_ney.score_documents(table(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids (and the end id) in as few rows of 1024 as best-fit decreasing gives."""
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that an earlier document has too: one row for each, with both doc_ids."""
    return substring.repeats(table(spark, sf_dir, "documents"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(table(spark, sf_dir, "documents"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


_ALL = (
    op1_minhash_near_dedup, op2_kd_sharding, op3_ball_tree_topk, op4_kneser_ney, op5_best_fit_packing,
    op6_substring_dedup, op7_sentencepiece, op8_quality_classifier, op9_language_id, op10_quality_rules,
)
QUERIES = {f.__name__: f for f in _ALL}
#: The rest has no SQL: minima, trees, models and packings are checked against brute force in tests/llm.
ORACLE_SQL: dict[str, str] = {
    "op3_ball_tree_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""",
}
