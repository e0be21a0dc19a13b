"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import bpe, common, language, mtree, near, packing, quality, resharding, secrets, toxicity, vectors


OP10_SQL = """
WITH v AS (
  SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(c.e) = len(q.e)
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""


OP5_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS e
  FROM embeddings
  WHERE len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), u AS (
  SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS norm FROM v WHERE list_inner_product(e, e) > 0
), pairs AS (
  SELECT x.vec_id AS a, y.vec_id AS b
  FROM u x JOIN u y ON x.vec_id <> y.vec_id AND len(x.e) = len(y.e)
  WHERE list_inner_product(x.e, y.e) / (x.norm * y.norm) >= 0.95
), reach AS (
  SELECT a AS node, b AS other FROM pairs
  UNION
  SELECT r.node, p.b FROM reach r JOIN pairs p ON r.other = p.a
), links AS (
  SELECT a AS vec_id, count(*) AS n FROM pairs GROUP BY a
), least AS (
  SELECT node AS vec_id, min(least(node, other)) AS root FROM reach GROUP BY node
)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(root, vec_id) AS component_id, vec_id = coalesce(root, vec_id) AS kept
FROM embeddings LEFT JOIN links USING (vec_id) LEFT JOIN least USING (vec_id)
"""

OP8_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s
  FROM words
), entries AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets
), pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b
  FROM entries x JOIN entries y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id
  GROUP BY x.doc_id, y.doc_id, x.n, y.n
  HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))
), reach AS (
  SELECT a AS node, b AS other FROM pairs
  UNION
  SELECT r.node, p.b FROM reach r JOIN pairs p ON r.other = p.a
), least AS (
  SELECT node AS doc_id, min(least(node, other)) AS root FROM reach GROUP BY node
)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, coalesce(root, doc_id) AS component_id, doc_id = coalesce(root, doc_id) AS kept
FROM sets LEFT JOIN least USING (doc_id)
"""


def op1_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(common.documents(spark, sf_dir), common.labels(spark, sf_dir), held=2, folds=4, threshold=0.7)


def op2_min_cost_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The old layout keeps each source in one of 16 shards, which a hot source fills."""
    source = F.coalesce(F.col("source"), F.lit(""))
    old = F.pmod(F.crc32(source.cast("binary")), F.lit(16))
    return resharding.reshard(common.documents(spark, sf_dir), old, 16, 16)


def op3_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack_documents(common.documents(spark, sf_dir), path, capacity=2048, end_id=0)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(common.documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(common.embeddings(spark, sf_dir), threshold=0.95)


def op6_nearest_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.assess(common.documents(spark, sf_dir), common.labels(spark, sf_dir), held=0, folds=5, threshold=0.5)


def op7_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(common.documents(spark, sf_dir))
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex",
        F.sha2(secrets.span_text(F.col("found"), 3), 256).alias("base_sha256"), secrets.span_text(F.col("found")).alias("spans"), "n_random",
    )


def op8_hamming_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(common.documents(spark, sf_dir), words=5, num=85, den=100)


def op9_ftrl_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(common.documents(spark, sf_dir), held=2, folds=4)


def op10_mtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.top_k(common.embeddings(spark, sf_dir), k=20, every=20, scale=64.0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pu_quality": op1_pu_quality,
        "op2_min_cost_flow": op2_min_cost_flow,
        "op3_best_fit": op3_best_fit,
        "op4_byte_bpe": op4_byte_bpe,
        "op5_nn_descent": op5_nn_descent,
        "op6_nearest_toxicity": op6_nearest_toxicity,
        "op7_markov_secrets": op7_markov_secrets,
        "op8_hamming_minhash": op8_hamming_minhash,
        "op9_ftrl_language": op9_ftrl_language,
        "op10_mtree": op10_mtree,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op5_nn_descent": OP5_SQL,
        "op8_hamming_minhash": OP8_SQL,
        "op10_mtree": OP10_SQL,
    }
