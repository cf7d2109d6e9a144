"""The numbered queries: each operator with production parameters over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pairloom.llm.common import table
from pairloom.llm.op10_ngram_join import jaccard_join
from pairloom.llm.op11_hard_negatives import hard_negatives
from pairloom.llm.op12_conversation_repair import conversation_repair
from pairloom.llm.op13_exact_dedup import exact_groups
from pairloom.llm.op1_secret_scans import secret_scans
from pairloom.llm.op2_token_counts import token_counts
from pairloom.llm.op3_packing import packed
from pairloom.llm.op4_lm_scores import lm_scores
from pairloom.llm.op5_mixing import mix_plan
from pairloom.llm.op6_fingerprints import fingerprints
from pairloom.llm.op7_embedding_dedup import near_duplicates
from pairloom.llm.op8_toxicity import toxicity
from pairloom.llm.op9_token_files import token_files
from pairloom.llm.registry import ORACLES, QUERIES, query

__all__ = ["ORACLES", "QUERIES"]


@query("op1_secret_scans")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    return secret_scans(table(spark, sf, "documents"))


@query("op2_token_counts")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    return token_counts(table(spark, sf, "documents"), budget=1024)


@query("op3_packing")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    return packed(table(spark, sf, "documents"))


MIX_SQL = """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), k AS (
  SELECT source, source_size, source_size * 2.0::DOUBLE AS most,
         [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w
  FROM s
), o AS (
  SELECT *, row_number() OVER (ORDER BY most / w, source NULLS LAST) AS r FROM k
), c AS (
  SELECT r, most / w AS ratio, coalesce(sum(most) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
         sum(w) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_w,
         1.5::DOUBLE * sum(source_size) OVER () AS want
  FROM o
), l AS (
  SELECT (want - below) / left_w AS level FROM c WHERE (want - below) / left_w < ratio ORDER BY r LIMIT 1
), t AS (
  SELECT source, source_size, least(most, (SELECT level FROM l) * w) AS target FROM k
), x AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN least(t.target / t.source_size, 2.0::DOUBLE) ELSE 0.0::DOUBLE END AS rate,
         ('0x' || substr(md5('mix:' || coalesce(d.doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       size::BIGINT * (floor(rate)::BIGINT + (u < rate - floor(rate))::BIGINT) AS taken,
       floor(rate)::BIGINT + (u < rate - floor(rate))::BIGINT AS copies
FROM x
"""


@query("op5_mixing", MIX_SQL)
def op5(spark: SparkSession, sf: str) -> DataFrame:
    return mix_plan(table(spark, sf, "documents"))


@query("op9_token_files")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    return token_files(table(spark, sf, "documents"))


@query("op8_toxicity")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("op4_lm_scores")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    return lm_scores(table(spark, sf, "documents"))


@query("op6_fingerprints")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    return fingerprints(table(spark, sf, "documents"))


@query("op10_ngram_join")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard_join(table(spark, sf, "documents"))


@query("op7_embedding_dedup")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates(table(spark, sf, "embeddings"), cosine=0.9)


EXACT_SQL = """
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       row_number() OVER w = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW w AS (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
"""


@query("op13_exact_dedup", EXACT_SQL)
def op13(spark: SparkSession, sf: str) -> DataFrame:
    return exact_groups(table(spark, sf, "documents"))


@query("op12_conversation_repair")
def op12(spark: SparkSession, sf: str) -> DataFrame:
    return conversation_repair(table(spark, sf, "conversations"))


NEGATIVES_SQL = """
WITH e AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM e a JOIN e b ON a.id % 100 = 0 AND a.id <> b.id AND len(a.v) = len(b.v)
), p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, n.id AS negative_id,
       p.positive_score, n.score AS negative_score
FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same
  AND 80 * p.positive_score <= 100 * n.score AND n.score <= p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.id)
QUALIFY row_number() OVER w <= 5
"""


@query("op11_hard_negatives", NEGATIVES_SQL)
def op11(spark: SparkSession, sf: str) -> DataFrame:
    return hard_negatives(table(spark, sf, "embeddings"))
