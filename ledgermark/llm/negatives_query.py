"""Query of operator 11 and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermark.llm.negatives import hard_negatives, quantised
from ledgermark.llm.shared import table


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 11 over all ``embeddings``; the label of every seventh id is wrong by one."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    label = F.col("label").cast("bigint")
    wrong = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))
    return hard_negatives(quantised(wrong), F.col("vec_id") % 100 == 0)


ORACLES = {
    "op11_hard_negatives": r"""
WITH sound AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS vector
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), vectors AS (
  SELECT vec_id, label, vector FROM sound QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY label, vector) = 1
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.vector, b.vector)::BIGINT AS score
  FROM vectors a JOIN vectors b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, p.positive_id,
  row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.other_id)::INTEGER AS rank,
  n.other_id AS negative_id, p.positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same
  AND 30 * p.positive_score <= 100 * n.score AND 100 * n.score <= 90 * p.positive_score
QUALIFY rank <= 10"""
}

QUERIES = {"op11_hard_negatives": op11_hard_negatives}
