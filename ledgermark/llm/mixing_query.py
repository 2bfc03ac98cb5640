"""Query of operator 7 and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgermark.llm.mixing import mixture_of
from ledgermark.llm.shared import table


def op7_systematic_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 7 over all ``documents``."""
    return mixture_of(table(spark, sf_dir, "documents"))


ORACLES = {
    "op7_systematic_mixture": r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), own AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS turn FROM sized GROUP BY source
), weighed AS (
  SELECT *, [5, 2, 1][turn % 3 + 1] AS weight, 3 * source_size AS held FROM own
), summed AS (
  SELECT *, row_number() OVER o AS place,
    (SELECT sum(source_size) FROM own) - coalesce(sum(held) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    (SELECT sum(weight) FROM weighed) - coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weights
  FROM weighed WINDOW o AS (ORDER BY held::DOUBLE / weight, source NULLS LAST)
), level AS (
  SELECT place, rest, weights FROM summed WHERE rest * weight <= held * weights ORDER BY place LIMIT 1
), aimed AS (
  SELECT s.source, s.source_size,
    coalesce(CASE WHEN s.place < l.place THEN s.held::DOUBLE ELSE l.rest::DOUBLE * s.weight / l.weights END, 0.0) AS target,
    ('0x' || substr(md5('mix' || coalesce('s' || s.source, 'n')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS start
  FROM summed s, level l
), ranked AS (
  SELECT d.doc_id, d.size, a.source_size, a.target, a.start,
    CASE WHEN a.source_size > 0 THEN a.target / a.source_size ELSE 0.0 END AS rate,
    row_number() OVER (PARTITION BY d.source ORDER BY
      length(bin(d.size)) * 8 + (d.size >> greatest(length(bin(d.size)) - 3, 0)),
      substr(md5(coalesce(d.doc_id::VARCHAR, '')), 1, 3), d.doc_id, d.size) AS place
  FROM sized d JOIN aimed a ON d.source IS NOT DISTINCT FROM a.source
)
SELECT doc_id, size, source_size, target,
  (floor(rate * place + start) - floor(rate * (place - 1) + start))::BIGINT * size AS taken
FROM ranked"""
}

QUERIES = {"op7_systematic_mixture": op7_systematic_mixture}
