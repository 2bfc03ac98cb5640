"""Query of operator 12 and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgermark.llm.repair import damaged, repaired
from ledgermark.llm.shared import table


def op12_lightest_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 12 over all damaged ``conversations``."""
    return repaired(damaged(table(spark, sf_dir, "conversations")))


ORACLES = {
    "op12_lightest_repair": r"""
WITH RECURSIVE crc AS (
  SELECT list(v ORDER BY i) AS tbl FROM (
    SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v
    FROM (SELECT range::BIGINT AS i FROM range(256)))
), fated AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
        list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda ch: ord(ch)::BIGINT)),
      lambda a, b: xor(a >> 8, tbl[(xor(a, b) & 255) + 1]))) % 20 AS fate
  FROM conversations, crc
), rows_after AS (
  SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
    CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE WHEN fate = 3 THEN 2 ELSE 1 END)) AS copy
  FROM fated WHERE fate <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos FROM rows_after
), faulty AS (
  SELECT *, left(role, 1) AS initial, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS again
  FROM placed
), judged AS (
  SELECT conv_id, turn, pos, role, text, initial, bare = '' AS blank, bare <> '' AND again AS duplicate,
    bare <> '' AND NOT again AND right(bare, 1) NOT IN ('.', '!', '?') AS truncated,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY pos) || initial AS pair
  FROM faulty
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
    count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(pos) AS n
  FROM judged GROUP BY conv_id
), moves(q, initial, r) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)
), inserts(q, p, k) AS (VALUES (0, 0, 0), (1, 1, 0), (2, 2, 0), (3, 3, 0), (0, 2, 1), (0, 3, 2), (1, 2, 1), (1, 3, 2), (2, 3, 1), (3, 2, 1)
), edits AS (
  SELECT j.conv_id, j.pos, q, q AS r, 2 AS cost, 'D' AS letter FROM judged j, (VALUES (0), (1), (2), (3)) AS states(q)
  UNION ALL
  SELECT j.conv_id, j.pos, q, r, CASE WHEN truncated THEN 5 ELSE 0 END, 'K' FROM judged j JOIN moves m ON m.initial = j.initial WHERE NOT (blank OR duplicate)
  UNION ALL
  SELECT j.conv_id, j.pos, q, r, CASE WHEN truncated THEN 6 ELSE 1 END, 'R' FROM judged j JOIN moves m ON m.initial <> 's' WHERE NOT (blank OR duplicate)
), steps AS (
  SELECT conv_id, 0::BIGINT AS pos, 0 AS q, 0 AS cost, '' AS audit FROM counts
  UNION ALL
  SELECT conv_id, pos, r, cost, audit FROM (
    SELECT *, row_number() OVER (PARTITION BY conv_id, r ORDER BY cost, audit) AS place FROM (
      SELECT s.conv_id, e.pos, e.r, s.cost + 5 * i.k + e.cost AS cost, s.audit || repeat('I', i.k) || e.letter AS audit
      FROM steps s JOIN inserts i ON i.q = s.q JOIN edits e ON e.conv_id IS NOT DISTINCT FROM s.conv_id AND e.pos = s.pos + 1 AND e.q = i.p))
  WHERE place = 1
), goals AS (
  SELECT s.conv_id, s.cost + 5 * i.k AS cost, s.audit || repeat('I', i.k) AS audit
  FROM steps s JOIN counts c ON c.conv_id IS NOT DISTINCT FROM s.conv_id AND s.pos = c.n JOIN inserts i ON i.q = s.q AND i.p IN (0, 3)
  QUALIFY row_number() OVER (PARTITION BY s.conv_id ORDER BY s.cost + 5 * i.k, s.audit || repeat('I', i.k)) = 1
), letters AS (
  SELECT conv_id, unnest(string_split(audit, '')) AS letter, unnest(range(1, length(audit) + 1)) AS k FROM goals
), numbered AS (
  SELECT *, count(*) FILTER (letter <> 'I') OVER w AS pos, count(*) FILTER (letter <> 'D') OVER w AS o
  FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY k)
), out_rows AS (
  SELECT n.conv_id, n.k, n.o, n.letter, j.role, j.text, max(CASE WHEN n.o = 1 AND n.letter = 'K' AND j.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY n.conv_id) AS led
  FROM numbered n LEFT JOIN judged j ON j.conv_id IS NOT DISTINCT FROM n.conv_id AND j.pos = n.pos WHERE n.letter <> 'D'
), texts AS (
  SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (o - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' ||
    CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY k) AS repaired
  FROM out_rows GROUP BY conv_id
)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN goals g ON g.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM a.conv_id"""
}

QUERIES = {"op12_lightest_repair": op12_lightest_repair}
