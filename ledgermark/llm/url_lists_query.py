"""Query of operator 8 and its SQL.

``pages`` has no fetch times and no lists, so both are derived from it: a fetch
time within thirty days from the digest of the page's id, and dated entries
for hosts and pages whose digest says so, some of them lifted and set again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermark.llm.shared import table
from ledgermark.llm.url_lists import evaluate

LISTS = ["malware", "spam", "trusted"]
DAY_0 = 1_700_000_000
SPAN = 30 * 86_400


def _digits(text: Column, start: int, n: int) -> Column:
    return F.conv(F.substring(F.md5(text.cast("binary")), start, n), 16, 10).cast("bigint")


def captures(pages: DataFrame) -> DataFrame:
    second = F.lit(DAY_0) + _digits(F.col("page_id").cast("string"), 1, 8) % SPAN
    return pages.select("page_id", "url", F.timestamp_seconds(second).alias("fetched_at"))


def list_entries(pages: DataFrame) -> DataFrame:
    """Entries for a share of the hosts and pages: set, lifted and set again at times from their digest."""
    bare = F.regexp_replace(F.regexp_replace(F.col("url"), "^[a-z]+://", ""), "[?#].*$", "")
    bare = F.regexp_replace(bare, "/+$", "")
    named = pages.select(F.explode(F.array(F.regexp_replace(bare, "/.*$", ""), bare)).alias("pattern")).distinct()
    listed = named.withColumn("list", F.explode(F.array(*map(F.lit, LISTS)))).withColumn("name", F.concat("list", "pattern"))
    listed = listed.filter(_digits(F.col("name"), 1, 1) < 3)
    first = F.lit(DAY_0) + _digits(F.col("name"), 2, 6) % SPAN
    steps = [(True, first), (False, first + _digits(F.col("name"), 8, 5)), (True, first + _digits(F.col("name"), 8, 5) + _digits(F.col("name"), 13, 5))]
    dated = F.array(*[F.struct(F.lit(adds).alias("adds"), F.timestamp_seconds(at).alias("at")) for adds, at in steps])
    return listed.select("list", "pattern", F.inline(dated))


def op8_temporal_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 8: every page of ``pages`` against the entries in force when it was fetched."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    found = evaluate(captures(pages), list_entries(pages), LISTS, allow=["trusted"])
    return found.select("page_id", "url", F.unix_seconds("fetched_at").alias("fetched_at"), F.array_join("lists", ",").alias("lists"), "blocked", "pattern")


ORACLES = {
    "op8_temporal_url_lists": r"""
WITH bare AS (
  SELECT DISTINCT regexp_replace(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), '/+$', '') AS page FROM pages
), named AS (
  SELECT page AS pattern FROM bare UNION SELECT regexp_replace(page, '/.*$', '') FROM bare
), listed AS (
  SELECT pattern, list, md5(list || pattern) AS h FROM named, (SELECT unnest(['malware', 'spam', 'trusted']) AS list)
  WHERE ('0x' || substr(md5(list || pattern), 1, 1))::BIGINT < 3
), dated AS (
  SELECT *, 1700000000 + ('0x' || substr(h, 2, 6))::BIGINT % 2592000 AS t0, ('0x' || substr(h, 8, 5))::BIGINT AS a, ('0x' || substr(h, 13, 5))::BIGINT AS b FROM listed
), spans AS (
  SELECT lower(pattern) AS pattern, list, t0 AS since, CASE WHEN a = 0 THEN NULL ELSE t0 + a END AS until FROM dated
  UNION ALL
  SELECT lower(pattern), list, t0 + a + b, NULL FROM dated WHERE a > 0 AND b > 0
  UNION ALL
  SELECT lower(pattern), list, t0 + a, NULL FROM dated WHERE a > 0 AND b = 0
), captured AS (
  SELECT DISTINCT page_id, url, 1700000000 + ('0x' || substr(md5(page_id::VARCHAR), 1, 8))::BIGINT % 2592000 AS fetched_at,
    lower(regexp_extract(url, '://([^/?#:]+)', 1)) AS host,
    lower(regexp_replace(regexp_extract(url, '://[^/?#:]+([^?#]*)', 1), '/+$', '')) AS path
  FROM pages
), keyed AS (
  SELECT page_id, url, fetched_at, 0 AS level, host || path AS key FROM captured WHERE path <> ''
  UNION ALL
  SELECT page_id, url, fetched_at, i + (path <> '')::INT - 1, array_to_string(string_split(host, '.')[i:], '.') FROM captured, unnest(range(1, len(string_split(host, '.')) + 1)) t(i)
), per AS (
  SELECT k.page_id, k.url, k.fetched_at, min(level) AS level, arg_min(key, level) AS pattern, list_sort(list_distinct(list(s.list))) AS found
  FROM keyed k JOIN spans s ON s.pattern = k.key AND k.fetched_at >= s.since AND (s.until IS NULL OR k.fetched_at < s.until)
  GROUP BY k.page_id, k.url, k.fetched_at
)
SELECT c.page_id, c.url, c.fetched_at, coalesce(array_to_string(p.found, ','), '') AS lists,
  coalesce(list_has_any(p.found, ['malware', 'spam']) AND NOT list_contains(p.found, 'trusted'), false) AS blocked, p.pattern
FROM captured c LEFT JOIN per p ON p.page_id = c.page_id AND p.url = c.url AND p.fetched_at = c.fetched_at"""
}

QUERIES = {"op8_temporal_url_lists": op8_temporal_url_lists}
