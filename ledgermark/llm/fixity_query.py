"""Query of operator 1 and its SQL.

``pages`` becomes WARC archives of 1,024 page ids each. The second replica is
derived from the first with damage that the digest of the page's id decides:
one record in 256 is lost, one has a character changed, one is cut short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgermark.llm.fixity import audit, record_hashes, warc_record
from ledgermark.llm.shared import saved, table

PER_ARCHIVE = 1024


def replicas(pages: DataFrame) -> DataFrame:
    """``replica, archive, offset, record_id, data`` of both replicas."""
    data = warc_record(F.col("url"), F.col("html"))
    lengths = pages.select("page_id", F.octet_length(data).cast("bigint").alias("length"))
    archive = F.floor(F.col("page_id") / PER_ARCHIVE)
    before = Window.partitionBy("archive").orderBy("page_id").rowsBetween(Window.unboundedPreceding, -1)
    offsets = lengths.withColumn("archive", archive).select("page_id", "archive", F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset"))
    # only ids and offsets move; hashes are made where the records are read
    fate = F.substring(F.md5(F.col("page_id").cast("string").cast("binary")), 1, 2)
    cut = F.expr("substring(data, 1, cast(length(data) div 2 as int))")
    flipped = F.expr("concat(substring(data, 1, 100), '?', substring(data, 102))")
    rows = pages.select("page_id", data.alias("data")).withColumn("fate", fate)
    copies = F.array(
        F.struct(F.lit("a").alias("replica"), F.col("data")),
        F.struct(F.lit("b").alias("replica"), F.when(F.col("fate") == "01", flipped).when(F.col("fate") == "02", cut).otherwise(F.col("data")).alias("data")),
    )
    rows = rows.select("page_id", "fate", F.inline(copies)).filter("not (replica = 'b' and fate = '00')")
    placeless = rows.select("replica", F.lit(None).cast("string").alias("archive"), F.lit(None).cast("bigint").alias("offset"), F.col("page_id").alias("record_id"), "data")
    hashes = record_hashes(placeless).drop("archive", "offset")
    return saved(hashes.join(offsets.withColumnRenamed("page_id", "record_id"), "record_id"), "records").select(
        "replica", F.col("archive").cast("string").alias("archive"), "offset", "record_id", "length", "sha256"
    )


def op1_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 1 over all ``pages``: the damage in replica b against replica a."""
    return audit(replicas(table(spark, sf_dir, "pages")), "a", "b")


ORACLES = {
    "op1_merkle_fixity": r"""
WITH records AS (
  SELECT page_id, page_id // 1024 AS archive, substr(md5(page_id::VARCHAR), 1, 2) AS fate,
    concat('WARC/1.0', chr(13), chr(10), 'WARC-Type: response', chr(13), chr(10), 'WARC-Target-URI: ', coalesce(url, ''), chr(13), chr(10),
      'Content-Length: ', strlen(coalesce(html, '')), chr(13), chr(10), chr(13), chr(10), coalesce(html, ''), chr(13), chr(10), chr(13), chr(10)) AS data
  FROM pages
), placed AS (
  SELECT *, coalesce(sum(strlen(data)) OVER (PARTITION BY archive ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM records
), paired AS (
  SELECT *, CASE fate WHEN '00' THEN NULL WHEN '01' THEN concat(substr(data, 1, 100), '?', substr(data, 102))
    WHEN '02' THEN substr(data, 1, length(data) // 2) ELSE data END AS other FROM placed
)
SELECT archive::VARCHAR AS archive, ("offset" + 1) // 65536 * 65536 AS range_start, "offset", page_id AS record_id,
  CASE WHEN other IS NULL THEN 'missing' ELSE 'changed' END AS kind,
  strlen(data) AS length_one, strlen(other) AS length_other, sha256(data) AS sha256_one, sha256(other) AS sha256_other
FROM paired WHERE other IS DISTINCT FROM data"""
}

QUERIES = {"op1_merkle_fixity": op1_merkle_fixity}
