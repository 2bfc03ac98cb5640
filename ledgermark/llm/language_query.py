"""Query of operator 4.

``pages`` holds the page of some documents; its address ends with the
document's id. Each document is judged with the language that most of its pages
declare and the address of its first page, or with its own declared language and
source where it has none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermark.llm import language
from ledgermark.llm.shared import saved, table


def page_evidence(pages: DataFrame) -> DataFrame:
    """``doc_id, markup, url, site``: the language most of a document's pages declare (of equals the one declared first), and its first page's address."""
    number = F.regexp_extract("url", r"/([0-9]{1,18})(?:/|\.html)?(?:[?#].*)?$", 1)
    site = F.regexp_extract("url", r"^[a-z]+://([^/?#:]+)", 1)
    # tag by tag, so that the time is linear whatever a tag's length
    tags = F.regexp_extract_all("html", F.lit(r"(?i)<html[^>]*"), F.lit(0))
    named = F.transform(tags, lambda tag: F.regexp_extract(F.lower(tag), r"(?s)^.*\blang=[\"']?([a-z]+)", 1))
    markup = F.coalesce(F.get(F.filter(named, lambda name: name != ""), F.lit(0)), F.lit(""))
    read = pages.select("page_id", "url", number.alias("number"), site.alias("site"), F.nullif(markup, F.lit("")).alias("markup"))
    read = read.filter("number <> ''").withColumn("doc_id", F.col("number").cast("bigint"))
    each = read.groupBy("doc_id", "markup").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("page_id", "url", "site")).alias("page"))
    most = F.min(F.when(F.col("markup").isNotNull(), F.struct(-F.col("n"), F.col("page.page_id"), F.col("markup").alias("markup")))).alias("most")
    return each.groupBy("doc_id").agg(most, F.min("page").alias("page")).select("doc_id", "most.markup", "page.url", "page.site")


def op4_language_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 4 over the whole texts of ``documents`` with the evidence of ``pages``.

    Texts are read for the model's sample and for the scores; pages are joined to the scores, not to the texts.
    """
    docs = table(spark, sf_dir, "documents")
    pages = page_evidence(table(spark, sf_dir, "pages"))
    names, model = language.train(docs)
    scored = language.text_scores(docs.select(F.col("doc_id").alias("id"), "text", "lang", "source"), names, model)
    found = scored.join(pages.withColumnRenamed("doc_id", "id"), "id", "left").select(
        "id", "row", "letters", "scores", F.coalesce("markup", "lang").alias("declared"), F.col("url").alias("address"), F.coalesce("site", "source").alias("host")
    )
    found = language.fused(saved(language.with_sources(found), "language-evidence"), names)
    return found.select(F.col("id").alias("doc_id"), "declared", "suffix", "host", "text_language", "language", "posterior", "kept")


QUERIES = {"op4_language_fusion": op4_language_fusion}
