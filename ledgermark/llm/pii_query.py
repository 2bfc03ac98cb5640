"""Query of operator 13."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermark.llm import pii
from ledgermark.llm.shared import table


def digests(docs: DataFrame) -> DataFrame:
    rows = pii.personal_data(docs.select("doc_id", "text"))
    counts = [F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{kind}") for k, kind in enumerate(pii.KINDS)]
    return rows.select("doc_id", *counts, F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


def op13_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 13 over the whole texts of ``documents``."""
    return digests(table(spark, sf_dir, "documents"))


QUERIES = {"op13_bootstrapped_pii": op13_bootstrapped_pii}
