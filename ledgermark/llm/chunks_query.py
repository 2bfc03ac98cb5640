"""Query of operator 6."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermark.llm.chunks import without_repeats
from ledgermark.llm.shared import table


def op6_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 6 over the whole texts of ``documents``: what is left and what was cut."""
    rows = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    lengths = F.aggregate("removed", F.lit(0).cast("bigint"), lambda a, s: a + s["stop"] - s["start"])
    return rows.select("doc_id", "n_chunks", "n_repeated", F.size("removed").alias("n_removed"), lengths.alias("removed_chars"), "removed", "text")


QUERIES = {"op6_chunk_dedup": op6_chunk_dedup}
