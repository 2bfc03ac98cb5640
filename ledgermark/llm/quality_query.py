"""Query of operator 3."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgermark.llm import quality
from ledgermark.llm.shared import saved, table


def op3_adaptive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 3 over the whole texts of ``documents``; texts are counted once."""
    counted = quality.with_counts(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")).drop("text")
    counted = saved(counted, "quality-counts")
    rows = quality.judged(counted, quality.thresholds(counted))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES = {"op3_adaptive_quality": op3_adaptive_quality}
