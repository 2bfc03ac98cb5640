"""Query of operator 2."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgermark.llm.order_minhash import edited_by_next
from ledgermark.llm.shared import table


def op2_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 2 over the whole texts of ``documents`` and their edited texts."""
    return edited_by_next(table(spark, sf_dir, "documents"))


QUERIES = {"op2_order_minhash": op2_order_minhash}
