"""Query of operator 10: encode every document, decode the ids, digest both."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ledgermark.llm import bpe
from ledgermark.llm.shared import table

RANKS = "byte_bpe_50k.tiktoken"


def digests(docs: DataFrame, ranks_path: str | None = None, share: int = 1) -> DataFrame:
    """Count and digests of each document's ids and of the text they decode to."""
    return bpe.digests(docs.select("doc_id", "text"), ranks_path or public_tokenizers.path(RANKS), public_tokenizers.PATTERN, "doc_id", share=share)


def op10_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 10 over the whole texts of ``documents``."""
    return digests(table(spark, sf_dir, "documents"))


QUERIES = {"op10_bpe_transducer": op10_bpe_transducer}
