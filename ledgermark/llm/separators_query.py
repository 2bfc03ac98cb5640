"""Query of operator 5: token files of all documents, scanned for their separators."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ledgermark.llm import separators
from ledgermark.llm.shared import table

RANKS = "byte_bpe_50k.tiktoken"
END = 50256  # the free id of that file


def op5_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 5: the token count of every document, from flat files of all ``documents``."""
    ids_of = separators.tiktoken_ids(public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    folder, order = separators.write_token_files(table(spark, sf_dir, "documents"), ids_of, END)
    found = separators.separators(separators.token_blocks(order, folder), folder, END)
    return separators.documents(found).join(order, ["file", "ordinal"]).select("doc_id", "n_tokens", "closed")


QUERIES = {"op5_separator_scan": op5_separator_scan}
