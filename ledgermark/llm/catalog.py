"""The registered queries of the numbered operators, and their SQL where SQL can say it."""

from __future__ import annotations

from importlib import import_module

from ledgermark.catalog.base import Query

_MODULES = (
    "fixity_query",
    "order_minhash_query",
    "quality_query",
    "language_query",
    "separators_query",
    "chunks_query",
    "mixing_query",
    "url_lists_query",
    "near_dups_query",
    "bpe_query",
    "negatives_query",
    "repair_query",
    "pii_query",
)


def queries() -> dict[str, Query]:
    found: dict[str, Query] = {}
    for name in _MODULES:
        found |= import_module(f"ledgermark.llm.{name}").QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for name in _MODULES:
        found |= getattr(import_module(f"ledgermark.llm.{name}"), "ORACLES", {})
    return found
