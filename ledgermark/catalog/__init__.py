"""Queries over the driver tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from importlib import import_module

from ledgermark.catalog.base import ORACLES, QUERIES, Query

_MODULES = ("votes", "texts", "scores", "programs", "corpus", "prompting", "flows")


def _load() -> None:
    for name in _MODULES:
        import_module(f"{__name__}.{name}")


def queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(ORACLES)
