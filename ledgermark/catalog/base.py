"""Registry of the queries and their SQL counterparts.

Results hold whole numbers, text and flags only, and a whole number that may be
null is shown as text, so they compare the same through any client.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str, name: str | None = None) -> Callable[[Query], Query]:
    """Register a function, under its own name unless one is given, with the SQL that gives the same rows."""

    def register(fn: Query) -> Query:
        key = name or fn.__name__
        QUERIES[key], ORACLES[key] = fn, sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(amount: str) -> Column:
    """A two-decimal double as a whole number of cents."""
    return F.round(F.col(amount) * 100).cast("bigint")


def ppm(part: Column, whole: Column) -> Column:
    """Whole parts per million, free of floating-point print differences."""
    return F.floor(part * F.lit(1000000) / whole).cast("bigint")


def scaled(value: Column, factor: int) -> Column:
    """A double as a whole number of ``1/factor``."""
    return F.round(value * F.lit(float(factor))).cast("bigint")


def text_of(*parts) -> Column:
    """Concatenate columns and literals as text."""
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])
