"""Merging result shards and drawing from them (SET-1, WIN-1, SMP-1, SMP-2)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgermark.functions.common import ColumnOrName, as_col
from ledgermark.functions.draws import draw_key


def union_shards(*shards: DataFrame) -> DataFrame:
    """SET-1: bag concatenation; columns missing from a shard are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), shards)


def dedup_keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """WIN-1: the first row of each key by ``order``.

    A minimum, not a window: each map task sends one row per key it saw, so a
    key that holds a third of the table costs one row per task to settle.
    """
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(first).select(*keys, "_row.*").select(*df.columns)


_BIN_DIGITS = 4  # hex digits of a step: 65,536 bins
_DIGITS = 32


def _cut(drawn: DataFrame, n: int) -> tuple[str, int] | None:
    """The digest prefix that holds the ``n``-th smallest digest, and how many rows lie below it; None if there are fewer rows.

    Each step counts the rows of at most 65,536 bins within the prefix found so
    far, and reads digests only. It ends when the prefix is a whole digest or
    holds just the rows that are wanted.
    """
    prefix, below = "", 0
    while len(prefix) < _DIGITS:
        inside = drawn.filter(F.col("_d").startswith(prefix)) if prefix else drawn
        sizes = inside.groupBy(F.substr(F.col("_d"), F.lit(1), F.lit(len(prefix) + _BIN_DIGITS)).alias("bin")).agg(F.count(F.lit(1)).alias("size"))
        upto = F.sum("size").over(Window.partitionBy(F.lit(0)).orderBy("bin")) + below
        found = sizes.withColumn("upto", upto).filter(F.col("upto") >= n).orderBy("bin").limit(1).collect()  # one row
        if not found:
            return None
        prefix, below = found[0]["bin"], found[0]["upto"] - found[0]["size"]
        if found[0]["upto"] == n or found[0]["size"] == 1:
            break
    return prefix, below


def sample_n(df: DataFrame, n: int, key: ColumnOrName, seed: str = "sample") -> DataFrame:
    """SMP-1: ``n`` rows without replacement, the same ones however the data is laid out.

    The rows with the smallest digests of ``key`` are taken: those below a
    digest found by counting, and of equal digests at the cut, which only
    repeated keys have, as many as are wanted, by key. Rows themselves are
    filtered in place and not shuffled.
    """
    if n <= 0:
        return df.limit(0)
    drawn = df.withColumn("_d", draw_key(key, seed))
    cut = _cut(drawn.select("_d"), n)
    if cut is None:
        return df
    prefix, below = cut
    under = drawn.filter(F.substr(F.col("_d"), F.lit(1), F.lit(len(prefix))) < prefix).select(*df.columns)
    # the rows that share the cut: fewer than wanted, or of one key
    at = drawn.filter(F.col("_d").startswith(prefix)).orderBy("_d", as_col(key)).limit(n - below).select(*df.columns)
    return under.unionByName(at)


def shuffle_rows(df: DataFrame, key: ColumnOrName, seed: str = "shuffle") -> DataFrame:
    """SMP-2: a repeatable permutation, sorted by digest across all tasks."""
    return df.orderBy(draw_key(key, seed), as_col(key))
