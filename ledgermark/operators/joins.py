"""Keyed matches (JON-1..3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgermark.functions.common import ColumnOrName, as_col


def join_predictions(gold: DataFrame, pred: DataFrame, key: str = "uid", pos: str | None = None) -> DataFrame:
    """JON-1: every gold row with its prediction, null where there is none.

    ``pred`` holds one row per key; give ``pos`` when it may not, and the last
    one by that column is used. Size decides between a broadcast and a shuffle,
    and adaptive execution splits a hot key of the gold side.
    """
    if pos is not None:
        rest = [c for c in pred.columns if c not in (key, pos)]
        pred = pred.groupBy(key).agg(F.max_by(F.struct(*rest), pos).alias("_p")).select(key, "_p.*")
    return gold.join(pred, key, "left")


def join_completions(examples: DataFrame, completions: DataFrame, key: str = "id") -> DataFrame:
    """JON-2: every example with each of its samples."""
    return examples.join(completions, key, "left")


def without_done(df: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are not among those already written."""
    return df.join(done.select(*keys), keys, "left_anti")


def replicate_formulas(formulas: DataFrame, n: int = 5) -> DataFrame:
    """JON-3: ``n`` numbered attempts per formula; no join."""
    return formulas.withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def distinct_variables(variables: ColumnOrName) -> Column:
    """AGG-11: period suffixes removed, then sorted without repeats."""
    bare = F.transform(
        as_col(variables), lambda v: F.replace(F.replace(v, F.lit("*n-1"), F.lit("")), F.lit("*n"), F.lit(""))
    )
    return F.array_sort(F.array_distinct(bare))
