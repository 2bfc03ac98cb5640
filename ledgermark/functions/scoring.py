"""Exact match and token F1 over answer strings (SCO-1..6, SET-2, SET-3, AGG-10)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgermark.functions.common import ColumnOrName, as_col, bind
from ledgermark.functions.numbers import is_number
from ledgermark.functions.text import normalise_answer


def token_bag(normalised: ColumnOrName) -> Column:
    """Distinct tokens of a normalised string."""
    return F.array_distinct(F.filter(F.split(as_col(normalised), " "), lambda t: t != ""))


def answer_bags(spans: ColumnOrName) -> Column:
    """SCO-1: struct of the normalised spans and the token bag of each."""
    return bind(
        F.transform(as_col(spans), normalise_answer),
        lambda norm: F.struct(norm.alias("spans"), F.transform(norm, token_bag).alias("bags")),
    )


def bag_overlap(a: ColumnOrName, b: ColumnOrName) -> Column:
    """SET-2: size of the intersection of two token sets."""
    return F.size(F.array_intersect(as_col(a), as_col(b)))


def same_span_set(a: ColumnOrName, b: ColumnOrName) -> Column:
    """SET-3: equal as sets and of equal length."""
    x, y = as_col(a), as_col(b)
    return (F.size(x) == F.size(y)) & (F.array_sort(F.array_distinct(x)) == F.array_sort(F.array_distinct(y)))


def bag_f1(pred: ColumnOrName, gold: ColumnOrName) -> Column:
    """SCO-2: F1 of two token sets; an empty side counts as fully right."""
    p, g = as_col(pred), as_col(gold)

    def combine(n: Column) -> Column:
        precision = F.when(F.size(p) == 0, F.lit(1.0)).otherwise(F.try_divide(n, F.size(p).cast("double")))
        recall = F.when(F.size(g) == 0, F.lit(1.0)).otherwise(F.try_divide(n, F.size(g).cast("double")))
        return F.coalesce(F.try_divide(F.lit(2.0) * precision * recall, precision + recall), F.lit(0.0))

    return bind(bag_overlap(p, g).cast("double"), combine)


def aligned_f1(pred: ColumnOrName, gold: ColumnOrName) -> Column:
    """SCO-3: F1 of one token bag against one, which is all the scoring flow aligns (STR-9 gives one string a side)."""
    return bag_f1(pred, gold)


def numbers_agree(gold: ColumnOrName, pred: ColumnOrName) -> Column:
    """SCO-4: the gold bag has no numbers, or shares one with the prediction."""
    g = F.filter(as_col(gold), is_number)
    p = F.filter(as_col(pred), is_number)
    return (F.size(g) == 0) | F.arrays_overlap(g, p)


def round2(f1: Column) -> Column:
    """Two decimals the way arrays are rounded: scale, ties to even, unscale."""
    return F.rint(f1 * F.lit(100.0)) / F.lit(100.0)


def em_f1(pred: ColumnOrName, gold: ColumnOrName) -> Column:
    """SCO-5: struct of exact match and rounded F1 for one answer string against one."""
    return bind(
        F.struct(normalise_answer(pred).alias("p"), normalise_answer(gold).alias("g")),
        lambda s: F.struct(
            (s["p"] == s["g"]).cast("double").alias("em"), round2(aligned_f1(token_bag(s["p"]), token_bag(s["g"]))).alias("f1")
        ),
    )


def best_over_pairs(preds: ColumnOrName, golds: ColumnOrName) -> Column:
    """AGG-10: lexicographically best (EM, F1) over all pairs of strings, (0, 0) if none."""

    def scored(lists: Column) -> Column:
        return F.array_max(
            F.flatten(
                F.transform(
                    lists["p"],
                    lambda a: F.transform(
                        lists["g"],
                        lambda b: F.struct(
                            (a == b).cast("double").alias("em"),
                            round2(bag_f1(token_bag(a), token_bag(b))).alias("f1"),
                        ),
                    ),
                )
            )
        )

    normalised = F.struct(
        F.transform(as_col(preds), normalise_answer).alias("p"),
        F.transform(as_col(golds), normalise_answer).alias("g"),
    )
    return F.coalesce(bind(normalised, scored), F.struct(F.lit(0.0).alias("em"), F.lit(0.0).alias("f1")))


def gold_answers(answer_type: ColumnOrName, answers: ColumnOrName) -> Column:
    """SCO-6: answer strings to compare; a count is shown as an integer.

    ``answers`` is the gold answer as a list of strings, one item for every
    type but the spans. A list given for a single-valued type is compared as
    the text of that list, brackets and quotes included.
    """
    kind, items = as_col(answer_type), as_col(answers)
    count = F.transform(items, lambda a: F.coalesce(a.try_cast("double").cast("bigint").cast("string"), a))
    return F.when(kind == "count", count).otherwise(items)
