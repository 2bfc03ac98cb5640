"""Prompts from turn tables (PRM-5 over rows)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgermark.functions.prompts import conversation_head, conversation_tail


def turn_prompts(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", question: str = "text") -> DataFrame:
    """``conv, turn, place, is_first, is_last, prompt``: each turn's piece of the conversation prompt.

    The pieces in order of ``turn`` and ``place`` are the prompt, so a
    conversation of any length is spread over tasks. Equal texts under one turn
    number are one turn; different ones follow each other by text, numbered by
    ``place``. The window stands within a turn number, and a conversation adds
    one row of its ends.
    """
    single = turns.select(conv, turn, question).distinct()
    same = Window.partitionBy(conv, turn)
    placed = single.withColumn("place", F.row_number().over(same.orderBy(question))).withColumn("_of", F.count(F.lit(1)).over(same))
    ends = turns.groupBy(conv).agg(F.min(turn).alias("_lo"), F.max(turn).alias("_hi"))
    rows = placed.join(ends, conv).select(
        conv,
        turn,
        "place",
        ((F.col(turn) == F.col("_lo")) & (F.col("place") == 1)).alias("is_first"),
        ((F.col(turn) == F.col("_hi")) & (F.col("place") == F.col("_of"))).alias("is_last"),
        F.col(question).alias("_q"),
    )
    none = F.lit("")
    second = F.when(F.col("is_first"), none).otherwise(F.lit(" "))
    return rows.select(
        conv,
        turn,
        "place",
        "is_first",
        "is_last",
        F.concat(
            F.when(F.col("is_first"), conversation_head(none, none)).otherwise(none),
            F.when(F.col("is_last"), conversation_tail(F.col("_q"))).otherwise(F.concat(second, F.col("_q"))),
        ).alias("prompt"),
    )


def whole_prompts(pieces: DataFrame, most: int, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """``conv, prompt``: the pieces of ``turn_prompts`` joined, for conversations of up to ``most`` turns; a longer one is an error."""
    return gathered(pieces, [conv], [turn, "place"], "prompt", most)


def gathered(rows: DataFrame, keys: list[str], order: list[str], text: str, most: int, end: Column | None = None) -> DataFrame:
    """``keys, text``: each key's texts joined in order, an error for a key of more than ``most`` rows."""
    counted = rows.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    within = F.when(F.col("_n") <= most, F.col(text)).otherwise(F.raise_error(F.lit(f"more than {most} rows")).cast("string"))
    listed = F.array_sort(F.collect_list(F.struct(*order, within.alias("_t"))))
    joined = F.array_join(F.transform(listed, lambda s: s["_t"]), "")
    return counted.groupBy(*keys).agg((joined if end is None else F.concat(joined, end)).alias(text))
