"""Scoring predictions against gold (SCO-6..8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgermark.functions.numbers import parse_float
from ledgermark.functions.scoring import best_over_pairs, gold_answers
from ledgermark.functions.text import display_answer, percent_variants


def gold_from_variant(answer_type: Column, value: Column) -> Column:
    """Gold answer strings from a VARIANT: span lists item by item, anything else as one text."""
    items = F.try_variant_get(value, "$", "array<string>")
    listed = F.schema_of_variant(value).startswith("ARRAY")
    as_text = F.concat(F.lit("['"), F.array_join(items, "', '"), F.lit("']"))
    return (
        F.when(listed & answer_type.isin("span", "multi-span"), items)
        .when(listed, F.array(as_text))
        .otherwise(F.array(F.try_variant_get(value, "$", "string")))
    )


def explode_gold(documents: DataFrame) -> DataFrame:
    """One row per question of the gold documents, answers as string lists."""
    q = documents.select(F.explode("questions").alias("q")).select("q.*")
    if dict(q.dtypes)["answer"] == "variant":
        q = q.withColumn("answer", gold_from_variant(F.col("answer_type"), F.col("answer")))
    return q


def dealt_out(rows: DataFrame) -> DataFrame:
    """The rows dealt evenly to a set number of tasks.

    Rows to score are short and a tenth of a millisecond's work each, so a split
    or partition sized by its bytes would be minutes of one task. Only a number
    given keeps adaptive execution from putting such partitions together again.
    """
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism))


def score_predictions(joined: DataFrame, strict_compat: bool = False) -> DataFrame:
    """SCO-7: adds ``em, f1, scale_em`` (and ``span_em, span_f1`` when spans are given).

    ``joined`` has ``answer_type, scale, answer array<string>`` and, null where
    missing, ``pred array<string>, pred_scale``. A missing or empty prediction
    scores 0. ``strict_compat`` also scores a lone numeric zero 0.
    """
    joined, pred = dealt_out(joined), F.col("pred")
    missing = pred.isNull() | (F.size(pred) == 0) | ((F.size(pred) == 1) & (F.get(pred, F.lit(0)) == ""))
    if strict_compat:
        missing = missing | ((F.size(pred) == 1) & F.coalesce(parse_float(F.get(pred, F.lit(0))) == 0, F.lit(False)))
    usable = ~F.coalesce(missing, F.lit(True)) & (F.coalesce(F.size("answer"), F.lit(0)) > 0)
    # two layers, so the strings are built once and read by both metrics
    shown = joined.withColumn("_usable", usable).withColumns(
        {
            "_gold": F.when(F.col("_usable"), F.array(display_answer(gold_answers("answer_type", "answer"), "scale"))),
            "_pred": F.when(F.col("_usable"), percent_variants("pred", "pred_scale")),
        }
    )
    best = shown.withColumn("_best", F.when(F.col("_usable"), best_over_pairs("_pred", "_gold")))
    em = F.coalesce("_best.em", F.lit(0.0))
    added = {
        "em": em,
        "f1": F.when(F.col("answer_type").isin("arithmetic", "count"), em).otherwise(F.coalesce("_best.f1", F.lit(0.0))),
        "scale_em": F.col("_usable") & F.coalesce(F.col("scale") == F.col("pred_scale"), F.lit(False)),
    }
    if {"pred_span", "gold_span"} <= set(joined.columns):
        spans = best_over_pairs(F.array(display_answer("pred_span", F.lit(""))), F.array(display_answer("gold_span", F.lit(""))))
        some = F.col("_usable") & (F.coalesce(F.size("pred_span"), F.lit(0)) > 0)
        best = best.withColumn("_span", F.when(some, spans))
        added["span_em"] = F.coalesce("_span.em", F.lit(0.0))
        added["span_f1"] = F.coalesce("_span.f1", F.lit(0.0))
    return best.select(*joined.columns, *[c.alias(n) for n, c in added.items()])
