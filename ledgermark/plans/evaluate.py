"""Predictions against gold, and trained-model samples against answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ledgermark.functions.answers import (
    answer_to_label,
    coerce_answer,
    finalise_scaled,
    number_answer,
    prediction_to_program,
)
from ledgermark.functions.cleanup import after_marker, sanitise_code
from ledgermark.functions.numbers import finqa_equal
from ledgermark.functions.programs import run_assignments
from ledgermark.operators.joins import join_predictions
from ledgermark.operators.metrics import breakdown_from, evaluation_cells, listed_reports, overall_from, percentages, pivot_from
from ledgermark.operators.scoring import explode_gold, score_predictions
from ledgermark.operators.votes import majority_vote, vote_pair

PERCENT_COLUMNS = ["em", "f1", "scale_em"]

# one item of a printed list: a quoted string, or anything up to the next comma
_LIST_ITEM = r"""('(?:[^'\\]|\\.)*+'|"(?:[^"\\]|\\.)*+"|[^,\s'"][^,]*)"""


def evaluate_predictions(gold_documents: DataFrame, predictions: DataFrame, strict_compat: bool = False) -> dict[str, DataFrame]:
    """SCO-8: the scored rows, the few ``cells`` of one pass over them, and every report cut from those.

    ``listed`` holds all reports in one result and reads the rows once. The
    others are one report each; write ``cells`` to make several without scoring again.
    """
    scored = score_predictions(join_predictions(explode_gold(gold_documents), predictions), strict_compat)
    return {"scored": scored} | evaluation_reports(evaluation_cells(scored), {"pred_op", "gold_op"} <= set(scored.columns))


def evaluation_reports(cells: DataFrame, with_ops: bool = True) -> dict[str, DataFrame]:
    """Every report that ``evaluation_cells``, or a table written of them, holds."""
    overall = overall_from(cells)
    reports = {
        "cells": cells,
        "listed": listed_reports(cells) if with_ops else listed_reports(cells).filter("report <> 'by_op'"),
        "overall": overall,
        "percent": percentages(overall, PERCENT_COLUMNS),
        "em_by_type": pivot_from(cells, "em"),
        "f1_by_type": pivot_from(cells, "f1"),
        "count_by_type": pivot_from(cells, None),
        "by_scale": breakdown_from(cells, "scale"),
    }
    return reports | {"by_op": breakdown_from(cells, "gold_op")} if with_ops else reports


def write_scored(scored: DataFrame, path: str) -> dict:
    """Write the scored rows as JSON lines; ``total, em, f1, scale_em`` observed on the way, without another pass."""
    totals = Observation()
    scored.observe(
        totals,
        F.count(F.lit(1)).alias("total"),
        F.coalesce(F.avg("em"), F.lit(0.0)).alias("em"),
        F.coalesce(F.avg("f1"), F.lit(0.0)).alias("f1"),
        F.coalesce(F.avg(F.coalesce("scale_em", F.lit(False)).cast("int")), F.lit(0.0)).alias("scale_em"),
    ).write.mode("overwrite").json(path)
    return totals.get


def predict_from_outputs(outputs: DataFrame, marker: str = "#Python:\n", which: int = -1, until: str = "\n\n", many_samples: bool = True) -> DataFrame:
    """``id, executed`` from decoded model outputs (``id, sample_idx, text``): cut, run, vote, label."""
    code = F.replace(after_marker("text", marker, which, until), F.lit("!"), F.lit("")) if many_samples else after_marker("text", marker, which, until)
    ran = outputs.select("id", "sample_idx", run_assignments(code).alias("_run")).select(
        "id", "sample_idx", coerce_answer(F.col("_run.ans")).alias("answer")
    )
    return majority_vote(ran, code_col=None).select("id", answer_to_label("prediction").alias("executed"))


def check_predictions(examples: DataFrame, predicted: DataFrame, include_percentage: bool = False) -> DataFrame:
    """Examples (``answer`` tagged or numeric) with their prediction and whether it is right."""
    answer = F.col("answer") if "struct" in dict(examples.dtypes)["answer"] else number_answer("answer")
    return examples.join(predicted, "id", "left").withColumn(
        "is_correct", finqa_equal("executed", answer, include_percentage)
    )


def conversation_submission(predicted: DataFrame) -> DataFrame:
    """``id, prediction, predicted``: the prediction as a one-step program."""
    return predicted.select("id", F.col("executed.text").alias("prediction"), prediction_to_program("executed").alias("predicted"))


def scaled_submission(outputs: DataFrame, marker: str = "#Python\n", unit: str = "units") -> DataFrame:
    """``uid, pred, pred_scale`` from decoded outputs: run for answer and unit, vote on each, finalise."""
    run = run_assignments(sanitise_code(after_marker("text", marker, 2)), ("ans", unit))
    ran = outputs.select("id", "sample_idx", run.alias("_r")).select(
        "id", "sample_idx", F.col("_r.ok").alias("ok"), F.col("_r.ans.text").alias("answer_text"), F.col(f"_r.{unit}.text").alias("unit")
    )
    voted = vote_pair(ran)
    # a list prints as Python source; its items are read back from the text, commas in quotes kept
    body = F.regexp_extract("answer_text", r"(?s)^\[(.*)\]$", 1)
    listed = F.col("answer_text").rlike(r"(?s)^\[.*\]$")
    found = F.regexp_extract_all(body, F.lit(_LIST_ITEM), F.lit(0))
    items = F.transform(found, lambda s: F.regexp_replace(s, r"(?s)^(['\"])(.*)\1$", "$2"))
    final = finalise_scaled("answer_text", F.when(listed, items), "unit")
    return voted.select(F.col("id").alias("uid"), final.alias("_f")).select("uid", "_f.*")
