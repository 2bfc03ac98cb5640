"""Raw records and model samples to verified programs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgermark.functions.answers import answer_from_variant, answer_to_label, coerce_answer
from ledgermark.functions.cleanup import (
    definition_prefix,
    definitions_consistent,
    prepend_definitions,
    sanitise_code,
    strip_fences,
)
from ledgermark.functions.numbers import finqa_equal
from ledgermark.functions.programs import run_assignments
from ledgermark.functions.prompts import annotate_prompt, calculation_prompt, definition_prompt, with_few_shot
from ledgermark.operators.joins import join_completions
from ledgermark.operators.scoring import dealt_out
from ledgermark.operators.votes import majority_vote


def render_prompts(examples: DataFrame, step: str = "direct", shots: str | None = None) -> DataFrame:
    """Adds ``prompt``: direct annotation, the definitions step or the calculation step."""
    prompt = {
        "direct": annotate_prompt,
        "definitions": definition_prompt,
        "calculation": lambda: calculation_prompt(F.get("generated", F.lit(0))),
    }[step]()
    return examples.withColumn("prompt", with_few_shot(prompt, shots))


def definition_step(examples: DataFrame, completions: DataFrame, whole_tokens: bool = False) -> DataFrame:
    """Step 1: the definitions in each example's first sample, and whether its program agrees."""
    first = completions.filter(F.col("sample_idx") == 0).select("id", sanitise_code(strip_fences("text")).alias("_t"))
    found = join_completions(examples, first).withColumn("_d", definition_prefix("_t"))
    return found.select(
        *examples.columns,
        F.array(F.coalesce("_d.code", F.lit(""))).alias("generated"),
        F.coalesce(definitions_consistent("_d.values", "program", whole_tokens), F.lit(False)).alias("is_correct"),
    )


def vote_step(examples: DataFrame, completions: DataFrame) -> DataFrame:
    """Run each example's samples, vote, and compare the winner with the answer.

    The samples are voted on by themselves; only winners meet the examples.
    With ``generated`` definitions on the examples, those lead each sample.
    """
    code = sanitise_code(strip_fences("text"))
    samples = completions.select("id", "sample_idx", code.alias("code"))
    if "generated" in examples.columns:
        defs = examples.select("id", F.get("generated", F.lit(0)).alias("_defs"))
        samples = samples.join(defs, "id").select("id", "sample_idx", prepend_definitions("_defs", "code").alias("code"))
    # Wrapped, the id no longer matches the join's partitioning: the vote gets a shuffle of its own,
    # after combining, and adaptive execution is free to split an example with very many samples.
    ran = samples.withColumn("_run", run_assignments("code")).select(
        F.struct("id").alias("_key"), "sample_idx", "code", coerce_answer(F.col("_run.ans")).alias("answer")
    )
    voted = majority_vote(ran, "_key").select(
        F.col("_key.id").alias("id"), F.array("code").alias("_code"), answer_to_label("prediction").alias("executed")
    )
    kept = [c for c in examples.columns if c != "generated"]
    joined = dealt_out(examples.select(*kept).join(voted, "id", "left"))  # a comparison is far more work than its row has bytes
    return joined.select(
        *kept,
        F.coalesce("_code", F.array(F.lit(""))).alias("generated"),
        "executed",
        finqa_equal("executed", answer_from_variant("answer")).alias("is_correct"),
    )
