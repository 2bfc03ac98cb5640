"""Mixed fine-tuning rows with masked labels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgermark.functions.prompts import mixture_prompt
from ledgermark.functions.targets import CUTOFF, mask_labels, rename_unit_target, teaches_nothing, truncate_append_eos, truncate_ids
from ledgermark.operators.shards import shuffle_rows


def build_mixture(rows: DataFrame, data_type: str = "mix") -> DataFrame:
    """PRM-11 and SFT-1: adds ``prompt`` and ``target``."""
    return rows.withColumns(
        {"prompt": mixture_prompt(data_type), "target": rename_unit_target(F.get("generated", F.lit(0)))}
    )


def training_ids(mixture: DataFrame, to_ids: Callable[[Column], Column], eos: int, cutoff: int = CUTOFF, train_on_inputs: bool = False) -> DataFrame:
    """SFT-2 and SFT-3: ``input_ids, attention_mask, labels`` and a flag for rows that teach nothing.

    ``to_ids`` turns a text column into an id array; the prompt's length is that
    of the prompt alone, cut the same way.
    """
    full = mixture.withColumn("_ids", truncate_append_eos(to_ids(F.concat("prompt", "target")), eos, cutoff))
    sized = full.withColumn("_n", F.lit(0) if train_on_inputs else F.size(truncate_ids(to_ids(F.col("prompt")), cutoff)))
    labelled = sized.withColumn("labels", mask_labels("_ids.input_ids", "_n"))
    return labelled.select(
        *mixture.columns, "_ids.*", "labels", teaches_nothing("labels").alias("teaches_nothing")
    )


def training_set(rows: DataFrame, key: str, to_ids: Callable[[Column], Column], eos: int, cutoff: int = CUTOFF, data_type: str = "mix", seed: str = "shuffle") -> DataFrame:
    """The whole flow, in a repeatable random order."""
    ids = training_ids(build_mixture(rows, data_type), to_ids, eos, cutoff)
    return shuffle_rows(ids, key, seed).select(key, "input_ids", "attention_mask", "labels", "teaches_nothing")
