"""Fine-tuning targets: unit rename, label mask, truncation (SFT-1..3)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgermark.functions.common import ColumnOrName, as_col, last_of

IGNORED_LABEL = -100
CUTOFF = 3072


def rename_unit_target(code: ColumnOrName) -> Column:
    """SFT-1: an assignment to ``units`` on any line but the first goes to ``scale``."""
    return F.replace(as_col(code), F.lit("\nunits = "), F.lit("\nscale = "))


def truncate_ids(ids: ColumnOrName, cutoff: int = CUTOFF) -> Column:
    return F.slice(as_col(ids), 1, cutoff)


def truncate_append_eos(ids: ColumnOrName, eos: int, cutoff: int = CUTOFF) -> Column:
    """SFT-3: struct of input ids cut at ``cutoff`` with the end mark if there is room, and the mask."""
    cut = truncate_ids(ids, cutoff)
    room = (F.size(cut) < cutoff) & (F.coalesce(last_of(cut), F.lit(eos - 1)) != eos)
    full = F.when(room, F.array_append(cut, F.lit(eos))).otherwise(cut)
    return F.struct(full.alias("input_ids"), F.transform(full, lambda _: F.lit(1)).alias("attention_mask"))


def mask_labels(ids: ColumnOrName, prompt_len: ColumnOrName | int) -> Column:
    """SFT-2: labels with the prompt positions set to the ignored value."""
    n = F.lit(prompt_len) if isinstance(prompt_len, int) else as_col(prompt_len)
    return F.transform(as_col(ids), lambda t, i: F.when(i < n, F.lit(IGNORED_LABEL)).otherwise(t))


def teaches_nothing(labels: ColumnOrName) -> Column:
    """Flag for rows whose prompt fills the cutoff, leaving no label to learn."""
    return ~F.exists(as_col(labels), lambda t: t != IGNORED_LABEL)
