"""Clean-up of model-written code and text (CLN-1..7, FLT-2, FLT-3)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgermark.functions.common import ColumnOrName, as_col, bind, split_literal


def strip_fences(text: ColumnOrName, language: str = "python") -> Column:
    """CLN-1: drop every code fence, then every language tag that ends a line."""
    bare = F.replace(as_col(text), F.lit("```"), F.lit(""))
    return F.replace(bare, F.lit(language + "\n"), F.lit(""))


def sanitise_code(code: ColumnOrName, many_samples: bool = False) -> Column:
    """CLN-2: ampersands become underscores; exclamation marks go when sampling."""
    return F.translate(as_col(code), "&!", "_") if many_samples else F.translate(as_col(code), "&", "_")


def after_marker(text: ColumnOrName, marker: str, which: int = -1, until: str = "\n\n") -> Column:
    """CLN-3: the segment after a marker, up to ``until``.

    ``which`` counts the segments between markers from 1 (or from the end when
    negative); null when there are too few.
    """
    segment = F.try_element_at(split_literal(as_col(text), marker), F.lit(which))
    return F.substring_index(segment, until, 1)


def _lines_while(lines: Column, keep) -> Column:
    """Leading lines that all satisfy ``keep``."""
    stop = F.array_position(F.transform(lines, keep), False)
    return F.slice(lines, F.lit(1), F.when(stop == 0, F.size(lines)).otherwise(stop.cast("int") - 1))


def definition_prefix(code: ColumnOrName) -> Column:
    """CLN-4: struct of the leading definition lines (each ended by a newline) and their values."""

    def build(kept: Column) -> Column:
        return F.struct(
            F.array_join(F.transform(kept, lambda line: F.concat(line, F.lit("\n"))), "").alias("code"),
            F.transform(kept, lambda line: F.replace(F.get(F.split(line, "="), F.lit(1)), F.lit(" "), F.lit(""))).alias("values"),
        )

    lines = F.split(as_col(code), "\n")
    return bind(bind(lines, lambda ls: _lines_while(ls, lambda line: line.contains("="))), build)


def definitions_consistent(values: ColumnOrName, program: ColumnOrName, whole_tokens: bool = False) -> Column:
    """FLT-3: every defined value occurs in the program, as a substring or as a whole token."""
    target = as_col(program)
    if whole_tokens:
        tokens = F.split(F.regexp_replace(target, r"[^\w.\-]+", " "), " ")
        return F.forall(as_col(values), lambda v: F.array_contains(tokens, v))
    return F.forall(as_col(values), lambda v: target.contains(v))


def starts_with_temp(code: ColumnOrName) -> Column:
    """FLT-2: the first line uses an intermediate result."""
    return F.substring_index(as_col(code), "\n", 1).contains("x0")


def indented_body(text: ColumnOrName, prefix: str, suffix: str = "ans = solver()") -> Column:
    """CLN-5: prefix, the first line, the indented lines after it, then a call."""
    lines = F.split(as_col(text), "\n")
    rest = bind(
        lines,
        lambda ls: _lines_while(F.slice(ls, F.lit(2), F.size(ls)), lambda line: line.startswith("    ")),
    )
    body = F.concat(F.array(F.get(lines, F.lit(0))), rest)
    return F.concat(F.lit(prefix), F.array_join(F.transform(body, lambda x: F.concat(x, F.lit("\n"))), ""), F.lit(suffix))


def remove_comments(code: ColumnOrName, keep_indent: bool = True) -> Column:
    """CLN-6: cut each line at the first ``#``, drop empty lines, squeeze blanks.

    ``keep_indent`` leaves leading blanks alone so nested code stays valid;
    without it every run of blanks becomes one.
    """
    lines = F.transform(F.split(as_col(code), "\n"), lambda line: F.substring_index(line, "#", 1))
    kept = F.concat(F.array_join(F.filter(lines, lambda line: line != ""), "\n"), F.lit("\n"))
    if keep_indent:
        squeezed = F.regexp_replace(F.regexp_replace(kept, r"(?<=[^ \n]) +(?=\n)", ""), r"(?<=[^ \n]) {2,}", " ")
        return F.regexp_replace(squeezed, r"^\n+|(?<!\s)\s++$", "")
    # blanks at the very ends go first, then the surrounding whitespace
    return F.regexp_replace(F.regexp_replace(kept, " +", " "), r"^\s+|(?<!\s)\s++$", "")


def prepend_definitions(definitions: ColumnOrName, calculation: ColumnOrName) -> Column:
    """CLN-7: the definitions, a newline, the calculation."""
    return F.concat(as_col(definitions), F.lit("\n"), as_col(calculation))
