"""Table text as column expressions (PRJ-2, PRJ-3, TAB-2, TAB-4, TAB-5, JSN-1)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgermark.functions.common import ColumnOrName, as_col, last_of, split_literal


def gold_text(gold: ColumnOrName) -> Column:
    """PRJ-2: values whose key contains ``text``, joined in map order without a separator."""
    return F.array_join(F.map_values(F.map_filter(as_col(gold), lambda k, _: k.contains("text"))), "")


def table_line(cells: ColumnOrName) -> Column:
    """One table row: cells joined by ``|``, an empty cell shown as a dash."""
    return F.array_join(F.transform(as_col(cells), lambda c: F.when(c == "", F.lit("-")).otherwise(c)), " | ")


def linearise_table(rows: ColumnOrName) -> Column:
    """PRJ-3: one line per non-empty row, each ended by a newline."""
    filled = F.filter(as_col(rows), lambda r: F.size(r) > 0)
    return F.array_join(F.transform(filled, lambda r: F.concat(table_line(r), F.lit("\n"))), "")


def extract_table_block(text: ColumnOrName, label: str = "Table:\n", end: str = "\nEnd Table", which: int = 3) -> Column:
    """TAB-2: the segment after the second table label (the prompt holds two), up to the end label."""
    return F.substring_index(F.try_element_at(split_literal(as_col(text), label), F.lit(which)), end, 1)


def trim_generated_text(text: ColumnOrName, label: str = "Text:\n", stop: str = "Note") -> Column:
    """TAB-4: what follows the last label, cut before the stop word."""
    return F.substring_index(last_of(split_literal(as_col(text), label)), stop, 1)


def table_prompt(variables: ColumnOrName, first_year: ColumnOrName | None = None, last_year: ColumnOrName | None = None) -> Column:
    """TAB-5: ask for a year table with the given columns, optionally for a range of years."""
    asked = F.concat(
        F.lit("Write a markdown table with one line per year and these columns among others: "),
        F.array_join(as_col(variables), ", "),
        F.lit("."),
    )
    if first_year is None or last_year is None:
        years = F.lit("")
    else:
        years = F.concat(
            F.lit(" Cover the years "), as_col(first_year).cast("string"), F.lit(" to "), as_col(last_year).cast("string"), F.lit(".")
        )
    return F.concat(asked, years, F.lit("\nTable:\n"))


def payload_fields(payload: ColumnOrName, schema: str) -> Column:
    """JSN-1: JSON text to a typed struct or map; null for text that is not JSON."""
    return F.from_json(as_col(payload), schema, {"mode": "PERMISSIVE"})


def payload_text(value: ColumnOrName) -> Column:
    """JSN-1, the other way: a struct or map as JSON text."""
    return F.to_json(as_col(value))


def valid_payload(payload: ColumnOrName) -> Column:
    """Whether the text starts with a whole JSON value."""
    return F.try_parse_json(as_col(payload)).isNotNull()
