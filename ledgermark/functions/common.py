"""Small helpers shared by the column builders."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str

# Python's idea of whitespace: the Unicode property plus the four separators.
BLANK = r"[\s\x1c-\x1f]"


def as_col(value: ColumnOrName) -> Column:
    return F.col(value) if isinstance(value, str) else value


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and refer to it any number of times in ``body``.

    Plain Column reuse copies the whole expression tree at each mention;
    a lambda variable does not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``bind``, unless ``value`` is a bare column, which costs nothing to repeat.

    A bound value is evaluated outside generated code, so it is worth it only
    for an expression.
    """
    if re.fullmatch(r"Column<'[\w.]+'>", repr(value)):
        return body(value)
    return bind(value, body)


def last_of(items: Column) -> Column:
    """Last element, null when there is none."""
    return F.get(items, F.size(items) - 1)


def quoted(literal: str) -> str:
    """A regular expression that matches ``literal`` and nothing else."""
    return r"\Q" + literal.replace(r"\E", r"\E\\E\Q") + r"\E"


def split_literal(text: Column, mark: str) -> Column:
    return F.split(text, quoted(mark))


def squeeze(text: Column) -> Column:
    """Collapse every run of whitespace to one blank and trim."""
    return F.trim(F.regexp_replace(text, r"(?U)" + BLANK + "+", " "))
