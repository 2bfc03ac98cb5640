"""Text normalisation and display strings (STR-1..10)."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgermark.functions.common import ColumnOrName, as_col, bind, once, squeeze
from ledgermark.functions.numbers import canonical_number, is_number, scale_factor, to_number

PUNCTUATION = string.punctuation

# a word character as the article rule sees it: letters, digits, underscore
_WORD = r"[\p{L}\p{N}_]"
# the letter is tried before the look-behind, so most positions fail at once
_ARTICLES = rf"a(?<!{_WORD}a)n?(?!{_WORD})|t(?<!{_WORD}t)he(?!{_WORD})"
# a blank-delimited token that holds a digit, or may begin with inf, marks left aside; possessive, so linear in the text
_INF = r"i[^ a-z]*+n[^ a-z]*+f"
_NUMBER_WORD = rf"(?<![^ ])[^ a-z]*+{_INF}[^ ]*+"
_DIGIT_TOKEN = rf"(?<![^ ])[^ \d]*+\d[^ ]*+|{_NUMBER_WORD}"
_TRIMMED = "[" + "".join("\\" + ch for ch in PUNCTUATION) + "‘’´" + "]"


def remove_articles(text: ColumnOrName) -> Column:
    """STR-1: the whole words a, an, the become a blank."""
    return F.regexp_replace(as_col(text), _ARTICLES, " ")


def fix_spaces(text: ColumnOrName) -> Column:
    """STR-2: collapse whitespace and trim."""
    return squeeze(as_col(text))


def remove_punctuation(text: ColumnOrName) -> Column:
    """STR-3: delete ASCII punctuation unless the text is a number."""
    t = as_col(text)
    return F.when(is_number(t), t).otherwise(F.translate(t, PUNCTUATION, ""))


def lowercase(text: ColumnOrName) -> Column:
    """STR-4."""
    return F.lower(as_col(text))


def split_blank(text: ColumnOrName) -> Column:
    """STR-5: split at every single blank, empty pieces kept."""
    return F.split(as_col(text), " ")


def normalise_number(text: ColumnOrName) -> Column:
    """STR-6: canonical text of a numeric token; a token without a usable number stays."""
    return once(as_col(text), lambda t: F.when(is_number(t), F.coalesce(canonical_number(t), t)).otherwise(t))


def normalise_answer(text: ColumnOrName) -> Column:
    """STR-7: lower case, no punctuation, canonical numbers, no articles, single blanks.

    Only a token with a digit, or ``inf``, can be a number, so the text is cut at those
    tokens and the stretches between them are cleaned whole; text without a
    digit is one stretch. The articles and blanks are then handled in one pass
    over the rejoined text. Equal to working token by token, at a cost that
    follows the text length.
    """

    def number_or_text(token: Column) -> Column:
        return F.when(is_number(token), F.coalesce(canonical_number(token), token)).otherwise(bare(token))

    def bare(text: Column) -> Column:
        return F.translate(text, PUNCTUATION, "")

    def cut(low: Column) -> Column:
        pieces = F.split(low, _DIGIT_TOKEN)
        tokens = F.regexp_extract_all(low, F.lit(f"({_DIGIT_TOKEN})"), F.lit(0))
        joined = F.zip_with(pieces, tokens, lambda piece, token: F.concat_ws(" ", bare(piece), number_or_text(token)))
        return F.when(low.rlike(rf"\d|{_INF}"), F.array_join(joined, " ")).otherwise(bare(low))

    return squeeze(remove_articles(bind(F.lower(as_col(text)), cut)))


def ws_tokens(text: ColumnOrName) -> Column:
    """STR-8: lower-cased words with punctuation trimmed from both ends; no words -> []."""
    t = as_col(text)
    trimmed = F.regexp_replace(
        squeeze(F.lower(t)), rf"(?<![^ ]){_TRIMMED}++|(?<!{_TRIMMED}){_TRIMMED}++(?![^ ])", ""
    )
    some = t.rlike(r"(?U)[^\s\x1c-\x1f]")
    return F.when(some, F.split(trimmed, " ")).when(~some, F.array().cast("array<string>"))


def fixed4(x: Column) -> Column:
    """Four decimals, no digit grouping."""
    return F.translate(F.format_number(x, 4), ",", "")


def _shown(item: Column, scale: Column) -> Column:
    """One answer string as it is compared: numbers scaled, other text followed by the scale word."""
    worded = F.when(scale != "", F.concat(item, F.lit(" "), scale)).otherwise(item)
    value = to_number(item)

    def number(v: Column) -> Column:
        return (
            F.when(v.isNull(), worded)
            .when(item.contains("%"), fixed4(v))
            .otherwise(fixed4(_round2(v) * scale_factor(scale)))
        )

    return F.when(is_number(item), F.get(F.transform(F.array(value), number), F.lit(0))).otherwise(worded)


def _round2(v: Column) -> Column:
    return F.translate(F.format_number(v, 2), ",", "").try_cast("double")


def sort_answers(items: ColumnOrName) -> Column:
    """SRT-2: ascending order of the answer strings."""
    return F.array_sort(as_col(items))


def display_answer(items: ColumnOrName, scale: ColumnOrName) -> Column:
    """STR-9: the sorted answers, each scaled or labelled, joined into one string."""
    word = F.coalesce(as_col(scale), F.lit(""))
    return F.array_join(F.transform(sort_answers(items), lambda item: _shown(item, word)), " ")


def percent_variants(items: ColumnOrName, scale: ColumnOrName) -> Column:
    """STR-10: the display string, plus the unrounded value of a single plain number."""
    answers = as_col(items)
    first = F.get(answers, F.lit(0))
    plain = (
        (F.size(answers) == 1)
        & (F.coalesce(as_col(scale), F.lit("")) == "")
        & ~first.contains("%")
        & is_number(first)
    )
    extra = F.when(plain, fixed4(to_number(first)))
    return F.filter(F.array(display_answer(answers, scale), extra), lambda s: s.isNotNull())
