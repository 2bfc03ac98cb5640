"""Numbers hidden in text, number formatting and tolerant equality (NUM-1..13)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgermark.functions.common import BLANK, ColumnOrName, as_col, bind, last_of, once

# Scale words in matching order, with the factor of each.
SCALE_WORDS = (
    ("hundred", 100.0),
    ("thousand", 1000.0),
    ("million", 1000000.0),
    ("billion", 1000000000.0),
    ("percent", 0.01),
)

# Characters ignored when a number is read from text.
IGNORED_IN_NUMBERS = "'\"\\$€£¥%(),[]"

# Precision assumed for a number whose text has no decimal point.
DEFAULT_PRECISION = 5

# possessive, and a second run of digits only after a point: linear on long digit strings
_DIGITS = r"\d++(?:_\d++)*+"
_FLOAT = rf"[+-]?(?:(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(?:e[+-]?{_DIGITS})?|inf(?:inity)?)"
_FLOAT_OR_NAN = rf"(?:{_FLOAT}|[+-]?nan)"
_ANY_SCALE = "(?:" + "|".join(word for word, _ in SCALE_WORDS) + ")"
# a float, alone or followed by a word that names a scale (further words do not matter)
_NUMBER_PHRASE = (
    rf"(?isU)^{BLANK}*{_FLOAT}"
    rf"(?:{BLANK}+[^\s\x1c-\x1f]*?{_ANY_SCALE}.*|{BLANK}*)$"
)
_SIGNED = r"[+-]?\d+(?:\.\d+)?|[+-]?\.\d+"


def scale_factor(word: ColumnOrName) -> Column:
    """NUM-4: factor of the first scale word contained in ``word``, else 1."""
    low = F.lower(as_col(word))
    (first, factor), *rest = SCALE_WORDS
    chain = F.when(low.contains(first), F.lit(factor))
    for name, value in rest:
        chain = chain.when(low.contains(name), F.lit(value))
    return chain.otherwise(F.lit(1.0))


def clean_num(text: ColumnOrName) -> Column:
    """NUM-5: drop quotes, currency and percent signs, brackets and commas."""
    return F.translate(as_col(text), IGNORED_IN_NUMBERS, "")


def number_token(text: ColumnOrName) -> Column:
    """Text of the last signed number; null if there is none or it starts at the point."""
    found = last_of(F.regexp_extract_all(clean_num(text), F.lit(f"({_SIGNED})"), F.lit(0)))
    return F.when(~found.rlike(r"^[+-]?\."), found)


def last_number(text: ColumnOrName) -> Column:
    """NUM-6: the last signed number in the text as a double."""
    return number_token(text).try_cast("double")


def is_number(text: ColumnOrName) -> Column:
    """NUM-7: first word is a float (not NaN) and a second word, if any, names a scale."""
    return F.coalesce(clean_num(text).rlike(_NUMBER_PHRASE), F.lit(False))


def parses_as_float(text: ColumnOrName) -> Column:
    """Whether the general-purpose float syntax accepts the text (``12d`` it does not)."""
    return F.coalesce(as_col(text).rlike(rf"(?isU)^{BLANK}*{_FLOAT_OR_NAN}{BLANK}*$"), F.lit(False))


def parse_float(text: ColumnOrName) -> Column:
    """Float value of the text, null if it is not one."""
    plain = F.translate(F.regexp_replace(as_col(text), rf"(?U){BLANK}", ""), "_", "")
    return F.when(parses_as_float(text), plain.try_cast("double"))


def sign_of(text: ColumnOrName) -> Column:
    """NUM-8: -1 for a number in round brackets, else 1."""
    return F.when(as_col(text).rlike(r"(?U)\([\d.\s\x1c-\x1f]+\)"), F.lit(-1)).otherwise(F.lit(1))


def percent_factor(text: ColumnOrName) -> Column:
    """NUM-9: 0.01 if a number is followed by a percent sign, else 1."""
    return F.when(as_col(text).rlike(r"(?U)[\d.\s\x1c-\x1f]%"), F.lit(0.01)).otherwise(F.lit(1.0))


def word_scale(text: ColumnOrName) -> Column:
    """NUM-10: scale of the first number that is followed by letters, else 1."""
    return scale_factor(F.regexp_extract(as_col(text), rf"(?U)(?<![\d.])[\d.]++{BLANK}?([a-zA-Z]+)", 1))


def format_to(x: Column, digits: Column | int) -> Column:
    """Fixed decimals with digit grouping, rounded ties to even; ``digits`` may be a column."""
    return F.call_function("format_number", x, F.lit(digits) if isinstance(digits, int) else digits)


def round_half_even(x: Column, digits: Column | int) -> Column:
    """Round the exact binary value to ``digits`` decimals, ties to even."""
    return F.translate(format_to(x, digits), ",", "").try_cast("double")


def to_number(text: ColumnOrName) -> Column:
    """NUM-11: last number x word scale x bracket sign x percent, to four decimals."""
    return once(
        as_col(text),
        lambda t: round_half_even(last_number(t) * word_scale(t) * sign_of(t) * percent_factor(t), 4),
    )


def float_text(x: ColumnOrName) -> Column:
    """Shortest text of a double: plain from 1e-4 up to 1e16, exponent form outside."""

    def spell(v: Column) -> Column:
        java = v.cast("string")
        size = F.abs(v)
        # the digits are final; only the exponent has to be written out
        fixed = F.regexp_replace(java.try_cast("decimal(38,21)").cast("string"), "0+$", "")
        power = F.regexp_replace(F.regexp_replace(java, r"(?:\.0)?E(?=\d)", "e+"), r"(?:\.0)?E-", "e-")
        return (
            F.when((size >= 1e-3) & (size < 1e7) | (size == 0), java)
            .when((size >= 1e-4) & (size < 1e16), F.regexp_replace(fixed, r"\.$", ".0"))
            .when(java.endswith("Infinity"), F.replace(java, F.lit("Infinity"), F.lit("inf")))
            .when(F.isnan(v), F.lit("nan"))
            .otherwise(F.regexp_replace(power, r"e([+-])(\d)$", "e$10$2"))
        )

    return once(as_col(x).cast("double") if not isinstance(x, str) else F.col(x), spell)


def canonical_number(text: ColumnOrName) -> Column:
    """Text of ``to_number`` as STR-6 prints it: integers stay integers, of any length.

    Null when the text holds no usable number.
    """

    def spell(t: Column) -> Column:
        return bind(
            F.struct(number_token(t).alias("n"), word_scale(t).alias("s"), sign_of(t).alias("g"), percent_factor(t).alias("p")),
            lambda part: _spell_parts(part["n"], part["s"], part["g"], part["p"]),
        )

    return once(as_col(text), spell)


def _spell_parts(token: Column, scale: Column, sign: Column, percent: Column) -> Column:
    whole = ~token.contains(".") & (scale >= 1) & (percent == 1)
    digits = F.regexp_replace(token, r"^[+-]?0*(?=\d)", "")
    zeros = F.when(scale > 1, F.repeat(F.lit("0"), F.rint(F.log10(scale)).cast("int"))).otherwise(F.lit(""))
    negative = token.startswith("-") != (sign < 0)
    spelled = F.when(digits == "0", F.lit("0")).otherwise(
        F.concat(F.when(negative, F.lit("-")).otherwise(F.lit("")), digits, zeros)
    )
    value = round_half_even(token.try_cast("double") * scale * sign * percent, 4)
    return F.when(whole, spelled).otherwise(float_text(value))


def decimals(x: ColumnOrName, is_int: Column | bool = False) -> Column:
    """NUM-1: digits after the point in the number's shortest text, 5 if it has none."""
    whole = F.lit(is_int) if isinstance(is_int, bool) else is_int
    after = F.regexp_extract(float_text(x), r"\.([^.]*)$", 1)
    places = F.when(after == "", F.lit(DEFAULT_PRECISION)).otherwise(F.length(after))
    return F.when(as_col(x).isNotNull(), F.when(whole, F.lit(DEFAULT_PRECISION)).otherwise(places))


def _agree(pred: Column, ref: Column, places: Column, is_close: bool) -> Column:
    same = bind(places, lambda k: _unsigned_zero(format_to(pred, k)) == _unsigned_zero(format_to(ref, k)))
    if is_close:
        same = same | (F.abs(pred - ref) <= F.lit(0.001) * F.greatest(F.abs(pred), F.abs(ref)))
    return F.coalesce(same & ~F.isnan(pred) & ~F.isnan(ref), F.lit(False))


def _unsigned_zero(text: Column) -> Column:
    return F.regexp_replace(text, r"^-(?=[0.]+$)", "")


def numbers_equal(
    pred: ColumnOrName,
    ref: ColumnOrName,
    include_percentage: bool = False,
    is_close: bool = False,
    pred_is_int: Column | bool = False,
    ref_is_int: Column | bool = False,
) -> Column:
    """NUM-2 on numbers: equal after rounding both to the smaller precision.

    With ``include_percentage`` the reference may also be 100 times off either
    way; ``is_close`` accepts a relative difference of 0.001.
    """
    whole = F.lit(ref_is_int) if isinstance(ref_is_int, bool) else ref_is_int

    def check(p: Column, r: Column) -> Column:
        mine = decimals(p, pred_is_int)
        same = _agree(p, r, F.least(mine, decimals(r, whole)), is_close)
        if include_percentage:
            part, many = r / F.lit(100.0), r * F.lit(100.0)
            same = (
                same
                | bind(part, lambda q: _agree(p, q, F.least(mine, decimals(q)), is_close))
                | bind(many, lambda q: _agree(p, q, F.least(mine, decimals(q, whole)), is_close))
            )
        return same

    return once(as_col(pred), lambda p: once(as_col(ref), lambda r: check(p.cast("double"), r.cast("double"))))


def finqa_equal(pred: ColumnOrName, ref: ColumnOrName, include_percentage: bool = False, is_close: bool = False) -> Column:
    """NUM-2 on tagged answers (see ``answers``): null is wrong, bools meet yes/no, text is exact."""

    def check(p: Column, r: Column) -> Column:
        label = F.when(p["flag"], F.lit("yes")).otherwise(F.lit("no"))
        numbers = numbers_equal(p["num"], r["num"], include_percentage, is_close, p["kind"] == "int", r["kind"] != "float")
        right = (
            F.when(p["kind"] == "bool", (r["kind"] == "text") & (r["text"] == label))
            .when((p["kind"] == "text") | (r["kind"] == "text"), (p["kind"] == r["kind"]) & (p["text"] == r["text"]))
            .when(p["kind"].isin("int", "float") & r["kind"].isin("int", "float", "bool"), numbers)
        )
        return F.coalesce(right, F.lit(False))

    return once(as_col(pred), lambda p: once(as_col(ref), lambda r: check(p, r)))


def round_n(x: ColumnOrName, n: ColumnOrName | int) -> Column:
    """NUM-3: scale, round ties to even, unscale; a negative ``n`` rounds to tens."""
    value = as_col(x).cast("double")
    places = F.lit(n) if isinstance(n, int) else as_col(n)
    up = F.pow(F.lit(10.0), F.abs(places).cast("double"))
    return F.when(places >= 0, F.rint(value * up) / up).otherwise(F.rint(value / up) * up)


def strip_digit_commas(text: ColumnOrName) -> Column:
    """NUM-12: remove every comma that stands between two digits."""
    return F.regexp_replace(as_col(text), r"(?<=\d),(?=\d)", "")


_SCALED = r"(?<![\d.])\d+(?:\.\d+)? (?:million|billion)"


def expand_scaled_words(text: ColumnOrName) -> Column:
    """NUM-13: write ``2.5 million`` as ``2500000``, digit commas removed first.

    The text is cut at the matches, so its cost grows with its length plus the
    number of matches.
    """

    def digits(match: Column) -> Column:
        number = F.substring_index(match, " ", 1)
        width = F.when(match.endswith("million"), F.lit(6)).otherwise(F.lit(9))
        part = F.when(number.contains("."), F.substring_index(number, ".", -1)).otherwise(F.lit(""))
        moved = F.concat(F.substring_index(number, ".", 1), F.rpad(part, width, F.lit("0")))
        rest = F.regexp_replace(F.substr(part, width + 1), "0+$", "")
        return F.concat(
            F.regexp_replace(moved, r"^0+(?=\d)", ""),
            F.when(rest != "", F.concat(F.lit("."), rest)).otherwise(F.lit("")),
        )

    def rewrite(plain: Column) -> Column:
        pieces = F.split(plain, _SCALED)
        matches = F.regexp_extract_all(plain, F.lit(f"({_SCALED})"), F.lit(0))
        return F.array_join(F.zip_with(pieces, matches, lambda p, m: F.concat(p, F.coalesce(digits(m), F.lit("")))), "")

    return bind(strip_digit_commas(text), rewrite)
