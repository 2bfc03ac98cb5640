"""The tagged answer value and its conversions (EXE-3..7, FLT-5).

An answer can be a number, a yes/no flag, text or a list. It is held as
``struct<kind, num, text, flag, items>`` where kind is int, float, bool, text
or list; a null kind (or a null struct) is no answer. ``text`` is the value as
printed, whatever its kind.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgermark.functions.common import ColumnOrName, as_col, once
from ledgermark.functions.numbers import float_text, parse_float, parses_as_float, round_half_even, round_n

ANSWER = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("num", T.DoubleType()),
        T.StructField("text", T.StringType()),
        T.StructField("flag", T.BooleanType()),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)


def answer(kind, num=None, text=None, flag=None, items=None) -> Column:
    """Build a tagged answer from columns or literals."""

    def field(value, type_: str) -> Column:
        return (value if isinstance(value, Column) else F.lit(value)).cast(type_)

    return F.struct(
        field(kind, "string").alias("kind"),
        field(num, "double").alias("num"),
        field(text, "string").alias("text"),
        field(flag, "boolean").alias("flag"),
        field(items, "array<string>").alias("items"),
    )


def number_answer(x: ColumnOrName) -> Column:
    return once(as_col(x), lambda v: F.when(v.isNotNull(), answer("float", num=v, text=float_text(v))))


def flag_answer(x: ColumnOrName) -> Column:

    def build(v: Column) -> Column:
        text = F.when(v, F.lit("True")).otherwise(F.lit("False"))
        return F.when(v.isNotNull(), answer("bool", num=v.cast("int").cast("double"), text=text, flag=v))

    return once(as_col(x), build)


def text_answer(x: ColumnOrName) -> Column:
    x = as_col(x)
    return F.when(x.isNotNull(), answer("text", text=x))


def answer_from_variant(value: ColumnOrName) -> Column:
    """Tagged answer from a VARIANT, keeping 14, 14.0 and '14' apart."""
    v = as_col(value)
    shape = F.schema_of_variant(v)
    number = F.try_variant_get(v, "$", "double")
    flag = F.try_variant_get(v, "$", "boolean")
    items = F.try_variant_get(v, "$", "array<string>")
    return (
        F.when(shape == "BIGINT", answer("int", num=number, text=F.try_variant_get(v, "$", "string")))
        .when(shape.startswith("DECIMAL") | (shape == "DOUBLE"), number_answer(number))
        .when(shape == "BOOLEAN", flag_answer(flag))
        .when(shape == "STRING", text_answer(F.try_variant_get(v, "$", "string")))
        .when(shape.startswith("ARRAY"), answer("list", num=parse_float(F.get(items, F.lit(0))), text=F.to_json(v), items=items))
    )


def coerce_answer(value: ColumnOrName) -> Column:
    """EXE-3: flags stay, a list gives its first item, whatever reads as a number is one."""

    def convert(v: Column) -> Column:
        head = F.get(v["items"], F.lit(0))
        plain = F.when(v["kind"] == "list", head).otherwise(v["text"])
        number = F.when(v["kind"].isin("int", "float", "list"), v["num"]).otherwise(parse_float(v["text"]))
        return (
            F.when(v["kind"] == "bool", v)
            .when((v["kind"] == "list") & (F.size(v["items"]) == 0), F.lit(None).cast(ANSWER))
            .otherwise(F.coalesce(number_answer(number), text_answer(plain)))
        )

    return once(as_col(value), convert)


def simplify_answer(value: ColumnOrName, as_text: bool = True) -> Column:
    """EXE-4: single-item lists unwrapped, falsy values (zero too) dropped, optional text form."""
    v = as_col(value)
    falsy = (
        v["kind"].isNull()
        | F.when(v["kind"].isin("int", "float"), v["num"] == 0)
        .when(v["kind"] == "bool", ~v["flag"])
        .when(v["kind"] == "list", F.size(v["items"]) == 0)
        .otherwise(F.coalesce(v["text"], F.lit("")) == "")
    )
    single = (v["kind"] == "list") & (F.size(v["items"]) == 1)
    text = F.when(single, F.get(v["items"], F.lit(0))).otherwise(v["text"])
    if as_text:
        return F.when(~falsy, text)
    head = F.get(v["items"], F.lit(0))
    unwrapped = F.when(parses_as_float(head), number_answer(parse_float(head))).otherwise(text_answer(head))
    return F.when(falsy, F.lit(None).cast(ANSWER)).when(single, unwrapped).otherwise(v)


def simplify_number(x: ColumnOrName, as_text: bool = True) -> Column:
    """EXE-4 for array-library scalars: two decimals, optionally as text."""
    value = round_half_even(as_col(x).cast("double"), 2)
    return float_text(value) if as_text else value


def answer_to_label(value: ColumnOrName) -> Column:
    """EXE-5: flags become yes/no, numbers stay, anything else is no prediction."""
    return once(
        as_col(value),
        lambda v: F.when(v["kind"] == "bool", text_answer(F.when(v["flag"], F.lit("yes")).otherwise(F.lit("no"))))
        .when(v["kind"].isin("int", "float"), v)
        .otherwise(F.lit(None).cast(ANSWER)),
    )


def label_reject_reason(value: ColumnOrName) -> Column:
    """Why ``answer_to_label`` gave no prediction; null if it gave one."""
    kind = as_col(value)["kind"]
    return F.when(kind.isNull(), F.lit("no answer")).when(
        ~kind.isin("bool", "int", "float"), F.concat(F.lit("answer is "), kind)
    )


def prediction_to_program(label: ColumnOrName) -> Column:
    """EXE-6: a prediction as a one-step program in token form."""
    v = as_col(label)
    text = F.when(v["kind"] == "text", v["text"])
    shown = F.when(v["kind"].isin("int", "float"), v["text"]).otherwise(F.lit("None"))
    return (
        F.when(text == "yes", F.array(*map(F.lit, ("greater(", "1", "0", ")", "EOF"))))
        .when(text.isNotNull(), F.array(*map(F.lit, ("greater(", "0", "1", ")", "EOF"))))
        .otherwise(F.array(F.lit("add("), shown, F.lit("0"), F.lit(")"), F.lit("EOF")))
    )


def finalise_scaled(text: ColumnOrName, items: ColumnOrName, scale: ColumnOrName) -> Column:
    """EXE-7: struct of the answer list and its scale.

    ``items`` is the answer when it is a list, null when it is plain text. The
    scale is blanked when the first item already names it; ``none`` means blank.
    """
    found = F.coalesce(as_col(items), F.array(F.coalesce(as_col(text), F.lit(""))))
    answers = F.when(F.size(found) == 0, F.array(F.lit(""))).otherwise(found)
    unit = F.when(F.coalesce(as_col(scale), F.lit("none")) == "none", F.lit("")).otherwise(as_col(scale))
    named = F.get(answers, F.lit(0)).contains(unit) & (F.size(found) > 0)
    return F.struct(answers.alias("pred"), F.when(named, F.lit("")).otherwise(unit).alias("pred_scale"))


def answer_matches_display(shown: ColumnOrName, computed: ColumnOrName) -> Column:
    """FLT-5: the printed answer equals the computed one at the printed precision."""
    v = as_col(computed)
    text = F.replace(F.replace(as_col(shown), F.lit("$ "), F.lit("")), F.lit("\n"), F.lit(""))
    percent = text.contains("%")
    body = F.when(percent, F.substr(text, F.lit(1), F.length(text) - 1)).otherwise(text)
    places = F.when(body.contains("."), F.length(F.substring_index(body, ".", -1))).otherwise(F.lit(0))
    value = round_n(v["num"] * F.when(percent, F.lit(100.0)).otherwise(F.lit(1.0)), places)
    spelled = F.when(places == 0, value.cast("decimal(38,0)").cast("string")).otherwise(float_text(value))
    return F.coalesce(F.when(v["kind"] == "text", text == v["text"]).otherwise(body == spelled), F.lit(False))
