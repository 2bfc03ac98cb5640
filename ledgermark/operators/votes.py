"""Settling many samples per example (AGG-1, AGG-2, SRT-1)."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgermark.functions.answers import ANSWER, answer, flag_answer, number_answer, text_answer


def _parts(df: DataFrame, name: str) -> tuple[Column, Column, Column]:
    """Kind, number and text of the answers, whether they are tagged or plain."""
    type_, value = df.schema[name].dataType, F.col(name)
    if isinstance(type_, T.StructType):
        return value["kind"], value["num"], value["text"]
    if isinstance(type_, T.StringType):
        return F.when(value.isNotNull(), F.lit("text")), F.lit(None).cast("double"), value
    kind = "bool" if isinstance(type_, T.BooleanType) else "float"
    number = value.cast("int") if kind == "bool" else value
    return F.when(value.isNotNull(), F.lit(kind)), number.cast("double"), F.lit(None).cast("string")


#: Places and ranks in a vote: up to 27 digits of place, four for its form, ten of votes beside them.
PLACE = "decimal(27,0)"
_RANK = "decimal(38,0)"
_FIRSTS = Decimal(10**28)


def majority_vote(
    samples: DataFrame,
    id_col: str = "id",
    order_col: str = "sample_idx",
    answer_col: str = "answer",
    code_col: str | None = "code",
) -> DataFrame:
    """AGG-1: ``id, prediction, votes, code`` with one row per example.

    ``order_col`` is a whole number from 0, below 10**27 and different for each
    sample of an example; a larger one is an error. Null answers do not vote;
    the most frequent answer wins and a tie goes to the one seen first; the
    code is the last sample's that gave the winner. A flag and the equal number
    are one answer, shown as the first seen; every NaN stands alone. An example
    without a usable answer gets a null prediction and empty code.

    Two hash aggregations, both combined before their shuffle: (example,
    answer), then example. An example with very many samples is spread by the
    first and arrives at the second as one row per map task. Votes and first
    place are one decimal rank, so the buffers are fixed-length. The winner's
    text, which such a buffer cannot hold, is looked up by example and rank
    where answers may be text. ``code`` is the exception: it is carried as the
    tally's last, which sorts a task's samples; looking it up by place would
    shuffle all samples with their code a second time.
    """
    kind, number, text = _parts(samples, answer_col)
    type_ = samples.schema[answer_col].dataType
    may_be_text = isinstance(type_, (T.StructType, T.StringType))
    numeric = kind.isin("int", "float", "bool")
    place = F.col(order_col).cast(PLACE)
    in_range = (place >= 0) & (F.col(order_col).isNull() == place.isNull())
    place = F.when(in_range, place).otherwise(F.raise_error(F.lit("sample place out of range")).cast(PLACE))
    # how the sample wrote its number: 1 flag, 2 integer, 0 float
    form = F.when(kind == "bool", F.lit(1)).when(kind == "int", F.lit(2)).otherwise(F.lit(0))
    keyed = samples.select(
        id_col,
        place.alias("_at"),
        F.when(numeric, number).alias("_num"),
        *([F.when(~numeric, text).alias("_text")] if may_be_text else []),
        F.when(numeric & F.isnan(number), place).alias("_nan"),
        kind.isNotNull().alias("_valid"),
        form.alias("_form"),
        *([F.col(code_col).alias("_code")] if code_col else []),
    )
    first = F.min((F.col("_at") * 4 + F.col("_form")).cast("decimal(28,0)"))
    tallies = keyed.groupBy(id_col, "_valid", "_num", *(["_text"] if may_be_text else []), "_nan").agg(
        F.count(F.lit(1)).alias("_n"), first.alias("_first"), *([F.max_by("_code", "_at").alias("_code")] if code_col else [])
    )
    votes = F.when(F.col("_valid"), F.col("_n")).otherwise(0).cast("decimal(10,0)")
    rank = (votes * F.lit(_FIRSTS) + (F.lit(_FIRSTS - 1) - F.col("_first"))).cast(_RANK)
    tallies = tallies.withColumn("_rank", rank)
    if code_col:
        fields = ["_rank", "_valid", "_num", *(["_text"] if may_be_text else []), "_code"]
        best = tallies.groupBy(id_col).agg(F.max(F.struct(*fields)).alias("_w")).select(id_col, "_w.*")
    elif may_be_text:
        top = tallies.groupBy(F.col(id_col).alias("_top_id")).agg(F.max("_rank").alias("_top"))
        best = tallies.join(top, F.col(id_col).eqNullSafe(F.col("_top_id")) & (F.col("_rank") == F.col("_top")))
    else:
        best = tallies.groupBy(id_col).agg(F.max("_rank").alias("_rank"), F.max_by("_num", "_rank").alias("_num"), F.max_by("_valid", "_rank").alias("_valid"))
    votes = F.call_function("div", F.col("_rank"), F.lit(_FIRSTS))
    packed = F.lit(_FIRSTS - 1) - F.pmod(F.col("_rank"), F.lit(_FIRSTS))
    num, form = F.col("_num"), F.pmod(packed, F.lit(Decimal(4))).cast("int")
    prediction = F.when(~F.col("_valid"), F.lit(None).cast(ANSWER))
    if may_be_text:
        prediction = prediction.when(F.col("_text").isNotNull(), text_answer(F.col("_text")))
    prediction = (
        prediction.when(form == 1, flag_answer(num == 1))
        .when(form == 2, answer("int", num=num, text=num.cast("decimal(38,0)").cast("string")))
        .otherwise(number_answer(num))
    )
    return best.select(
        id_col,
        prediction.alias("prediction"),
        F.when(F.col("_valid"), votes).otherwise(F.lit(0)).cast("bigint").alias("votes"),
        *([F.when(F.col("_valid"), F.col("_code")).otherwise(F.lit("")).alias("code")] if code_col else []),
    )


def vote_pair(
    samples: DataFrame,
    id_col: str = "id",
    order_col: str = "sample_idx",
    ok: str = "ok",
    answer_text: str = "answer_text",
    unit: str = "unit",
) -> DataFrame:
    """AGG-2: ``id, answer_text, unit`` voted apart, as text; ties go to the first seen.

    A run that failed votes for neither; one that set no unit votes for ''.
    Both votes share one pass: a sample becomes two ballots, so nothing is
    joined back.
    """
    ballots = samples.select(
        id_col,
        F.col(order_col).cast(PLACE).alias("_at"),
        F.explode(
            F.array(
                F.struct(F.lit(True).alias("is_answer"), F.when(F.col(ok), F.col(answer_text)).alias("value")),
                F.struct(
                    F.lit(False).alias("is_answer"), F.when(F.col(ok), F.coalesce(F.col(unit), F.lit(""))).alias("value")
                ),
            )
        ).alias("b"),
    ).select(id_col, "_at", "b.is_answer", "b.value")
    tallies = ballots.groupBy(id_col, "is_answer", "value").agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("first"))
    rank = F.struct(F.col("n"), (-F.col("first")).alias("first"), F.col("value"))
    best = tallies.groupBy(id_col).agg(
        F.max(F.when(F.col("is_answer") & F.col("value").isNotNull(), rank)).alias("a"),
        F.max(F.when(~F.col("is_answer") & F.col("value").isNotNull(), rank)).alias("u"),
    )
    return best.select(
        id_col,
        F.coalesce("a.value", F.lit("")).alias("answer_text"),
        F.coalesce("u.value", F.lit("")).alias("unit"),
    )


def score_logprobs(token_logprobs: str | Column) -> Column:
    """Sum of a sample's token log-probabilities."""
    return F.aggregate(
        F.col(token_logprobs) if isinstance(token_logprobs, str) else token_logprobs,
        F.lit(0.0),
        lambda total, x: total + x,
    )


def sort_by_logprob(
    completions: DataFrame, id_col: str = "id", order_col: str = "sample_idx", logprobs: str = "token_logprobs"
) -> DataFrame:
    """SRT-1: all samples with their ``score``, best first within each example, ties in sample order.

    A range sort on example, score and sample, so one example may span tasks.
    """
    scored = completions.withColumn("score", score_logprobs(logprobs)).drop(logprobs)
    return scored.orderBy(id_col, F.desc("score"), order_col)


def rank_by_logprob(
    completions: DataFrame, top: int, id_col: str = "id", order_col: str = "sample_idx", logprobs: str = "token_logprobs"
) -> DataFrame:
    """SRT-1: the ``top`` samples of each example with ``score`` and ``rank``.

    The limit is applied before the shuffle as well as after it.
    """
    scored = completions.withColumn("score", score_logprobs(logprobs)).drop(logprobs)
    order = Window.partitionBy(id_col).orderBy(F.desc("score"), F.asc(order_col))
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
