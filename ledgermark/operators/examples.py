"""Raw report records to one row per question (PRJ-1, PRJ-7, FLT-1, FLT-2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgermark.functions.cleanup import starts_with_temp
from ledgermark.functions.common import bind
from ledgermark.functions.programs import program_to_infix
from ledgermark.functions.tables import gold_text, linearise_table

# Names of the question fields of a record, in output order.
VARIANTS = ("qa", "qa_0", "qa_1")


def _present_variants(raw: DataFrame) -> Column:
    """The question structs a record carries, with their names, in order."""
    fields = ("question", "exe_ans", "program", "gold_inds")
    structs = [
        F.when(
            F.col(name).isNotNull(),
            F.struct(F.lit(name).alias("variant"), *[F.col(name)[f].alias(f) for f in fields]),
        )
        for name in VARIANTS
        if name in raw.columns
    ]
    return F.filter(F.array(*structs), lambda s: s.isNotNull())


def unpivot_qa(raw: DataFrame) -> DataFrame:
    """PRJ-1: one row per question of each record, with its position in the record."""
    return raw.select("id", "table", F.posexplode(_present_variants(raw)).alias("pos", "q")).select(
        "id", "table", "pos", F.col("q.variant"), F.col("q.question"), F.col("q.exe_ans"), F.col("q.program"), F.col("q.gold_inds")
    )


def normalise_examples(raw: DataFrame, strict_compat: bool = False) -> DataFrame:
    """PRJ-7: flatten records; ``reason`` says why a row is unusable, null if it is fine.

    Each question uses its own gold passages. ``strict_compat`` also rejects
    the questions of a record that follow an unusable one.
    """

    def judged(q: Column, infix: Column) -> Column:
        reason = (
            F.when(q["question"].isNull(), F.lit("no question"))
            .when(q["exe_ans"].isNull(), F.lit("no answer"))
            .when(q["gold_inds"].isNull(), F.lit("no gold passages"))
            .when(F.col("table").isNull(), F.lit("no table"))
            .when(q["program"].isNull(), F.lit("no program"))
            .when(infix.isNull(), F.lit("unknown operation"))
        )
        return F.struct(q.alias("q"), infix.alias("infix"), reason.alias("reason"))

    rows = raw.select("id", "table", F.transform(_present_variants(raw), lambda q: bind(program_to_infix(q["program"]), lambda infix: judged(q, infix))).alias("qs"))
    if strict_compat:
        rows = rows.withColumn(
            "qs",
            F.transform(
                "qs",
                lambda s, i: s.withField(
                    "reason",
                    F.when(
                        s["reason"].isNull() & F.exists(F.slice("qs", F.lit(1), i), lambda p: p["reason"].isNotNull()),
                        F.lit("follows an unusable question"),
                    ).otherwise(s["reason"]),
                ),
            ),
        )
    one = rows.select("id", "table", F.posexplode("qs").alias("pos", "s"))
    return one.select(
        F.col("s.q.question").alias("question"),
        gold_text(F.col("s.q.gold_inds")).alias("text"),
        linearise_table("table").alias("table"),
        F.col("s.q.exe_ans").alias("answer"),
        F.col("s.infix").alias("program"),
        "id",
        F.col("s.q.gold_inds").alias("gold"),
        F.col("s.q.variant").alias("variant"),
        "pos",
        F.col("s.reason").alias("reason"),
    )


def split_rejects(judged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """FLT-1: the usable rows, and the rest with their reason."""
    return judged.filter(F.col("reason").isNull()).drop("reason"), judged.filter(F.col("reason").isNotNull())


def drop_leading_temp(df: DataFrame, code: str = "code") -> DataFrame:
    """FLT-2: drop rows whose first code line uses an intermediate result."""
    return df.filter(~F.coalesce(starts_with_temp(code), F.lit(False)))
