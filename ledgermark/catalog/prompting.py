"""Prompt, mixture and fine-tuning target queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgermark.catalog.base import query, table, text_of
from ledgermark.functions import prompts as P
from ledgermark.functions.tables import linearise_table
from ledgermark.functions.targets import mask_labels, teaches_nothing, truncate_append_eos
from ledgermark.operators.conversations import turn_prompts
from ledgermark.plans.annotate import render_prompts
from ledgermark.plans.train import build_mixture, training_set


def _sql(text: str) -> str:
    """A Python string as a SQL expression."""
    return " || chr(10) || ".join("'" + part.replace("'", "''") + "'" for part in text.split("\n"))


_SHOTS = "One worked question.\n#Python\nans = 1"


def _calculation_sql(lead: str) -> str:
    return (
        f"{_sql(lead)} || CASE WHEN txt <> '' THEN txt || chr(10) ELSE '' END || tab || chr(10) || 'Calculation: ' || prog || chr(10)"
        f" || 'Question: ' || q || chr(10) || {_sql(P.NO_COMMENTS + P.CODE_MARK)}"
    )


_EXAMPLE_SQL = """
WITH x AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN '' ELSE 'Order ' || o_orderkey END AS txt,
  'part | status' || chr(10) || 'order | ' || o_orderstatus || chr(10) || 'customer | ' || o_custkey AS tab,
  'ans = ' || o_orderkey || ' / 2' AS prog, 'What is half of ' || o_orderkey || '?' AS q,
  'n = ' || o_orderkey AS defs, o_custkey, o_orderstatus FROM orders)
"""


def _examples(spark, sf_dir):
    cells = F.array(
        F.array(F.lit("part"), F.lit("status")),
        F.array(F.lit("order"), F.col("o_orderstatus")),
        F.array(F.lit("customer"), F.col("o_custkey").cast("string")),
    )
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "F", F.lit("")).otherwise(text_of("Order ", F.col("o_orderkey"))).alias("text"),
        linearise_table(cells).alias("table"),
        text_of("ans = ", F.col("o_orderkey"), " / 2").alias("program"),
        text_of("What is half of ", F.col("o_orderkey"), "?").alias("question"),
        F.array(text_of("n = ", F.col("o_orderkey"))).alias("generated"),
        "o_custkey",
        "o_orderstatus",
    )


_TABLES_SQL = f"CASE WHEN o_orderstatus <> 'F' THEN {_sql(P.TABLES_GIVEN)} || tab || chr(10) || {{join}}tab || chr(10) || chr(10) ELSE '' END || 'Question: ' || q || chr(10) || chr(10)"


@query(
    _EXAMPLE_SQL
    + f"""
SELECT o_orderkey, md5({_calculation_sql(P.ANNOTATE)}) AS annotate, md5({_calculation_sql(P.DEFINE)}) AS define,
  md5({_sql(_SHOTS)} || chr(10) || chr(10) || {_calculation_sql(P.ANNOTATE)} || defs) AS calculate,
  md5({_sql(P.ANSWER_ONE)} || CASE WHEN txt <> '' THEN txt || chr(10) ELSE '' END || tab || chr(10) || {_sql(P.STORE_ANS)} || 'Question: ' || q || chr(10) || {_sql(P.CODE_MARK)}) AS answer,
  md5({_sql(P.POT_SYSTEM)} || {_TABLES_SQL.format(join="")} || {_sql(P.POT_FLAT)}) AS program_flat,
  md5({_sql(P.POT_SYSTEM)} || {_TABLES_SQL.format(join="")} || {_sql(P.POT_FUNCTION)}) AS program_function,
  md5({_sql(P.COT_SYSTEM)} || {_TABLES_SQL.format(join="chr(10) || ")} || {_sql(P.COT_CUE)}) AS thought
FROM x"""
)
def prompt_suite(spark, sf_dir):
    """PRM-1..4, 7, 8, 10, PRJ-3: every prompt style for every order."""
    x = _examples(spark, sf_dir)
    styled = x.withColumns(
        {
            "tables": F.when(F.col("o_orderstatus") != "F", F.array(*[F.regexp_replace("table", r"\n$", "")] * 2)).otherwise(F.array().cast("array<string>")),
            "annotate": P.annotate_prompt(),
            "define": P.definition_prompt(),
            "answer": P.qa_prompt(note_first=False),
        }
    )
    styled = render_prompts(styled, "calculation", _SHOTS).withColumnRenamed("prompt", "calculate")
    flat, function, thought = P.program_of_thought_prompt(), P.program_of_thought_prompt(function_style=True), P.chain_of_thought_prompt()
    return styled.select(
        "o_orderkey",
        *[F.md5(c).alias(c) for c in ("annotate", "define", "calculate", "answer")],
        F.md5(F.concat(flat["system"], flat["user"])).alias("program_flat"),
        F.md5(F.concat(function["system"], function["user"])).alias("program_function"),
        F.md5(F.concat(thought["system"], thought["user"])).alias("thought"),
    )


_HEAD_SQL = _sql(P.ANSWER_LAST + P.STORE_ANS + "Questions: ")


@query(
    f"""
WITH u AS (SELECT DISTINCT conv_id, turn, text FROM conversations WHERE role = 'user'),
e AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY text) AS place, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS r,
      count(*) OVER (PARTITION BY conv_id) AS n FROM u)
SELECT conv_id, turn, place::INTEGER AS place, r = 1 AS is_first, r = n AS is_last, CASE WHEN r = 1 THEN {_HEAD_SQL} ELSE '' END
  || CASE WHEN r = n THEN chr(10) || 'Question: ' || text || chr(10) || {_sql(P.CODE_MARK)} WHEN r = 1 THEN text ELSE ' ' || text END AS prompt FROM e""",
    name="conversation_prompt",
)
def conversation_prompts(spark, sf_dir):
    """PRM-5 over turns: each conversation's user turns as pieces of one prompt, the last question apart."""
    turns = table(spark, sf_dir, "conversations").filter(F.col("role") == "user")
    return turn_prompts(turns.select("conv_id", "turn", "text"))


@query(
    f"""
WITH c AS (SELECT conv_id, turn, text, ['gemma-7b', 'Mixtral-8x7B', 'llama3-8b', 'OLMo-7B', 'gpt'][conv_id % 5 + 1] AS model FROM conversations)
SELECT conv_id, turn, CASE WHEN conv_id % 5 IN (0, 1, 3) THEN 'user' ELSE 'system,user' END AS roles,
  md5({_sql(P.COT_SYSTEM)} || CASE WHEN conv_id % 5 IN (0, 1, 3) THEN chr(10) ELSE '|' END || text) AS contents FROM c"""
)
def chat_messages(spark, sf_dir):
    """PRM-9: message lists, the system text merged for families that take none."""
    models = F.array(*map(F.lit, ("gemma-7b", "Mixtral-8x7B", "llama3-8b", "OLMo-7B", "gpt")))
    model = F.element_at(models, (F.col("conv_id") % 5 + 1).cast("int"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", P.to_messages(F.lit(P.COT_SYSTEM), "text", model).alias("m"))
    return rows.select(
        "conv_id",
        "turn",
        F.array_join(F.transform("m", lambda m: m["role"]), ",").alias("roles"),
        F.md5(F.array_join(F.transform("m", lambda m: m["content"]), "|")).alias("contents"),
    )


def _mixture_rows(spark, sf_dir):
    """Each turn as a training row of one of four data sets."""
    names = F.array(*map(F.lit, ("finqa", "convfinqa", "tatqa", "other")))
    lines = F.split("text", "\n")
    return table(spark, sf_dir, "conversations").select(
        "conv_id",
        "turn",
        F.element_at(names, (F.col("conv_id") % 4 + 1).cast("int")).alias("dataset"),
        F.col("role").alias("text"),
        text_of("turn | ", F.col("turn"), "\n").alias("table"),
        F.col("text").alias("question"),
        lines.alias("questions"),
        F.array(text_of("units = 1\nunits = '", F.col("role"), "'\nans = ", F.col("turn"))).alias("generated"),
    )


@query(
    f"""
WITH c AS (SELECT *, string_split(text, chr(10)) AS qs, 'turn | ' || turn AS tab FROM conversations)
SELECT conv_id, turn, md5(CASE conv_id % 4
  WHEN 1 THEN {_sql(P.ANSWER_LAST + P.STORE_ANS)} || role || chr(10) || tab || chr(10) || 'Questions: ' || array_to_string(qs[1:len(qs) - 1], ' ') || chr(10) || 'Question: ' || qs[len(qs)] || chr(10) || {_sql(P.CODE_MARK)}
  WHEN 2 THEN {_sql(P.ANSWER_ONE + P.STORE_SCALED + P.SCALES)} || role || chr(10) || tab || chr(10) || 'Question: ' || text || chr(10) || {_sql(P.CODE_MARK)}
  ELSE {_sql(P.ANSWER_ONE + P.STORE_ANS)} || role || chr(10) || tab || chr(10) || 'Question: ' || text || chr(10) || {_sql(P.CODE_MARK)} END) AS prompt,
  'units = 1' || chr(10) || 'scale = ''' || role || '''' || chr(10) || 'ans = ' || turn AS target
FROM c"""
)
def mixture(spark, sf_dir):
    """PRM-4, 5, 6, 11, SFT-1: prompt style by data set, units renamed in the target."""
    rows = build_mixture(_mixture_rows(spark, sf_dir))
    return rows.select("conv_id", "turn", F.md5("prompt").alias("prompt"), "target")


def _ids_sql(cutoff: int, eos: int) -> str:
    cut = f"list_transform(string_split(text, ' '), lambda w: length(w)::INTEGER)[1:{cutoff}]"
    return f"CASE WHEN len({cut}) < {cutoff} AND {cut}[-1] <> {eos} THEN list_append({cut}, {eos}) ELSE {cut} END"


@query(
    f"""
WITH c AS (SELECT conv_id, turn, {_ids_sql(64, 2)} AS ids FROM conversations)
SELECT conv_id, turn, array_to_string(ids, ' ') AS ids, len(ids)::BIGINT AS mask_sum,
  array_to_string(list_transform(ids, lambda t, i: CASE WHEN i <= turn * 20 THEN -100 ELSE t END), ' ') AS labels, len(ids) <= turn * 20 AS teaches_nothing
FROM c"""
)
def label_mask(spark, sf_dir):
    """SFT-2, SFT-3: word lengths as ids, cut, ended and masked."""
    ids = F.transform(F.split("text", " "), lambda w: F.length(w))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", truncate_append_eos(ids, eos=2, cutoff=64).alias("t"))
    labelled = rows.withColumn("l", mask_labels("t.input_ids", F.col("turn") * 20))
    return labelled.select(
        "conv_id",
        "turn",
        F.array_join(F.col("t.input_ids").cast("array<string>"), " ").alias("ids"),
        F.aggregate("t.attention_mask", F.lit(0), lambda a, b: a + b).cast("bigint").alias("mask_sum"),
        F.array_join(F.col("l").cast("array<string>"), " ").alias("labels"),
        teaches_nothing("l").alias("teaches_nothing"),
    )


@query(
    f"""
WITH c AS (SELECT *, 'turn | ' || turn AS tab, CASE WHEN role = 'user' THEN 'finqa' ELSE 'other' END AS d FROM conversations),
p AS (SELECT conv_id, turn, {_sql(P.ANSWER_ONE + P.STORE_ANS)} || role || chr(10) || tab || chr(10) || 'Question: ' || text || chr(10) || {_sql(P.CODE_MARK)} AS prompt,
  'units = 1' || chr(10) || 'scale = ''' || role || '''' || chr(10) || 'ans = ' || turn AS target FROM c),
i AS (SELECT *, list_transform(string_split(prompt || target, ' '), lambda w: length(w)::INTEGER)[1:3072] AS f,
  least(len(string_split(prompt, ' ')), 3072) AS n FROM p)
SELECT conv_id || '-' || turn AS row_id, len(f)::BIGINT + CASE WHEN f[-1] <> 7 AND len(f) < 3072 THEN 1 ELSE 0 END AS ids, (len(f) + CASE WHEN f[-1] <> 7 AND len(f) < 3072 THEN 1 ELSE 0 END - n)::BIGINT AS learned
FROM i"""
)
def training_rows(spark, sf_dir):
    """PRM-11, SFT-1..3, SMP-2: the fine-tuning flow in one fixed style, shuffled."""
    rows = _mixture_rows(spark, sf_dir).withColumn("row_id", text_of(F.col("conv_id"), "-", F.col("turn")))

    def to_ids(text):
        return F.transform(F.split(text, " "), lambda w: F.length(w))

    ready = training_set(rows, "row_id", to_ids, eos=7, data_type="finqa")
    return ready.select(
        "row_id",
        F.size("input_ids").cast("bigint").alias("ids"),
        F.size(F.filter("labels", lambda t: t != -100)).cast("bigint").alias("learned"),
    )
