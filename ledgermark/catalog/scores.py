"""Prediction scoring over gold made from the part table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgermark.catalog.base import ppm, query, scaled, table, text_of
from ledgermark.operators.joins import join_predictions
from ledgermark.operators.metrics import (
    ANSWER_SOURCES,
    OPERATORS,
    SCALES,
    count_pivot,
    metric_pivot,
    op_breakdown,
    overall_metrics,
    scale_breakdown,
)
from ledgermark.operators.scoring import score_predictions


def _pick(values: tuple[str, ...], index):
    return F.element_at(F.array(*map(F.lit, values)), (index % len(values) + 1).cast("int"))


_TYPES = ("span", "multi-span", "arithmetic", "count")


def _answers():
    kind = F.col("p_partkey") % 4
    return (
        F.when(kind == 0, F.array("p_name"))
        .when(kind == 1, F.array("p_type", "p_brand"))
        .when(kind == 2, F.array(text_of(F.col("p_size"), ".5")))
        .otherwise(F.array(F.col("p_size").cast("string")))
    )


def gold(spark, sf_dir) -> DataFrame:
    """One question per part, of every answer type, scale and source."""
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        key.alias("uid"),
        _pick(_TYPES, key).alias("answer_type"),
        _pick(ANSWER_SOURCES, F.col("p_size")).alias("answer_from"),
        _pick(SCALES, key).alias("scale"),
        _answers().alias("answer"),
        _pick(OPERATORS, key).alias("gold_op"),
        "p_brand",
    )


def predictions(spark, sf_dir) -> DataFrame:
    """Predictions right, off by scale, folded into the value, reordered, wrong or empty; promotional parts have none."""
    key = F.col("p_partkey")
    form = F.floor(key / 20) % 6
    kind, same = key % 4, _pick(SCALES, key)
    factor = F.element_at(F.array(*[F.lit(v) for v in (1.0, 1000.0, 1000000.0, 1000000000.0, 0.01)]), (key % 5 + 1).cast("int"))
    number = F.when(kind == 2, F.col("p_size") + 0.5).otherwise(F.col("p_size").cast("double"))
    folded = F.when(kind >= 2, F.array(F.translate(F.format_number(number * factor, 4), ",", ""))).otherwise(_answers())
    pred = (
        F.when(form == 2, folded)
        .when(form == 3, F.reverse(_answers()))
        .when(form == 4, F.array(F.lit("zzz")))
        .when(form == 5, F.array(F.lit("")))
        .otherwise(_answers())
    )
    scale = F.when(form == 1, _pick(SCALES, key + 1)).when(form == 2, F.lit("")).otherwise(same)
    return table(spark, sf_dir, "part").filter(F.col("p_type") != "PROMO").select(
        key.alias("uid"), pred.alias("pred"), scale.alias("pred_scale"), F.when(key % 11 != 0, _pick(OPERATORS, F.floor(key / 3))).alias("pred_op")
    )


def scored(spark, sf_dir) -> DataFrame:
    return score_predictions(join_predictions(gold(spark, sf_dir), predictions(spark, sf_dir)))


def _sql_list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


# Outcomes follow from how each prediction was made, with token overlap for the text types.
_SCORED_SQL = f"""
WITH g AS (SELECT p_partkey AS uid, {_sql_list(_TYPES)}[p_partkey % 4 + 1] AS answer_type,
    {_sql_list(ANSWER_SOURCES)}[p_size % 3 + 1] AS answer_from, p_brand,
    {_sql_list(SCALES)}[p_partkey % 5 + 1] AS scale, {_sql_list(SCALES)}[(p_partkey + 1) % 5 + 1] AS next_scale,
    {_sql_list(OPERATORS)}[p_partkey % 10 + 1] AS gold_op,
    CASE WHEN p_type <> 'PROMO' AND p_partkey % 11 <> 0 THEN {_sql_list(OPERATORS)}[(p_partkey // 3) % 10 + 1] END AS pred_op,
    CASE WHEN p_type = 'PROMO' THEN 5 ELSE (p_partkey // 20) % 6 END AS form,
    p_type = 'PROMO' AS absent, p_partkey % 4 >= 2 AS is_number,
    CASE p_partkey % 4 WHEN 0 THEN string_split(lower(p_name), ' ')
                       ELSE [lower(p_type), lower(replace(p_brand, '#', ''))] END AS words FROM part),
b AS (SELECT *, CASE WHEN absent THEN NULL WHEN form = 1 THEN next_scale WHEN form = 2 THEN '' ELSE scale END AS pred_scale FROM g),
w AS (SELECT *, list_distinct(list_filter(list_append(words, scale), lambda x: x <> '')) AS gold_bag,
    list_distinct(list_filter(list_append(CASE WHEN form = 4 THEN ['zzz'] ELSE words END, pred_scale), lambda x: x <> '')) AS pred_bag FROM b),
n AS (SELECT *, len(list_intersect(gold_bag, pred_bag))::DOUBLE AS k, len(gold_bag)::DOUBLE AS gn, len(pred_bag)::DOUBLE AS pn FROM w),
e AS (SELECT *, CASE WHEN form IN (0, 3) OR form = 2 AND (is_number OR scale = '') THEN 1 ELSE 0 END::BIGINT AS em,
    form < 5 AND pred_scale = scale AS scale_em FROM n),
s AS (SELECT *, CASE WHEN form = 5 THEN 0 WHEN is_number THEN em * 100 WHEN k = 0 THEN 0
    ELSE round_even(2.0::DOUBLE * (k / pn) * (k / gn) / (k / pn + k / gn) * 100, 0) END::BIGINT AS f1_pct FROM e)
"""


@query(_SCORED_SQL + "SELECT uid, em, f1_pct, coalesce(scale_em, false) AS scale_em FROM s")
def tatqa_score(spark, sf_dir):
    """JON-1, STR-9, STR-10, SCO-6, SCO-7, AGG-10, SRT-2: every question scored."""
    return scored(spark, sf_dir).select(
        "uid", F.col("em").cast("bigint").alias("em"), scaled(F.col("f1"), 100).alias("f1_pct"), "scale_em"
    )


@query(
    _SCORED_SQL
    + """SELECT sum(em)::BIGINT * 1000000 // count(*) AS em_ppm, sum(f1_pct)::BIGINT AS f1_sum_pct,
    sum(scale_em::INT)::BIGINT * 1000000 // count(*) AS scale_ppm, sum((pred_op = gold_op)::INT)::BIGINT * 1000000 // count(*) AS op_ppm, count(*) AS total FROM s"""
)
def tatqa_overall(spark, sf_dir):
    """AGG-4: the overall figures, unanswered questions counted."""
    overall = overall_metrics(scored(spark, sf_dir))
    # a mean times its count is a whole number again

    def whole(name, factor=1):
        return F.round(F.col(name) * F.col("total") * factor).cast("bigint")

    return overall.select(
        ppm(whole("em"), F.col("total")).alias("em_ppm"),
        whole("f1", 100).alias("f1_sum_pct"),
        ppm(whole("scale_em"), F.col("total")).alias("scale_ppm"),
        ppm(whole("op_em"), F.col("total")).alias("op_ppm"),
        "total",
    )


_COLUMNS = [(v, v.replace("-", "_")) for v in ANSWER_SOURCES]


@query(
    _SCORED_SQL
    + "SELECT answer_type, "
    + ", ".join(f"coalesce(round(avg(em) FILTER (answer_from = '{v}') * 1000000), 0)::BIGINT AS em_{c}" for v, c in _COLUMNS)
    + " FROM s GROUP BY answer_type",
    name="metric_pivot",
)
def metric_pivot_by_source(spark, sf_dir):
    """AGG-5: mean EM by answer type and source."""
    pivot = metric_pivot(scored(spark, sf_dir), "em")
    return pivot.select("answer_type", *[F.round(F.col(f"`{v}`") * 1000000).cast("bigint").alias(f"em_{c}") for v, c in _COLUMNS])


@query(
    _SCORED_SQL
    + "SELECT answer_type, "
    + ", ".join(f"count(em) FILTER (answer_from = '{v}') AS n_{c}" for v, c in _COLUMNS)
    + " FROM s GROUP BY answer_type",
    name="count_pivot",
)
def count_pivot_by_source(spark, sf_dir):
    """AGG-6: scored questions by answer type and source."""
    pivot = count_pivot(scored(spark, sf_dir))
    return pivot.select("answer_type", *[F.col(f"`{v}`").alias(f"n_{c}") for v, c in _COLUMNS])


@query(
    _SCORED_SQL
    + f""", c AS (SELECT scale, sum(CASE WHEN pred_scale = scale THEN 1 ELSE 0 END)::BIGINT AS correct, count(*) AS total FROM s GROUP BY scale)
SELECT d.scale, coalesce(correct, 0) AS correct, coalesce(total, 0) AS total, coalesce(correct * 1000000 // total, 0) AS accuracy_ppm
FROM (SELECT unnest({_sql_list(SCALES)}) AS scale) d LEFT JOIN c ON c.scale = d.scale""",
    name="scale_breakdown",
)
def scale_breakdown_report(spark, sf_dir):
    """AGG-7: scale hits over the fixed scales."""
    rows = scale_breakdown(scored(spark, sf_dir))
    return rows.select("scale", "correct", "total", F.coalesce(ppm(F.col("correct"), F.nullif("total", F.lit(0))), F.lit(0)).alias("accuracy_ppm"))


@query(
    _SCORED_SQL
    + f""", c AS (SELECT gold_op, sum(CASE WHEN pred_op = gold_op THEN 1 ELSE 0 END)::BIGINT AS correct, count(*) AS total
    FROM s WHERE pred_op IS NOT NULL GROUP BY gold_op)
SELECT d.gold_op, coalesce(correct, 0) AS correct, coalesce(total, 0) AS total, coalesce(correct * 1000000 // total, 0) AS accuracy_ppm
FROM (SELECT unnest({_sql_list(OPERATORS)}) AS gold_op) d LEFT JOIN c ON c.gold_op = d.gold_op""",
    name="op_breakdown",
)
def op_breakdown_report(spark, sf_dir):
    """AGG-8: operator hits over the reported operators."""
    rows = op_breakdown(scored(spark, sf_dir))
    return rows.select("gold_op", "correct", "total", F.coalesce(ppm(F.col("correct"), F.nullif("total", F.lit(0))), F.lit(0)).alias("accuracy_ppm"))
