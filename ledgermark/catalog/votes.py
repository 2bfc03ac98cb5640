"""Voting, ranking and accuracy queries."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgermark.catalog.base import cents, ppm, query, table
from ledgermark.functions.answers import (
    answer_to_label,
    finalise_scaled,
    flag_answer,
    number_answer,
    prediction_to_program,
)
from ledgermark.functions.numbers import finqa_equal
from ledgermark.operators.metrics import accuracy, running_accuracy, weighted_mean
from ledgermark.operators.votes import majority_vote, rank_by_logprob, vote_pair

# Line numbers repeat within an order, so the sample's place in its order is made of every column
# the votes read, in decimal digits: rows that share a place are the same sample.
PLACE_SQL = """(l_linenumber::DECIMAL(38,0) * 10000000000000000 + l_partkey * 10000 + CAST(l_quantity AS BIGINT) * 10
    + CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 2 ELSE 4 END + CASE l_linestatus WHEN 'O' THEN 0 ELSE 1 END)"""


def digits(*parts):
    """Whole numbers side by side: ``(column, digits to its right)``, as a place."""
    total = F.lit(0).cast("decimal(27,0)")
    for column, right in parts:
        total = (total + column.cast("decimal(12,0)") * F.lit(Decimal(10**right))).cast("decimal(27,0)")
    return total


def place():
    flag = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 2).otherwise(4)
    status = F.when(F.col("l_linestatus") == "O", 0).otherwise(1)
    return digits((F.col("l_linenumber"), 16), (F.col("l_partkey"), 4), (F.col("l_quantity").cast("bigint"), 1), (flag + status, 0))


def samples(spark, sf_dir) -> DataFrame:
    """``lineitem`` as model samples of the orders."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("id"),
        place().alias("sample_idx"),
        (F.col("l_quantity") % 5).alias("answer"),
        F.col("l_partkey").cast("string").alias("code"),
    )


_VOTES_SQL = f"""
WITH s AS (SELECT l_orderkey AS id, {PLACE_SQL} AS place, CAST(l_quantity AS BIGINT) % 5 AS a,
                  CAST(l_partkey AS VARCHAR) AS code FROM lineitem),
t AS (SELECT id, a, count(*) AS n, min(place) AS first, arg_max(code, place) AS code FROM s GROUP BY id, a),
v AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, first) AS r FROM t) WHERE r = 1)
"""


@query(
    _VOTES_SQL
    + """
SELECT o_orderkey, a::VARCHAR AS prediction, coalesce(n, 0) AS votes, coalesce(code, '') AS code
FROM orders LEFT JOIN v ON o_orderkey = v.id"""
)
def vote_majority(spark, sf_dir):
    """AGG-1: the winning answer and program of every order."""
    voted = majority_vote(samples(spark, sf_dir))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    return orders.join(voted, "id", "left").select(
        F.col("id").alias("o_orderkey"),
        F.col("prediction.num").cast("bigint").cast("string").alias("prediction"),
        F.coalesce("votes", F.lit(0)).cast("bigint").alias("votes"),
        F.coalesce("code", F.lit("")).alias("code"),
    )


@query(
    _VOTES_SQL
    + """
SELECT o_orderpriority, sum(CASE WHEN a = o_orderkey % 5 THEN 1 ELSE 0 END)::BIGINT AS correct, count(*) AS total,
       (sum(CASE WHEN a = o_orderkey % 5 THEN 1 ELSE 0 END)::BIGINT * 1000000 // count(*)) AS accuracy_ppm
FROM orders LEFT JOIN v ON o_orderkey = v.id GROUP BY o_orderpriority"""
)
def vote_accuracy(spark, sf_dir):
    """AGG-1, EXE-5, NUM-2, AGG-3: vote, label, compare, report by group."""
    voted = majority_vote(samples(spark, sf_dir), code_col=None)
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), "o_orderpriority", number_answer((F.col("o_orderkey") % 5).cast("double")).alias("gold")
    )
    checked = orders.join(voted, "id", "left").select(
        "o_orderpriority", finqa_equal(answer_to_label("prediction"), "gold").alias("is_correct")
    )
    return accuracy(checked, by=["o_orderpriority"]).select(
        "o_orderpriority", "correct", "total", ppm(F.col("correct"), F.col("total")).alias("accuracy_ppm")
    )


@query(
    f"""
WITH s AS (SELECT l_orderkey AS id, {PLACE_SQL} AS place, l_shipdate IS NOT NULL AND l_discount < 0.09 AS ok,
       CASE CAST(l_quantity AS BIGINT) % 3 WHEN 2 THEN '2 million' ELSE CAST(CAST(l_quantity AS BIGINT) % 3 AS VARCHAR) END AS a,
       CASE l_returnflag WHEN 'A' THEN 'million' WHEN 'N' THEN 'none' END AS u FROM lineitem),
ids AS (SELECT DISTINCT id FROM s),
a AS (SELECT id, a FROM (SELECT id, a, row_number() OVER (PARTITION BY id ORDER BY count(*) DESC, min(place)) AS r
                         FROM s WHERE ok GROUP BY id, a) WHERE r = 1),
u AS (SELECT id, u FROM (SELECT id, coalesce(u, '') AS u, row_number() OVER (PARTITION BY id ORDER BY count(*) DESC, min(place)) AS r
                         FROM s WHERE ok GROUP BY id, coalesce(u, '')) WHERE r = 1)
SELECT ids.id AS l_orderkey, coalesce(a.a, '') AS pred,
       CASE WHEN coalesce(u.u, '') = 'none' OR contains(coalesce(a.a, ''), coalesce(u.u, '')) THEN '' ELSE coalesce(u.u, '') END AS pred_scale
FROM ids LEFT JOIN a ON ids.id = a.id LEFT JOIN u ON ids.id = u.id""",
    name="vote_pair",
)
def vote_pair_units(spark, sf_dir):
    """AGG-2, EXE-7: answer and unit voted apart, then finalised."""
    q3 = F.col("l_quantity").cast("bigint") % 3
    ballots = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("id"),
        place().alias("sample_idx"),
        (F.col("l_shipdate").isNotNull() & (F.col("l_discount") < 0.09)).alias("ok"),
        F.when(q3 == 2, F.lit("2 million")).otherwise(q3.cast("string")).alias("answer_text"),
        F.when(F.col("l_returnflag") == "A", F.lit("million")).when(F.col("l_returnflag") == "N", F.lit("none")).alias("unit"),
    )
    final = finalise_scaled("answer_text", F.lit(None).cast("array<string>"), "unit")
    return vote_pair(ballots).select(F.col("id").alias("l_orderkey"), final.alias("f")).select(
        "l_orderkey", F.get("f.pred", F.lit(0)).alias("pred"), F.col("f.pred_scale").alias("pred_scale")
    )


@query(
    f"""
WITH s AS (SELECT l_orderkey AS id, {PLACE_SQL} AS place, CAST(l_quantity AS BIGINT) % 2 AS a, l_linestatus AS st FROM lineitem),
t AS (SELECT id, a, count(*) AS n, min(place) AS first, arg_min(st, place) AS st FROM s GROUP BY id, a),
v AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, first) AS r FROM t) WHERE r = 1)
SELECT id AS l_orderkey, CASE WHEN st = 'F' AND a = 1 THEN 'greater( 1 0 ) EOF' WHEN st = 'F' THEN 'greater( 0 1 ) EOF'
       WHEN a = 1 THEN 'add( 1.0 0 ) EOF' ELSE 'add( 0.0 0 ) EOF' END AS predicted FROM v"""
)
def answer_program(spark, sf_dir):
    """AGG-1 on flags and numbers, EXE-5, EXE-6: a flag and its number are one answer, shown as first seen."""
    odd = F.col("l_quantity").cast("bigint") % 2
    mixed = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("id"),
        place().alias("sample_idx"),
        F.when(F.col("l_linestatus") == "F", flag_answer(odd == 1)).otherwise(number_answer(odd)).alias("answer"),
    )
    voted = majority_vote(mixed, code_col=None)
    return voted.select(
        F.col("id").alias("l_orderkey"),
        F.array_join(prediction_to_program(answer_to_label("prediction")), " ").alias("predicted"),
    )


@query(
    """
SELECT doc_id, (sum(hit) OVER w)::BIGINT AS correct_so_far, count(*) OVER w AS seen_so_far,
       (sum(hit) OVER w * 1000000 // count(*) OVER w)::BIGINT AS accuracy_ppm
FROM (SELECT doc_id, CASE WHEN quality = (CASE WHEN n_chars > 500 THEN 1 ELSE 0 END) THEN 1 ELSE 0 END::BIGINT AS hit
      FROM labels JOIN documents USING (doc_id))
WINDOW w AS (ORDER BY doc_id ROWS UNBOUNDED PRECEDING)""",
    name="running_accuracy",
)
def running_accuracy_by_doc(spark, sf_dir):
    """WIN-2: accuracy so far, in document order."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    judged = table(spark, sf_dir, "labels").select("doc_id", "quality").join(documents, "doc_id").select(
        "doc_id", (F.col("quality") == (F.col("n_chars") > 500).cast("int")).alias("is_correct")
    )
    return running_accuracy(judged, "doc_id").select(
        "doc_id",
        "correct_so_far",
        "seen_so_far",
        ppm(F.col("correct_so_far"), F.col("seen_so_far")).alias("accuracy_ppm"),
    )


@query(
    """
WITH d AS (SELECT l_returnflag, CAST(round(l_discount * 100) AS BIGINT) AS v, CAST(l_quantity AS BIGINT) AS w,
                  l_orderkey::DECIMAL(38,0) * 1000000000000 + l_linenumber * 100 + CAST(round(l_discount * 100) AS BIGINT) AS pos FROM lineitem)
SELECT l_returnflag, sum(v * w)::BIGINT AS weighted, sum(w)::BIGINT AS weight,
       (sum(v * w)::BIGINT * 1000000 // sum(w)::BIGINT) AS mean_ppm, arg_max(v, pos) AS last FROM d GROUP BY l_returnflag""",
    name="weighted_mean",
)
def weighted_discount(spark, sf_dir):
    """AGG-9: mean discount weighted by quantity, with the last value."""
    rows = table(spark, sf_dir, "lineitem").select(
        "l_returnflag",
        cents("l_discount").alias("v"),
        F.col("l_quantity").cast("bigint").alias("w"),
        digits((F.col("l_orderkey"), 12), (F.col("l_linenumber"), 2), (cents("l_discount"), 0)).alias("pos"),
    )
    return weighted_mean(rows, "v", "w", "pos", ["l_returnflag"]).select(
        "l_returnflag",
        F.col("sum").alias("weighted"),
        F.col("count").alias("weight"),
        ppm(F.col("sum"), F.col("count")).alias("mean_ppm"),
        "last",
    )


@query(
    """
WITH s AS (SELECT label, vec_id, list_sum(list_transform(embedding, lambda x: CAST(floor(x::DOUBLE * 1000) AS BIGINT)))::BIGINT AS score
           FROM embeddings)
SELECT label, vec_id, score, r AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= 3"""
)
def logprob_rank(spark, sf_dir):
    """SRT-1: the three best samples of each example by total log-probability."""
    completions = table(spark, sf_dir, "embeddings").select(
        F.col("label").alias("id"),
        F.col("vec_id").alias("sample_idx"),
        F.transform("embedding", lambda x: F.floor(x.cast("double") * 1000).cast("double")).alias("token_logprobs"),
    )
    return rank_by_logprob(completions, top=3).select(
        F.col("id").alias("label"), F.col("sample_idx").alias("vec_id"), F.col("score").cast("bigint").alias("score"), F.col("rank").cast("bigint").alias("rank")
    )
