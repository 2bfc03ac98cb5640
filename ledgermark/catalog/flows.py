"""Whole flows: scoring from documents, stored responses, definitions, outputs, resuming."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgermark.catalog.base import cents, query, scaled, table, text_of
from ledgermark.functions.answers import flag_answer, number_answer, text_answer
from ledgermark.functions.numbers import finqa_equal
from ledgermark.functions.programs import evaluate_program
from ledgermark.functions.scoring import em_f1
from ledgermark.operators.joins import join_completions
from ledgermark.plans.annotate import definition_step
from ledgermark.plans.evaluate import check_predictions, evaluate_predictions, predict_from_outputs
from ledgermark.session import shared_dir
from ledgermark.sources.json_arrays import read_large_json_array
from ledgermark.sources.readers import load_completions, read_json_array, resume_from
from ledgermark.sources.runs import read_errors, read_run, write_scored_run


def _gold_and_predictions(spark, sf_dir):
    """Each customer as a gold document of a span and an arithmetic question, and what was predicted."""
    key = F.col("c_custkey")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", (F.abs(cents("c_acctbal")) + 1).alias("c"))
    question = lambda end, kind, source, scale, answer: F.struct(
        text_of(key, end).alias("uid"), F.lit(kind).alias("answer_type"), source.alias("answer_from"),
        F.lit(scale).alias("scale"), F.try_parse_json(answer).alias("answer"),
    )
    source = F.when(key % 2 == 0, F.lit("table")).otherwise(F.lit("text"))
    gold = customers.select(
        F.array(
            question("-a", "span", source, "", text_of('["', F.col("c_mktsegment"), '"]')),
            question("-b", "arithmetic", F.lit("table-text"), "million", F.col("c").cast("string")),
        ).alias("questions")
    )
    span = F.when(key % 3 == 0, F.col("c_mktsegment")).when(key % 3 == 1, text_of(F.col("c_mktsegment"), " extra")).otherwise(F.lit("none of these"))
    unit = F.when(key % 5 == 0, F.lit("thousand")).otherwise(F.lit("million"))
    predicted = customers.select(
        F.inline(
            F.array(
                F.struct(text_of(key, "-a").alias("uid"), F.array(span).alias("pred"), F.lit("").alias("pred_scale")),
                F.struct(F.when(key % 7 != 0, text_of(key, "-b")).alias("uid"), F.array(F.col("c").cast("string")).alias("pred"), unit.alias("pred_scale")),
            )
        )
    )
    return gold, predicted.filter("uid is not null")


_SCORED_SQL = """
WITH a AS (SELECT c_custkey || '-a' AS uid, 'span' AS answer_type, CASE c_custkey % 2 WHEN 0 THEN 'table' ELSE 'text' END AS source,
    CASE c_custkey % 3 WHEN 0 THEN 100 ELSE 0 END AS em, CASE c_custkey % 3 WHEN 0 THEN 100 WHEN 1 THEN 67 ELSE 0 END AS f1, true AS scale_em FROM customer),
b AS (SELECT c_custkey || '-b' AS uid, 'arithmetic' AS answer_type, 'table-text' AS source, CASE WHEN c_custkey % 7 <> 0 AND c_custkey % 5 <> 0 THEN 100 ELSE 0 END AS em,
    c_custkey % 7 <> 0 AND c_custkey % 5 <> 0 AS scale_em FROM customer),
s AS (SELECT uid, answer_type, source, em, f1, scale_em FROM a UNION ALL SELECT uid, answer_type, source, em, em, scale_em FROM b)
"""


@query(_SCORED_SQL + "SELECT uid, em::BIGINT AS em_pct, f1::BIGINT AS f1_pct, scale_em FROM s", name="tatqa_evaluate")
def evaluated_documents(spark, sf_dir):
    """SCO-5..8, JON-1: gold documents with variant answers, exploded, joined to predictions and scored."""
    scored = evaluate_predictions(*_gold_and_predictions(spark, sf_dir))["scored"]
    return scored.select("uid", scaled(F.col("em"), 100).alias("em_pct"), scaled(F.col("f1"), 100).alias("f1_pct"), "scale_em")


@query(
    _SCORED_SQL
    + """
SELECT answer_type, 'f1' AS metric, {cells} FROM s GROUP BY answer_type
UNION ALL SELECT answer_type, 'em', {em_cells} FROM s GROUP BY answer_type
UNION ALL SELECT 'all', 'percent', printf('%.2f', avg(em)), printf('%.2f', avg(f1)), printf('%.2f', avg(scale_em::INT) * 100) FROM s""".format(
        cells=", ".join(f"coalesce(round(avg(f1) FILTER (source = '{s}') * 100)::BIGINT, 0)::VARCHAR AS {n}" for s, n in (("table", "a"), ("text", "b"), ("table-text", "c"))),
        em_cells=", ".join(f"coalesce(round(avg(em) FILTER (source = '{s}') * 100)::BIGINT, 0)::VARCHAR" for s in ("table", "text", "table-text")),
    ),
    name="tatqa_report",
)
def evaluation_report(spark, sf_dir):
    """SCO-8, AGG-4, AGG-5: EM and F1 pivots in hundredths of a per cent, and the percentages of all rows; scored once."""
    listed = evaluate_predictions(*_gold_and_predictions(spark, sf_dir))["listed"]
    wanted = listed.filter(F.col("report").isin("em_by_type", "f1_by_type") | ((F.col("report") == "overall") & F.col("column").isin("em", "f1", "scale_em")))
    overall = F.col("report") == "overall"
    shown = lambda v: F.when(overall, F.translate(F.format_number(v * 100, 2), ",", "")).otherwise(scaled(v, 10000).cast("string"))
    value = lambda *columns: shown(F.coalesce(F.max(F.when(F.col("column").isin(*columns), F.col("value"))), F.lit(0.0)))
    return wanted.groupBy("report", F.col("row").alias("answer_type")).agg(
        value("table", "em").alias("a"), value("text", "f1").alias("b"), value("table-text", "scale_em").alias("c")
    ).select("answer_type", F.when(overall, "percent").otherwise(F.substring("report", 1, 2)).alias("metric"), "a", "b", "c")


@query(
    _SCORED_SQL
    + """, o AS (SELECT uid, answer_type, source, em / 100.0 AS em, f1 / 100.0 AS f1, scale_em::INT AS scale_em, CASE answer_type WHEN 'span' THEN '' ELSE 'million' END AS scale FROM s)
SELECT report, "row", "column", round(value * 10000)::BIGINT AS value_e4 FROM (
  SELECT 'overall' AS report, 'all' AS "row", unnest(['em', 'f1', 'scale_em', 'op_em', 'total']) AS "column", unnest([avg(em), avg(f1), avg(scale_em), 0, count(*)]::DOUBLE[]) AS value FROM o
  UNION ALL SELECT unnest(['em_by_type', 'f1_by_type', 'count_by_type']), answer_type, source, unnest([avg(em), avg(f1), count(*)]::DOUBLE[]) FROM o GROUP BY answer_type, source
  UNION ALL SELECT 'by_scale', d.scale, unnest(['correct', 'total', 'accuracy']), unnest([coalesce(sum(scale_em), 0), count(o.uid), coalesce(avg(scale_em), 0)]::DOUBLE[])
    FROM (VALUES (''), ('thousand'), ('million'), ('billion'), ('percent')) AS d(scale) LEFT JOIN o ON o.scale = d.scale GROUP BY d.scale)""",
    name="tatqa_all_reports",
)
def all_reports(spark, sf_dir):
    """SCO-8, AGG-4 to AGG-7: every report of an evaluation in one result, by GROUPING SETS over one scoring."""
    listed = evaluate_predictions(*_gold_and_predictions(spark, sf_dir))["listed"]
    return listed.select("report", "row", "column", scaled(F.col("value"), 10000).alias("value_e4"))


@query(
    """
SELECT c_custkey, CASE c_custkey % 3 WHEN 2 THEN 0 ELSE 100 END::BIGINT AS em_pct, CASE c_custkey % 3 WHEN 2 THEN 67 ELSE 100 END::BIGINT AS f1_pct FROM customer"""
)
def answer_em_f1(spark, sf_dir):
    """SCO-3, SCO-5: one answer string against one, by exact match and token F1."""
    key, gold = F.col("c_custkey"), F.col("c_mktsegment")
    pred = F.when(key % 3 == 0, gold).when(key % 3 == 1, F.concat(F.lit("The "), F.lower(gold), F.lit("!"))).otherwise(F.concat(gold, F.lit(" more")))
    rows = table(spark, sf_dir, "customer").select("c_custkey", em_f1(pred, gold).alias("s"))
    return rows.select("c_custkey", scaled(F.col("s.em"), 100).alias("em_pct"), scaled(F.col("s.f1"), 100).alias("f1_pct"))


def _stored(spark, sf_dir):
    """Orders with an odd key as stored responses of two samples, chat and plain, read back; and all orders."""
    key, part = F.col("o_orderkey"), F.col("o_custkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    chat = F.struct(
        F.lit(None).cast("string").alias("text"),
        F.struct(F.lit("assistant").alias("role"), text_of("```python\ncust&no = ", part, "\n```\nprint(1)").alias("content")).alias("message"),
    )
    plain = F.struct(
        text_of("ans = ", key).alias("text"),
        F.struct(F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("content")).alias("message"),
    )
    folder = shared_dir(spark, "responses")
    orders.filter(key % 2 == 1).select(key.cast("string").alias("id"), F.array(chat, plain).alias("choices")).write.json(folder)
    return orders, load_completions(spark, folder)


@query(
    """
WITH s AS (SELECT o_orderkey, unnest([0, 1]) AS i, unnest(['```python' || chr(10) || 'cust&no = ' || o_custkey || chr(10) || '```' || chr(10) || 'print(1)', 'ans = ' || o_orderkey]) AS text
  FROM orders WHERE o_orderkey % 2 = 1)
SELECT o.o_orderkey::VARCHAR AS id, s.i::VARCHAR AS sample_idx, s.text FROM orders o LEFT JOIN s ON s.o_orderkey = o.o_orderkey""",
    name="stored_completions",
)
def stored_responses(spark, sf_dir):
    """SRC-3, JON-2: responses stored one per line, read as samples and attached to every example."""
    orders, completions = _stored(spark, sf_dir)
    examples = orders.select(F.col("o_orderkey").cast("string").alias("id"))
    return join_completions(examples, completions).select("id", F.col("sample_idx").cast("string").alias("sample_idx"), "text")


@query(
    """
SELECT o_orderkey::VARCHAR AS id, CASE WHEN o_orderkey % 2 = 1 THEN 'cust_no = ' || o_custkey || chr(10) ELSE '' END AS generated,
  o_orderkey % 2 = 1 AND (o_custkey % 3 <> 0 OR contains('ans = 1', o_custkey::VARCHAR)) AS is_correct FROM orders"""
)
def definition_check(spark, sf_dir):
    """JON-2, CLN-1, CLN-2, CLN-4, FLT-3: the definitions step over stored responses."""
    orders, completions = _stored(spark, sf_dir)
    program = F.when(F.col("o_custkey") % 3 == 0, F.lit("ans = 1")).otherwise(text_of("ans = ", F.col("o_custkey"), " / 2"))
    examples = orders.select(F.col("o_orderkey").cast("string").alias("id"), program.alias("program"))
    return definition_step(examples, completions).select("id", F.get("generated", F.lit(0)).alias("generated"), "is_correct")


@query("SELECT c_custkey::VARCHAR AS id, c_mktsegment AS text, c_nationkey FROM customer", name="json_array_scan")
def scanned_json_arrays(spark, sf_dir):
    """SRC-1: customers written as files of one JSON array each, by hundreds of keys, and read back."""
    key = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(
        F.floor(key / 100).alias("part"), F.struct(key.cast("string").alias("id"), F.col("c_mktsegment").alias("text"), "c_nationkey").alias("r")
    )
    folder = shared_dir(spark, "arrays")
    arrays = rows.groupBy("part").agg(F.to_json(F.collect_list("r")).alias("value"))  # a hundred keys at most
    arrays.write.partitionBy("part").text(folder)
    return read_json_array(spark, folder, "id string, text string, c_nationkey int").select("id", "text", "c_nationkey")


@query("""
    SELECT c_custkey, concat('{"', c_name, '}\\"[', c_custkey, ']') AS note,
           row_number() OVER (PARTITION BY c_custkey // 10000 ORDER BY c_custkey) - 1 AS pos
    FROM customer
""")
def json_array_blocks(spark, sf_dir):
    """SRC-1: customers in arrays of ten thousand keys, with braces and quotes in their notes, each file read by blocks."""
    key = F.col("c_custkey")
    note = text_of('{"', F.col("c_name"), '}\\"[', key, "]")
    rows = table(spark, sf_dir, "customer").select(F.floor(key / 10_000).alias("part"), F.struct("c_custkey", note.alias("note")).alias("r"))
    folder = shared_dir(spark, "large-arrays")
    arrays = rows.groupBy("part").agg(F.to_json(F.array_sort(F.collect_list("r"))).alias("value"))  # ten thousand keys at most
    arrays.write.partitionBy("part").text(folder)
    return read_large_json_array(spark, folder, "c_custkey bigint, note string", place=True).select("c_custkey", "note", "pos")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey >= (SELECT count(*) // 3 FROM orders)")
def resume_rows(spark, sf_dir):
    """SRC-4: the rows from a third of the way on."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return resume_from(orders, orders.count() // 3, "o_orderkey")


@query(
    """
SELECT c_custkey, c_custkey % 6 IN (1, 3) AS plain, c_custkey % 6 IN (0, 1, 3) AS percentage FROM customer""",
    name="answer_forms_equal",
)
def equal_in_any_form(spark, sf_dir):
    """NUM-2: percentages, yes/no, text and missing answers against the gold answer."""
    c, form, seg = F.abs(cents("c_acctbal")) + 10001, F.col("c_custkey") % 6, F.col("c_mktsegment")
    pred = (
        F.when(form == 0, number_answer(c / 100))
        .when(form.isin(1, 2), flag_answer(F.lit(True)))
        .when(form.isin(3, 4), text_answer(seg))
    )
    gold = (
        F.when(form.isin(0, 4), number_answer(c.cast("double")))
        .when(form == 1, text_answer(F.lit("yes")))
        .when(form == 2, text_answer(F.lit("no")))
        .otherwise(text_answer(seg))
    )
    rows = table(spark, sf_dir, "customer").select("c_custkey", pred.alias("p"), gold.alias("g"))
    return rows.select("c_custkey", finqa_equal("p", "g").alias("plain"), finqa_equal("p", "g", include_percentage=True).alias("percentage"))


@query(
    """
SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN o_orderkey + o_custkey WHEN 'P' THEN greatest(o_orderkey, o_custkey) - 1 END::BIGINT::VARCHAR AS value FROM orders"""
)
def table_program_eval(spark, sf_dir):
    """EXE-1 with a table: sums and maxima of a named row; a cell that is no number fails the program."""
    cells = F.array(
        F.array(F.lit(""), F.lit("2019"), F.lit("2020")),
        F.array(F.lit("total "), text_of("$ ", F.format_number("o_orderkey", 0)), text_of(F.col("o_custkey"), " (net)")),
        F.array(F.lit("bad"), F.lit("n/a"), F.lit("1")),
    )
    program = (
        F.when(F.col("o_orderstatus") == "O", F.lit("table_sum(total, none)"))
        .when(F.col("o_orderstatus") == "P", F.lit("table_max(total, none), subtract(#0, const_1)"))
        .otherwise(F.lit("table_average(bad, none)"))
    )
    done = table(spark, sf_dir, "orders").select("o_orderkey", evaluate_program(program, cells).alias("a"))
    return done.select("o_orderkey", F.col("a.num").cast("bigint").cast("string").alias("value"))


@query(
    """
WITH s AS (SELECT o_custkey AS id, o_orderkey AS place, o_orderkey % 2 + 1 AS a FROM orders WHERE o_orderstatus <> 'P'),
v AS (SELECT id, a FROM (SELECT id, a, row_number() OVER (PARTITION BY id ORDER BY count(*) DESC, min(place)) AS r FROM s GROUP BY id, a) WHERE r = 1)
SELECT c_custkey, v.a::VARCHAR AS executed, coalesce(v.a = c_custkey % 2 + 1, false) AS is_correct FROM customer LEFT JOIN v ON v.id = c_custkey""",
    name="evaluate_outputs",
)
def evaluated_outputs(spark, sf_dir):
    """CLN-2, CLN-3, EXE-2, EXE-5, AGG-1, NUM-2: decoded outputs cut, run, voted on and checked."""
    code = F.when(F.col("o_orderstatus") == "P", F.lit("ans = missing")).otherwise(text_of("ans = ", F.col("o_orderkey"), " % 2 + 1!"))
    outputs = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("sample_idx"), text_of("prompt\n#Python:\nold\n\n#Python:\n", code, "\n\nrest").alias("text")
    )
    examples = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 2 + 1).cast("double").alias("answer"))
    done = check_predictions(examples, predict_from_outputs(outputs))
    return done.select(F.col("id").alias("c_custkey"), F.col("executed.num").cast("bigint").cast("string").alias("executed"), "is_correct")


@query("""
    SELECT o_orderpriority, count(*) AS n_wrong,
           (SELECT count(*) FROM orders t WHERE t.o_orderpriority = o.o_orderpriority) AS n_all
    FROM orders o WHERE o_orderkey % 3 = 0 OR o_orderkey % 5 = 0 GROUP BY o_orderpriority
""")
def committed_run(spark, sf_dir):
    """SNK-2, SNK-3: orders with right, wrong and missing verdicts and a report, written as one commit; errors beside the report."""
    key = F.col("o_orderkey")
    scored = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", F.when(key % 5 != 0, key % 3 != 0).alias("is_correct"))
    folder = shared_dir(spark, "runs")
    write_scored_run(scored, folder, {"report": scored.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n_all"))})
    wrong = read_errors(spark, folder).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n_wrong"))
    return wrong.join(read_run(spark, folder, "report"), "o_orderpriority")
