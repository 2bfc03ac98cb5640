"""Program text, evaluation and clean-up queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgermark.catalog.base import cents, query, scaled, table, text_of
from ledgermark.catalog.votes import digits
from ledgermark.functions.answers import (
    answer_from_variant,
    answer_matches_display,
    coerce_answer,
    label_reject_reason,
    simplify_answer,
)
from ledgermark.functions.cleanup import (
    after_marker,
    definition_prefix,
    definitions_consistent,
    indented_body,
    prepend_definitions,
    remove_comments,
    sanitise_code,
    strip_fences,
)
from ledgermark.functions.numbers import round_n
from ledgermark.functions.programs import evaluate_program, program_to_infix, run_assignments
from ledgermark.operators.examples import drop_leading_temp
from ledgermark.plans.annotate import vote_step
from ledgermark.plans.evaluate import scaled_submission

_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def _programs(spark, sf_dir):
    """A calculation per line item: two steps, a comparison, or one that fails."""
    ln = F.col("l_linenumber")
    flag = F.col("l_returnflag")
    program = (
        F.when(flag == "A", text_of("subtract(", F.col("l_partkey"), ", ", F.col("l_suppkey"), "), multiply(#0, const_", ln, "), add(#1, const_m1)"))
        .when((flag == "N") & (ln < 5), text_of("add(", F.col("l_partkey"), ", CONST_100), greater(#0, ", F.col("l_suppkey") * 10, ")"))
        .when(flag == "N", text_of("divide(", F.col("l_partkey"), ", const_0)"))
        .when(ln < 5, text_of("exp(", ln, ", 2), divide(#0, const_4)"))
        .when(ln == 5, text_of("table_max(row ", ln, ", none)"))
        .otherwise(text_of("modulo(", ln, ", 2)"))
    )
    return table(spark, sf_dir, "lineitem").select(*_KEYS, "l_returnflag").select(*_KEYS, program.alias("program"))


@query(
    """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE WHEN l_returnflag = 'A' THEN 'x0 = ' || l_partkey || ' - ' || l_suppkey || '; x1 = x0 * ' || l_linenumber || '; ans = x1 + -1'
       WHEN l_returnflag = 'N' AND l_linenumber < 5 THEN 'x0 = ' || l_partkey || ' + 100; ans = x0 > ' || (l_suppkey * 10)
       WHEN l_returnflag = 'N' THEN 'ans = ' || l_partkey || ' / 0'
       WHEN l_linenumber < 5 THEN 'x0 = ' || l_linenumber || ' ^ 2; ans = x0 / 4'
       WHEN l_linenumber = 5 THEN 'ans = max(row 5)' END AS infix
FROM lineitem"""
)
def program_infix(spark, sf_dir):
    """PRJ-4..6: every program in infix form."""
    return _programs(spark, sf_dir).select(*_KEYS, program_to_infix("program").alias("infix"))


@query(
    """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE WHEN l_returnflag = 'A' THEN 'float' WHEN l_returnflag = 'N' AND l_linenumber < 5 THEN 'bool'
       WHEN l_returnflag = 'N' THEN NULL WHEN l_linenumber < 5 THEN 'float' END AS kind,
  CASE WHEN l_returnflag = 'A' THEN ((l_partkey - l_suppkey) * l_linenumber - 1) * 10000
       WHEN l_returnflag = 'N' AND l_linenumber < 5 THEN CASE WHEN l_partkey + 100 > l_suppkey * 10 THEN 10000 ELSE 0 END
       WHEN l_returnflag = 'N' THEN NULL WHEN l_linenumber < 5 THEN l_linenumber * l_linenumber * 2500 END::BIGINT::VARCHAR AS value_e4
FROM lineitem"""
)
def program_eval(spark, sf_dir):
    """EXE-1: every program's answer, null where it fails."""
    done = _programs(spark, sf_dir).select(*_KEYS, evaluate_program("program").alias("a"))
    return done.select(*_KEYS, F.col("a.kind").alias("kind"), scaled(F.col("a.num"), 10000).cast("string").alias("value_e4"))


@query(
    """
SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'int' WHEN 'P' THEN 'bool' END AS kind,
  CASE o_orderstatus WHEN 'O' THEN (o_orderkey + o_custkey) * 2 - 2 + greatest(o_orderkey, o_custkey) WHEN 'P' THEN CASE WHEN o_orderkey > o_custkey THEN 1 ELSE 0 END END::BIGINT::VARCHAR AS value,
  o_orderstatus <> 'F' AS ok
FROM orders"""
)
def assignment_eval(spark, sf_dir):
    """EXE-2, CLN-1, CLN-2, CLN-7: definitions and calculation run together; an import is refused."""
    definitions = text_of("a_b = ", F.col("o_orderkey"), "\nc = ", F.col("o_custkey"))
    calculation = (
        F.when(F.col("o_orderstatus") == "O", F.lit("```python\nans = (a&b + c) * 2 - len([a&b, c]) + max(a&b, c)\n```"))
        .when(F.col("o_orderstatus") == "P", F.lit("```\nans = a&b > c\n```"))
        .otherwise(F.lit("```python\nimport os\nans = 1\n```"))
    )
    code = prepend_definitions(definitions, sanitise_code(strip_fences(calculation)))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    ran = orders.select("o_orderkey", run_assignments(code).alias("r"))
    return ran.select(
        "o_orderkey", F.col("r.ans.kind").alias("kind"), F.col("r.ans.num").cast("bigint").cast("string").alias("value"), F.col("r.ok").alias("ok")
    )


@query(
    """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT) AS quantity,
  'qty = ' || CAST(l_quantity AS BIGINT) || chr(10) || 'part = ' || l_partkey || chr(10)
    || CASE WHEN l_returnflag = 'A' THEN 'both = part * 2' || chr(10) ELSE '' END AS definitions,
  CAST(l_quantity AS BIGINT) || '|' || l_partkey || CASE WHEN l_returnflag = 'A' THEN '|part*2' ELSE '' END AS defined,
  l_returnflag <> 'A' AS consistent,
  l_returnflag <> 'A' AND (l_partkey = CAST(l_quantity AS BIGINT) OR l_partkey = l_partkey * 10) AS whole_tokens,
  'qty = ' || CAST(l_quantity AS BIGINT) || chr(10) || 'part = ' || l_partkey || chr(10)
    || CASE WHEN l_returnflag = 'A' THEN 'both = part * 2' || chr(10) ELSE '' END || 'print(qty)' || chr(10) || 'rest = 1' AS bare
FROM lineitem WHERE l_returnflag <> 'R'"""
)
def definitions(spark, sf_dir):
    """CLN-4, CLN-6, FLT-2, FLT-3: leading definitions checked against the program.

    Returned items start with an intermediate result, so the filter drops them.
    """
    q, p = F.col("l_quantity").cast("bigint"), F.col("l_partkey")
    flag = F.col("l_returnflag")
    both = F.when(flag == "A", F.lit("both = part  * 2\n")).otherwise(F.lit(""))
    code = text_of(
        F.when(flag == "R", F.lit("x0 = 1\n")).otherwise(F.lit("")),
        "qty = ", q, "  # pieces\n", "part = ", p, "\n", both, "#no comment\nprint(qty)\nrest = 1",
    )
    items = table(spark, sf_dir, "lineitem").select(*_KEYS, "l_quantity", "l_returnflag")
    # filtered before the costly columns: the optimiser would repeat those in the filter
    rows = drop_leading_temp(items.select(*_KEYS, q.alias("quantity"), code.alias("code")))
    kept = rows.withColumn("bare", remove_comments("code")).withColumn("d", definition_prefix("bare"))
    program = text_of("ans = ", F.col("quantity"), " / ", F.col("l_partkey") * 10)
    return kept.select(
        *_KEYS,
        "quantity",
        F.col("d.code").alias("definitions"),
        F.array_join("d.values", "|").alias("defined"),
        definitions_consistent("d.values", program).alias("consistent"),
        definitions_consistent("d.values", program, True).alias("whole_tokens"),
        "bare",
    )




@query(
    """
WITH c AS (SELECT conv_id, turn, replace(text, chr(10) || chr(10), chr(10)) AS t FROM conversations)
SELECT conv_id, turn, CASE WHEN contains(t, '```') THEN split_part(t, '```', 1) ELSE t END AS fenced, t AS marked,
  'def solver():' || chr(10) || replace(t, chr(10), chr(10) || '    ') || chr(10) || '    ' || role || chr(10) || 'ans = solver()' AS body
FROM c JOIN conversations USING (conv_id, turn)"""
)
def clean_completion(spark, sf_dir):
    """CLN-1, CLN-3, CLN-5: each turn wrapped as model output and cut out again."""
    plain = F.replace(F.col("text"), F.lit("\n\n"), F.lit("\n"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", plain.alias("t"))
    marked = text_of("prompt #Python:\nexample\n\n#Python:\n", F.col("t"), "\n\nand more")
    fenced = text_of("```python\nfirst```python\n", F.col("t"), "```tail")
    body = text_of(F.replace(F.col("t"), F.lit("\n"), F.lit("\n    ")), "\n    ", F.col("role"), "\nrest\n    more")
    return rows.select(
        "conv_id",
        "turn",
        after_marker(marked, "#Python:\n", -1).alias("marked"),
        after_marker(fenced, "```python\n", 3, "```").alias("fenced"),
        indented_body(body, "def solver():\n").alias("body"),
    )


@query(
    """
WITH c AS (SELECT c_custkey, abs(CAST(round(c_acctbal * 100) AS BIGINT)) AS c, c_custkey % 7 AS form, c_mktsegment AS seg FROM customer)
SELECT c_custkey,
  CASE form WHEN 4 THEN 'bool' WHEN 3 THEN 'text' WHEN 5 THEN NULL ELSE 'float' END AS kind,
  CASE form WHEN 0 THEN c // 100 * 100 WHEN 6 THEN 700 WHEN 3 THEN NULL WHEN 4 THEN CASE WHEN c > 500000 THEN 100 ELSE 0 END WHEN 5 THEN NULL ELSE c END::BIGINT::VARCHAR AS value_e2,
  CASE form WHEN 3 THEN seg WHEN 4 THEN CASE WHEN c > 500000 THEN 'True' END WHEN 6 THEN '7' WHEN 5 THEN NULL
       WHEN 0 THEN CASE WHEN c // 100 <> 0 THEN (c // 100)::VARCHAR END
       WHEN 2 THEN (c // 100) || '.' || lpad((c % 100)::VARCHAR, 2, '0')
       ELSE CASE WHEN c <> 0 THEN (c / 100.0)::DOUBLE::VARCHAR END END AS simple,
  CASE form WHEN 3 THEN 'answer is text' WHEN 5 THEN 'no answer' END AS reason,
  CASE WHEN form IN (4, 5) THEN NULL WHEN form IN (1, 2) THEN c % 10 <> 0 ELSE true END::VARCHAR AS shown,
  CASE WHEN form IN (0, 1, 2, 6) THEN CASE form WHEN 0 THEN round_even(c // 100 / 100.0::DOUBLE, 0) WHEN 6 THEN 0 ELSE round_even(c / 10000.0::DOUBLE, 0) END * 100 END::BIGINT::VARCHAR AS hundreds
FROM c"""
)
def answer_coerce(spark, sf_dir):
    """EXE-3, EXE-4, NUM-3, FLT-5: answers of every JSON kind, coerced, simplified and shown."""
    c, form = F.abs(cents("c_acctbal")), F.col("c_custkey") % 7
    whole, part = F.floor(c / 100), F.lpad((c % 100).cast("string"), 2, "0")
    two = text_of(whole, ".", part)
    js = (
        F.when(form == 0, whole.cast("string"))
        .when(form == 1, text_of(two, "e0"))
        .when(form == 2, text_of('"', two, '"'))
        .when(form == 3, text_of('"', F.col("c_mktsegment"), '"'))
        .when(form == 4, F.when(c > 500000, F.lit("true")).otherwise(F.lit("false")))
        .when(form == 5, F.lit("null"))
        .otherwise(F.lit('["7"]'))
    )
    shown = F.when(form == 3, F.col("c_mktsegment")).when(form == 0, text_of("$ ", whole)).when(form == 6, F.lit("700%")).otherwise(two)
    rows = table(spark, sf_dir, "customer").select("c_custkey", answer_from_variant(F.try_parse_json(js)).alias("v"), shown.alias("s"))
    ans = rows.withColumn("a", coerce_answer("v"))
    numeric = F.col("a.kind") == "float"
    return ans.select(
        "c_custkey",
        F.col("a.kind").alias("kind"),
        scaled(F.col("a.num"), 100).cast("string").alias("value_e2"),
        simplify_answer("v").alias("simple"),
        label_reject_reason("a").alias("reason"),
        F.when(numeric | (F.col("a.kind") == "text"), answer_matches_display("s", "a")).cast("string").alias("shown"),
        F.when(numeric, round_n("a.num", F.lit(-2))).cast("bigint").cast("string").alias("hundreds"),
    )


@query(
    """
WITH s AS (SELECT l_orderkey AS id, l_linenumber::DECIMAL(38,0) * 10000000000000000 + l_partkey * 1000 + CAST(l_quantity AS BIGINT) AS place,
    CAST(l_quantity AS BIGINT) AS q, l_partkey AS p FROM lineitem),
t AS (SELECT id, q % 3 AS a, count(*) AS n, min(place) AS first, arg_max('part_no = ' || p || chr(10) || 'qty = ' || q || chr(10) || 'ans = qty % 3' || chr(10), place) AS code FROM s GROUP BY id, q % 3),
v AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, first) AS r FROM t) WHERE r = 1)
SELECT o_orderkey::VARCHAR AS id, coalesce(code, '') AS generated, a::VARCHAR AS executed, coalesce(a = o_orderkey % 3, false) AS is_correct
FROM orders LEFT JOIN v ON v.id = o_orderkey"""
)
def annotate_and_verify(spark, sf_dir):
    """The annotation flow: clean the samples, run them, vote, compare with the answer (CLN, EXE, AGG-1, NUM-2)."""
    q = F.col("l_quantity").cast("bigint")
    completions = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity").select(
        F.col("l_orderkey").cast("string").alias("id"),
        digits((F.col("l_linenumber"), 16), (F.col("l_partkey"), 3), (q, 0)).alias("sample_idx"),
        text_of("```python\npart&no = ", F.col("l_partkey"), "\nqty = ", q, "\nans = qty % 3\n```").alias("text"),
    )
    examples = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("id"), F.try_parse_json((F.col("o_orderkey") % 3).cast("string")).alias("answer")
    )
    done = vote_step(examples, completions)
    return done.select("id", F.get("generated", F.lit(0)).alias("generated"), F.col("executed.num").cast("bigint").cast("string").alias("executed"), "is_correct")


@query(
    """
WITH s AS (SELECT o_custkey AS id, o_orderkey AS place, o_orderstatus <> 'F' AS ok, o_orderkey % 4 AS a,
    CASE WHEN o_orderpriority = '5-LOW' THEN '' WHEN o_orderpriority = '1-URGENT' THEN 'none' ELSE 'million' END AS u FROM orders),
a AS (SELECT id, a FROM (SELECT id, a, row_number() OVER (PARTITION BY id ORDER BY count(*) DESC, min(place)) AS r FROM s WHERE ok GROUP BY id, a) WHERE r = 1),
u AS (SELECT id, u FROM (SELECT id, u, row_number() OVER (PARTITION BY id ORDER BY count(*) DESC, min(place)) AS r FROM s WHERE ok GROUP BY id, u) WHERE r = 1)
SELECT ids.id AS uid, CASE WHEN a.a = 3 THEN 'c million|d' ELSE coalesce(a.a::VARCHAR, '') END AS pred,
  CASE WHEN coalesce(u.u, 'none') = 'none' OR a.a = 3 AND u.u = 'million' THEN '' ELSE u.u END AS pred_scale
FROM (SELECT DISTINCT id FROM s) ids LEFT JOIN a ON a.id = ids.id LEFT JOIN u ON u.id = ids.id"""
)
def scaled_predictions(spark, sf_dir):
    """CLN-3, EXE-2 with two results, AGG-2, EXE-7: decoded outputs to a scored submission."""
    number = F.col("o_orderkey") % 4
    unit = (
        F.when(F.col("o_orderpriority") == "5-LOW", F.lit(""))
        .when(F.col("o_orderpriority") == "1-URGENT", F.lit("\nunits = 'none'"))
        .otherwise(F.lit("\nunits = 'million'"))
    )
    value = F.when(number == 3, F.lit("['c million', 'd']")).otherwise(number.cast("string"))
    fault = F.when(F.col("o_orderstatus") == "F", F.lit("\nx = missing")).otherwise(F.lit(""))
    outputs = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", "o_orderstatus").select(
        F.col("o_custkey").alias("id"),
        F.col("o_orderkey").alias("sample_idx"),
        text_of("question\n#Python\nans = ", value, unit, fault, "\n\nmore").alias("text"),
    )
    return scaled_submission(outputs).select("uid", F.array_join("pred", "|").alias("pred"), "pred_scale")
