"""Examples, tables, shards, sampling and file queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgermark.catalog.base import cents, query, table, text_of
from ledgermark.functions.draws import draw_key, sample_distractors, sample_years
from ledgermark.functions.tables import gold_text as join_gold
from ledgermark.functions.tables import (
    extract_table_block,
    payload_fields,
    payload_text,
    table_prompt,
    trim_generated_text,
    valid_payload,
)
from ledgermark.operators.examples import normalise_examples, unpivot_qa
from ledgermark.operators.joins import distinct_variables, replicate_formulas, without_done
from ledgermark.operators.shards import dedup_keep_first, sample_n, shuffle_rows, union_shards
from ledgermark.operators.tables import (
    complete_tables,
    has_complete_series,
    pair_table_text,
    parse_markdown_table,
    table_lines,
    to_year_rows,
)
from ledgermark.session import shared_dir
from ledgermark.sources.readers import SHARD_ORDER, read_jsonl_tree
from ledgermark.sources.writers import write_errors, write_json, write_predictions, write_scored_split
from ledgermark.streaming.ingest import ingest_completions_stream, read_ingested


def _raw_records(spark, sf_dir):
    """Each event as a report record with one to three questions."""
    kind = F.col("event_type")

    def asked(name: str, when, program):
        return F.when(
            when,
            F.struct(
                text_of(name, " of ", F.col("user_id"), "?").alias("question"),
                F.try_parse_json(F.col("event_id").cast("string")).alias("exe_ans"),
                program.alias("program"),
                F.create_map(
                    F.lit("text_0"), text_of(name, " "), F.lit("table_1"), F.lit("row"), F.lit("more_text"), F.col("props")
                ).alias("gold_inds"),
            ),
        )

    whole = text_of("subtract(", F.col("event_id"), ", const_m", F.col("user_id"), "), divide(#0, ", F.col("user_id"), ")")
    odd = F.when(kind == "signup", F.lit("modulo(1, 2)")).otherwise(text_of("table_sum(", kind, ", none)"))
    return table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("id"),
        F.array(F.array(F.lit(""), F.lit("user")), F.array(kind, F.col("user_id").cast("string"))).alias("table"),
        asked("total", kind != "error", whole).alias("qa"),
        asked("first", kind.isin("view", "signup"), odd).alias("qa_0"),
        asked("second", kind.isin("error", "signup"), whole).alias("qa_1"),
    )


_VARIANTS_SQL = """
WITH e AS (
  SELECT *, 'qa' AS variant, 'total' AS name, true AS whole FROM events WHERE event_type <> 'error'
  UNION ALL SELECT *, 'qa_0', 'first', false FROM events WHERE event_type IN ('view', 'signup')
  UNION ALL SELECT *, 'qa_1', 'second', true FROM events WHERE event_type IN ('error', 'signup')),
p AS (SELECT *, name || ' of ' || user_id || '?' AS question,
  CASE WHEN whole THEN 'subtract(' || event_id || ', const_m' || user_id || '), divide(#0, ' || user_id || ')'
       WHEN event_type = 'signup' THEN 'modulo(1, 2)' ELSE 'table_sum(' || event_type || ', none)' END AS program FROM e)
"""


@query(_VARIANTS_SQL + "SELECT event_id::VARCHAR AS id, variant, question, program FROM p", name="unpivot_qa")
def unpivot_questions(spark, sf_dir):
    """PRJ-1: one row per question of each record."""
    return unpivot_qa(_raw_records(spark, sf_dir)).select("id", "variant", "question", "program")


@query(
    _VARIANTS_SQL
    + """
SELECT event_id::VARCHAR AS id, variant, question, name || ' ' || props AS text,
  '- | user' || chr(10) || event_type || ' | ' || user_id || chr(10) AS table,
  CASE WHEN whole THEN 'x0 = ' || event_id || ' - -' || user_id || '; ans = x0 / ' || user_id
       WHEN event_type = 'view' THEN 'ans = sum(view)' END AS program,
  CASE WHEN NOT whole AND event_type = 'signup' THEN 'unknown operation' END AS reason
FROM p""",
    name="normalise_examples",
)
def normalised_examples(spark, sf_dir):
    """PRJ-2..7, FLT-1: every question as a flat example, rejects with their reason."""
    judged = normalise_examples(_raw_records(spark, sf_dir))
    return judged.select("id", "variant", "question", "text", "table", "program", "reason")


@query(_VARIANTS_SQL + "SELECT event_id::VARCHAR AS id, variant, name || ' ' || props AS gold FROM p")
def gold_text(spark, sf_dir):
    """PRJ-2: the gold passages of every question, by key, in map order."""
    asked = unpivot_qa(_raw_records(spark, sf_dir))
    return asked.select("id", "variant", join_gold("gold_inds").alias("gold"))


@query(
    """
WITH l AS (SELECT l_orderkey, l_linenumber, count(*) AS n, sum(CAST(l_quantity AS BIGINT))::BIGINT AS q, min(l_returnflag) AS f
           FROM lineitem GROUP BY l_orderkey, l_linenumber)
SELECT l_orderkey, l_linenumber, 'line ' || l_linenumber || ' | ' || n || ' | ' || q || ' | ' || CASE f WHEN 'N' THEN '-' ELSE f END || chr(10) AS line FROM l"""
)
def linearise_order(spark, sf_dir):
    """PRJ-3 over rows: an order's lines as table text, repeated line numbers merged first."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("bigint")).alias("q"), F.min("l_returnflag").alias("f")
    )
    cells = F.array(
        text_of("line ", F.col("l_linenumber")), F.col("n").cast("string"), F.col("q").cast("string"), F.when(F.col("f") == "N", F.lit("")).otherwise(F.col("f"))
    )
    return table_lines(lines, ["l_orderkey"], "l_linenumber", cells)


YEARS = tuple(range(1995, 2002))


def _year_tables(spark, sf_dir):
    """Each customer's orders by year as a markdown table; at most one line per calendar year."""
    by_year = (
        table(spark, sf_dir, "orders")
        .groupBy("o_custkey", F.year("o_orderdate").alias("y"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum(cents("o_totalprice")).alias("v"))
    )
    line = text_of("| ", F.col("y"), " | ", F.col("n"), " | ", F.format_number("v", 0), " |\n")
    body = F.array_sort(F.collect_list(F.struct("y", line.alias("line"))))
    head = "| Year | Order Count | Net Value |\n|---|---|---|\n"
    return by_year.groupBy("o_custkey").agg(body.alias("b")).select(
        F.col("o_custkey").alias("table_id"),
        text_of(head, F.array_join(F.transform("b", lambda s: s["line"]), "")).alias("text"),
    )


_BY_YEAR_SQL = """WITH y AS (SELECT o_custkey, year(o_orderdate)::BIGINT AS y, count(*) AS n, sum(CAST(round(o_totalprice * 100) AS BIGINT))::BIGINT AS v
FROM orders GROUP BY 1, 2)
"""


@query(
    _BY_YEAR_SQL
    + """SELECT o_custkey AS table_id, y::VARCHAR AS row_key, 'Year' AS column, y::VARCHAR AS value FROM y
UNION ALL SELECT o_custkey, y::VARCHAR, 'Order_Count', n::VARCHAR FROM y
UNION ALL SELECT o_custkey, y::VARCHAR, 'Net_Value', format('{:,}', v) FROM y"""
)
def markdown_long(spark, sf_dir):
    """TAB-1: the year tables read back cell by cell."""
    return parse_markdown_table(_year_tables(spark, sf_dir)).select("table_id", "row_key", "column", "value")


@query(_BY_YEAR_SQL + "SELECT o_custkey AS table_id, y AS year, n AS order_count, v AS net_value FROM y")
def year_rows(spark, sf_dir):
    """TAB-3: the year tables as whole numbers, one row per year."""
    return to_year_rows(parse_markdown_table(_year_tables(spark, sf_dir)), ["order_count", "net_value"])


@query(
    _BY_YEAR_SQL
    + """SELECT o_custkey AS table_id, unnest(['cells', 'rows']) AS held_as FROM y
WHERE y BETWEEN 1996 AND 2000 GROUP BY o_custkey HAVING count(DISTINCT y) = 5"""
)
def complete_series(spark, sf_dir):
    """FLT-4: tables with every year from 1996 to 2000, judged over cell rows and again within each row."""
    years = F.array(*map(F.lit, YEARS[1:6]))
    tables = _year_tables(spark, sf_dir)
    over_rows = complete_tables(parse_markdown_table(tables), ["order_count", "net_value"], years)
    # the same tables as column -> year -> cell; a line is "| year | count | value |"
    every = F.split("text", "\n")
    lines = F.transform(F.slice(every, F.lit(3), F.size(every)), lambda line: F.split(line, r" \| |\| | \|"))
    filled = F.filter(lines, lambda c: F.size(c) > 3)
    column = F.map_from_entries(F.transform(filled, lambda c: F.struct(F.get(c, F.lit(1)), F.get(c, F.lit(2)))))
    within = tables.filter(has_complete_series(F.create_map(F.lit("order_count"), column), F.array(F.lit("order_count")), years))
    return over_rows.select("table_id", F.lit("rows").alias("held_as")).unionAll(within.select("table_id", F.lit("cells").alias("held_as")))


@query(
    """
SELECT o_orderkey, o_custkey, o_orderstatus, cents FROM (
  SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE CAST(round(o_totalprice * 100) AS BIGINT)::VARCHAR END AS cents,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) WHERE r = 1"""
)
def dedup_first(spark, sf_dir):
    """SET-1, WIN-1: shards merged, the first order of each customer kept."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", cents("o_totalprice").cast("string").alias("cents"))
    final = orders.filter(F.col("o_orderstatus") == "F").drop("cents")
    rest = orders.filter(F.col("o_orderstatus") != "F")
    return dedup_keep_first(union_shards(rest, final), ["o_custkey"], ["o_orderkey"])


@query("SELECT doc_id, lang, source FROM documents ORDER BY md5('sample:' || doc_id), doc_id LIMIT 100", name="sample_n")
def sample_documents(spark, sf_dir):
    """SMP-1: a hundred documents, the same ones every time."""
    return sample_n(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), 100, "doc_id")


@query("SELECT doc_id, lang, md5('shuffle:' || doc_id) AS drawn FROM documents", name="shuffle")
def shuffle_documents(spark, sf_dir):
    """SMP-2: all documents in a repeatable random order."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return shuffle_rows(documents, "doc_id").withColumn("drawn", draw_key("doc_id", "shuffle"))


_DRAW = "('0x' || substr(md5('{seed}:' || {key}), 1, 8))::BIGINT"


def _draw_sql(seed: str, key: str, low: int, high: int) -> str:
    return f"({low} + {_DRAW.format(seed=seed, key=key)} % {high - low + 1})"


@query(
    f"""
WITH f AS (SELECT p_partkey, range AS attempt, p_partkey || ':' || range AS k, CASE WHEN p_brand < p_type THEN p_brand || ' ' || p_type ELSE p_type || ' ' || p_brand END AS variables
           FROM part, range(5)),
d AS (SELECT *, {_draw_sql('years-a', 'k', 2010, 2022)} AS a, {_draw_sql('years-b', 'k', 2010, 2022)} AS b, {_draw_sql('years-span', 'k', 1, 4)} AS span FROM f),
e AS (SELECT *, least(CASE WHEN a = b THEN a - 1 ELSE a END, b) AS lo, greatest(CASE WHEN a = b THEN a - 1 ELSE a END, b) AS hi FROM d)
SELECT p_partkey, attempt::INTEGER AS attempt, variables, array_to_string(generate_series(lo, CASE WHEN hi - lo > 4 THEN lo + span ELSE hi END), ' ') AS years FROM e"""
)
def formula_grid(spark, sf_dir):
    """JON-3, AGG-11, SMP-3: every formula tried five times over drawn years."""
    variables = F.array(text_of(F.col("p_type"), "*n"), F.col("p_brand"), text_of(F.col("p_type"), "*n-1"))
    formulas = table(spark, sf_dir, "part").select("p_partkey", distinct_variables(variables).alias("v"))
    grid = replicate_formulas(formulas, 5)
    years = sample_years(text_of(F.col("p_partkey"), ":", F.col("attempt")), 2010, 2022)
    return grid.select("p_partkey", "attempt", F.array_join("v", " ").alias("variables"), F.array_join(years, " ").alias("years"))


@query(
    _BY_YEAR_SQL
    + """, t AS (SELECT o_custkey, string_agg('| ' || y || ' | ' || n || ' | ' || format('{:,}', v) || ' |' || chr(10), '' ORDER BY y) AS b FROM y GROUP BY o_custkey),
w AS (SELECT *, '| Year | Order Count | Net Value |' || chr(10) || '|---|---|---|' || chr(10) || b AS tab FROM t)
SELECT o_custkey AS sample_id, 'table' AS part, tab AS table, 'Customer ' || o_custkey || ' grew. ' AS text FROM w
UNION ALL SELECT o_custkey, 'text', 'other ' || o_custkey, 'Sold ' || o_custkey || ' units. ' FROM w"""
)
def table_pairs(spark, sf_dir):
    """TAB-2, TAB-4, TAB-5, TAB-6: generated output cut into its table and text, then paired."""
    key = F.col("table_id").cast("string")
    asked = table_prompt(F.array(F.lit("order_count"), F.lit("net_value")), F.lit(1995), F.lit(2001))
    shot = F.lit("Table:\n| a |\n|---|\n| 1 |\nEnd Table\n")
    output = F.concat(shot, asked, F.col("text"), F.lit("\nEnd Table\nand more"))
    samples = _year_tables(spark, sf_dir).select(
        F.col("table_id").alias("sample_id"),
        extract_table_block(output).alias("table"),
        trim_generated_text(text_of("Text:\nold\nText:\nCustomer ", key, " grew. Note: made up")).alias("table_text"),
        F.lit(None).cast("string").alias("table_value"),
        text_of("other ", key).alias("text_table"),
        trim_generated_text(text_of("Text:\nSold ", key, " units. ")).alias("text"),
        F.lit(None).cast("string").alias("text_value"),
    )
    return pair_table_text(samples).select("sample_id", "part", "table", "text")



def _distractors_sql() -> str:
    from ledgermark.functions.draws import STATEMENT_ITEMS

    items = "[" + ", ".join(f"'{i}'" for i in STATEMENT_ITEMS) + "]"
    return f"""
WITH c AS (SELECT c_custkey, unnest({items}) AS item FROM customer),
r AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY md5('distractors:' || c_custkey || ':' || item)) AS r,
      {_draw_sql('distractors-n', 'c_custkey', 2, 3)} AS n FROM c)
SELECT c_custkey, string_agg(item, ', ' ORDER BY r) AS items FROM r WHERE r <= n GROUP BY c_custkey"""


@query(_distractors_sql())
def distractor_columns(spark, sf_dir):
    """SMP-4: two or three unrelated columns drawn for every customer."""
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(sample_distractors("c_custkey"), ", ").alias("items"))


@query(
    """
SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, '{"id":' || event_id || ',"k":' || json_extract_string(props, '$.k') || '}' AS again,
  true AS valid, false AS broken FROM events"""
)
def json_props(spark, sf_dir):
    """JSN-1: payloads to fields, back to text, and told from text that is not JSON."""
    fields = payload_fields("props", "k bigint")
    return table(spark, sf_dir, "events").select(
        "event_id",
        fields["k"].alias("k"),
        payload_text(F.struct(F.col("event_id").alias("id"), fields["k"].alias("k"))).alias("again"),
        valid_payload("props").alias("valid"),
        valid_payload(F.concat(F.lit("{"), "props")).alias("broken"),
    )


@query(
    """
SELECT o_orderkey::VARCHAR AS id, o_custkey, o_orderstatus = 'O' AS is_correct, o_orderstatus <> 'O' AS to_review, o_orderpriority AS pred_scale FROM orders"""
)
def io_roundtrip(spark, sf_dir):
    """SRC-2, SNK-1..4: orders written split, resumed by id, and read back."""
    root = shared_dir(spark, "roundtrip")
    schema = "id string, o_custkey bigint, pred_scale string"
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("id"),
        "o_custkey",
        F.when(F.col("o_orderstatus") == "O", F.lit(True)).when(F.col("o_orderstatus") == "F", F.lit(False)).alias("is_correct"),
        F.col("o_orderpriority").alias("pred_scale"),
    )
    # first run: the urgent orders; the second takes the rest, known by their absence
    write_scored_split(orders.filter(F.col("pred_scale") == "1-URGENT"), f"{root}/a/first")
    done = read_jsonl_tree(spark, f"{root}/a", schema)
    left = without_done(orders, done, ["id"])
    write_scored_split(left, f"{root}/a/second")
    write_errors(orders, f"{root}/errors")
    write_predictions(orders, f"{root}/predictions", key="id", payload=("o_custkey", "pred_scale"))
    write_json(orders, f"{root}/all")
    flagged = read_jsonl_tree(spark, f"{root}/a", schema).withColumn("is_correct", F.col("file_path").contains("is_correct=true"))
    merged = dedup_keep_first(flagged, ["id"], SHARD_ORDER).select("id", "is_correct", "pred_scale")
    # the other outputs, joined back by id
    review = spark.read.schema("id string").json(f"{root}/errors").select("id", F.lit(True).alias("_review"))
    payload = spark.read.schema("id string, o_custkey bigint").json(f"{root}/predictions")
    everything = spark.read.schema("id string").json(f"{root}/all")
    joined = everything.join(merged, "id", "left").join(payload, "id", "left").join(review, "id", "left")
    return joined.select("id", "o_custkey", "is_correct", F.coalesce("_review", F.lit(False)).alias("to_review"), "pred_scale")


@query("SELECT doc_id::VARCHAR AS id, n_chars, md5(text) AS text_md5 FROM documents")
def stream_ingest(spark, sf_dir):
    """STM-1: documents dropped in two overlapping lots, each taken in once, and a rerun with nothing new."""
    root = shared_dir(spark, "stream")
    schema = "id string, text string, n_chars bigint"
    drop = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), "text", "n_chars", "lang")

    def run() -> None:
        ingest_completions_stream(spark, f"{root}/in", f"{root}/out", f"{root}/check", schema, keys=("id",))

    drop.filter(F.col("lang") == "en").drop("lang").write.json(f"{root}/in/lot=1")
    run()
    drop.drop("lang").write.json(f"{root}/in/lot=2")
    run()
    run()
    return read_ingested(spark, f"{root}/out", schema).select("id", "n_chars", F.md5("text").alias("text_md5"))
