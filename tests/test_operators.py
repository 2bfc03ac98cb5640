import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgermark.functions.answers import ANSWER, flag_answer, number_answer, text_answer
from ledgermark.functions.draws import STATEMENT_ITEMS, draw_key, sample_distractors, sample_years
from ledgermark.functions.prompts import conversation_prompt
from ledgermark.operators.conversations import turn_prompts, whole_prompts
from ledgermark.operators.examples import normalise_examples, split_rejects, unpivot_qa
from ledgermark.operators.joins import distinct_variables, join_completions, replicate_formulas, without_done
from ledgermark.operators.metrics import accuracy, running_accuracy, weighted_mean
from ledgermark.operators.shards import dedup_keep_first, sample_n, shuffle_rows, union_shards
from ledgermark.operators.tables import complete_tables, has_complete_series, pair_table_text, parse_markdown_table, table_lines, to_year_rows, whole_tables
from ledgermark.operators.votes import majority_vote, rank_by_logprob, sort_by_logprob, vote_pair
from ledgermark.plans.annotate import vote_step
from ledgermark.schemas import RAW_RECORD


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def python_vote(samples):
    """The rule: count, first seen wins a tie, last code of the winner."""
    counts, code = Counter(), {}
    for value, text in samples:
        if value is not None:
            counts.update([value])
            code[value] = text
    if not counts:
        return None, ""
    winner = counts.most_common(1)[0][0]
    return winner, code[winner]


@pytest.mark.parametrize("seed", [1, 2])
def test_vote_any_layout(spark, seed):
    rng = random.Random(seed)
    rows, want = [], {}
    sizes = {0: 4000} | {i: rng.randint(1, 7) for i in range(1, 400)}  # example 0 holds most of the rows
    for key, size in sizes.items():
        values = [rng.choice([None, 1.0, 2.0, 3.0, -0.0, 0.0]) for _ in range(size)]
        want[key] = python_vote([(v, f"c{i}") for i, v in enumerate(values)])
        rows += [(key, i, v, f"c{i}") for i, v in enumerate(values)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "id int, sample_idx int, answer double, code string")
    for parts in (1, 7):
        got = {r["id"]: (r["prediction"] and r["prediction"]["num"], r["code"]) for r in majority_vote(df.repartition(parts)).collect()}
        assert got == want


def test_vote_mixed_kinds(spark):
    kinds = [flag_answer(F.lit(True)), number_answer(F.lit(1.0)), text_answer(F.lit("x")), number_answer(F.lit(float("nan"))), F.lit(None).cast(ANSWER)]

    def samples(*picks):
        one = spark.range(1)
        parts = [one.select(F.lit(0).alias("id"), F.lit(i).alias("sample_idx"), kinds[p].alias("answer"), F.lit(f"c{i}").alias("code")) for i, p in enumerate(picks)]
        return majority_vote(union_shards(*parts)).first()

    assert samples(0, 1, 2)["prediction"]["text"] == "True"  # a flag and its number are one answer
    assert samples(1, 0, 2)["prediction"]["text"] == "1.0"
    assert samples(1, 0, 2)["code"] == "c1"
    assert samples(3, 3, 2)["prediction"]["text"] == "nan" and samples(3, 3, 2)["votes"] == 1  # no two NaN are equal
    assert samples(2, 3, 2)["prediction"]["text"] == "x"
    assert samples(4, 4)["prediction"] is None and samples(4, 4)["code"] == ""


def test_vote_pair(spark):
    rows = [
        (0, 0, True, "a", None), (0, 1, True, "b", "million"), (0, 2, True, "b", None), (0, 3, False, "b", "x"),
        (1, 0, False, None, None), (2, 0, True, None, "percent"), (2, 1, True, None, None),
    ]
    df = spark.createDataFrame(rows, "id int, sample_idx int, ok boolean, answer_text string, unit string")
    assert sorted(vote_pair(df).collect()) == [(0, "b", ""), (1, "", ""), (2, "", "percent")]


def test_rank_by_logprob(spark):
    df = spark.createDataFrame([(0, i, [-float(i % 3), -1.0]) for i in range(9)], "id int, sample_idx int, token_logprobs array<double>")
    ordered = sort_by_logprob(df.repartition(3))
    assert "Window" not in plan_of(ordered)
    assert [r["sample_idx"] for r in ordered.collect()] == [0, 3, 6, 1, 4, 7, 2, 5, 8]
    top = rank_by_logprob(df, top=2)
    assert "WindowGroupLimit" in plan_of(top)  # limited before the shuffle
    assert top.count() == 2


def test_keep_first_over_shuffled_shards(spark):
    rng = random.Random(5)
    rows = [(rng.choice([0, 0, 0, rng.randint(1, 50)]), f"f{rng.randint(0, 3)}", n, n * 2) for n in range(3000)]
    want = {}
    for row in sorted(rows, key=lambda r: (r[1], r[2])):
        want.setdefault(row[0], row)
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "id int, file string, line int, payload int").repartition(5)
    got = dedup_keep_first(df, ["id"], ["file", "line"])
    assert sorted(map(tuple, got.collect())) == sorted(want.values())
    assert got.columns == df.columns


@pytest.mark.parametrize("block", [3, 10, 100_000])
def test_running_accuracy(spark, block):
    rng = random.Random(block)
    rows = [(run, pos, rng.choice([True, False, None])) for run in "ab" for pos in rng.sample(range(500), 200)]
    want, seen = {}, {}
    for run, pos, hit in sorted(rows, key=lambda r: (r[0], r[1])):
        right, n = seen.get(run, (0, 0))
        seen[run] = (right + bool(hit), n + 1)
        want[run, pos] = seen[run]
    df = spark.createDataFrame(rows, "run string, pos long, is_correct boolean")
    got = {(r["run"], r["pos"]): (r["correct_so_far"], r["seen_so_far"]) for r in running_accuracy(df, "pos", by=["run"], block=block).collect()}
    assert got == want


def test_running_accuracy_without_groups(spark):
    df = spark.range(100).select(F.col("id").alias("pos"), (F.col("id") % 2 == 0).alias("is_correct"))
    last = running_accuracy(df, "pos", block=7).orderBy(F.desc("pos")).first()
    assert (last["correct_so_far"], last["seen_so_far"], last["accuracy_so_far"]) == (50, 100, 0.5)


def test_accuracy_and_mean(spark):
    df = spark.createDataFrame([("a", True, 1, 2, 0), ("a", None, 2, 1, 1), ("b", False, 5, 1, 2)], "g string, is_correct boolean, v int, w int, pos int")
    assert sorted(accuracy(df, by=["g"]).collect()) == [("a", 1, 2, 0.5), ("b", 0, 1, 0.0)]
    assert accuracy(df.limit(0)).first() == (0, 0, 0.0)
    assert sorted(weighted_mean(df, "v", "w", "pos", ["g"]).collect()) == [("a", 4, 3, pytest.approx(4 / 3), 2), ("b", 5, 1, 5.0, 5)]


@pytest.mark.parametrize("n", [0, 1, 40, 499, 500, 900])
def test_sample_is_the_smallest_digests(spark, n):
    df = spark.range(500).withColumn("x", F.col("id") * 2)
    want = {r["id"] for r in df.orderBy(draw_key("id", "s"), "id").limit(n).collect()}
    got = sample_n(df.repartition(3), n, "id", "s")
    assert {r["id"] for r in got.collect()} == want and got.count() == len(want)
    assert got.columns == ["id", "x"]


def test_shuffle_repeats(spark):
    df = spark.range(200)
    order = [r["id"] for r in shuffle_rows(df.repartition(3), "id").collect()]
    assert order == [r["id"] for r in shuffle_rows(df.repartition(5), "id").collect()]
    assert sorted(order) == list(range(200)) and order != sorted(order)
    assert order != [r["id"] for r in shuffle_rows(df, "id", "other").collect()]


def test_draws(spark):
    rows = spark.range(400).select(sample_years("id", 2010, 2022).alias("y"), sample_distractors("id").alias("d")).collect()
    for years, items in rows:
        assert years == list(range(years[0], years[-1] + 1)) and 2 <= len(years) <= 5 and 2009 <= years[0] and years[-1] <= 2022
        assert len(items) in (2, 3) and len(set(items)) == len(items) and set(items) <= set(STATEMENT_ITEMS)
    assert len({len(y) for y, _ in rows}) == 4 and len({tuple(d) for _, d in rows}) > 300


def test_joins(spark):
    many = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").alias("row"))
    few = spark.sql("SELECT * FROM VALUES (0L, 'a'), (1L, 'b'), (5L, 'c') AS t(k, v)")
    assert without_done(many, few, ["k"]).count() == 333
    assert join_completions(few.withColumnRenamed("k", "id"), many.withColumnRenamed("k", "id")).count() == 334 + 333 + 1
    grid = replicate_formulas(few.select("k"), 5)
    assert "Join" not in plan_of(grid) and grid.count() == 15
    got = spark.range(1).select(distinct_variables(F.array(*map(F.lit, ("b*n", "a", "b*n-1", "b"))))).first()[0]
    assert got == ["a", "b"]


RECORDS = [
    '{"id": "r1", "table": [["", "2019"], ["cash", "5"], []], "qa": {"question": "q", "exe_ans": 0.94, "program": "subtract(5829, 5735), divide(#0, const_100)", "gold_inds": {"text_1": "one ", "table_2": "no", "text_0": "two"}}, "qa_1": {"question": "q1", "exe_ans": "yes", "program": "greater(2, 1)", "gold_inds": {"text_9": "own"}}}',
    '{"id": "r2", "table": [["a"]], "qa_0": {"question": "q", "exe_ans": 1, "program": "root(2, 1)", "gold_inds": {}}, "qa_1": {"question": "q", "exe_ans": 1, "program": "add(2, 1)", "gold_inds": {}}}',
    '{"id": "r3", "table": [["a"]], "qa": {"question": "q", "exe_ans": 1, "program": "add(2, 1)"}}',
]


def test_examples(spark):
    raw = spark.createDataFrame([(r,) for r in RECORDS], "j string").select(F.from_json("j", RAW_RECORD).alias("r")).select("r.*")
    assert [(r["id"], r["variant"]) for r in unpivot_qa(raw).orderBy("id", "pos").collect()] == [("r1", "qa"), ("r1", "qa_1"), ("r2", "qa_0"), ("r2", "qa_1"), ("r3", "qa")]
    valid, rejects = split_rejects(normalise_examples(raw))
    rows = valid.orderBy("id", "pos").collect()
    assert [(r["id"], r["text"], r["program"]) for r in rows] == [
        ("r1", "one two", "x0 = 5829 - 5735; ans = x0 / 100"), ("r1", "own", "ans = 2 > 1"), ("r2", "", "ans = 2 + 1"),
    ]
    assert rows[0]["table"] == "- | 2019\ncash | 5\n"
    assert sorted((r["id"], r["reason"]) for r in rejects.collect()) == [("r2", "unknown operation"), ("r3", "no gold passages")]
    _, strict = split_rejects(normalise_examples(raw, strict_compat=True))
    assert ("r2", "follows an unusable question") in {(r["id"], r["reason"]) for r in strict.collect()}


MARKDOWN = "| Year | Net Income | Tax |\n|---|---|---|\n| 2010 | 5 | 1,200 |\n\n| 2011 | 7 |\n| 2010 | 6 |\n"


def test_markdown(spark):
    df = spark.createDataFrame([(1, MARKDOWN)], "table_id int, text string")
    long = parse_markdown_table(df)
    cells = {(r["column"], r["row_key"]): r["value"] for r in long.collect()}
    assert cells == {("Year", "2010"): "2010", ("Net_Income", "2010"): "6", ("Tax", "2010"): "1,200", ("Year", "2011"): "2011", ("Net_Income", "2011"): "7"}
    assert parse_markdown_table(df, keep_last=False).count() == 7
    assert sorted(map(tuple, to_year_rows(long, ["net_income", "tax"]).collect())) == [(1, 2010, 6, 1200), (1, 2011, 7, None)]
    years = F.array(F.lit(2010), F.lit(2011))
    assert complete_tables(long, ["net_income"], years).count() == 1
    assert complete_tables(long, ["net_income", "tax"], years).count() == 0
    held = F.create_map(F.lit("tax"), F.create_map(F.lit("2010"), F.lit("5"), F.lit("2011"), F.lit("x")))
    row = spark.range(1).select(
        has_complete_series(held, F.array(F.lit("tax")), F.array(F.lit(2010))),
        has_complete_series(held, F.array(F.lit("tax")), years),
        has_complete_series(held, F.array(F.lit("cash")), years),
    ).first()
    assert tuple(row) == (True, False, False)


def test_pairs(spark):
    df = spark.createDataFrame([(1, "T", "tt", "tv", "ot", "x", "xv")], "sample_id int, table string, table_text string, table_value string, text_table string, text string, text_value string")
    assert sorted(map(tuple, pair_table_text(df).collect())) == [(1, "table", "T", "tt", "tv"), (1, "text", "ot", "x", "xv")]


def test_lines_of_a_long_table(spark):
    rows = spark.range(1000).select(F.lit("big").alias("k"), F.col("id").alias("pos")).unionAll(spark.range(3).select(F.lit("small"), F.col("id")))
    lines = table_lines(rows.repartition(4), ["k"], "pos", F.array(F.col("pos").cast("string"), F.lit("")))
    assert "Exchange hashpartitioning" not in plan_of(lines) and lines.count() == 1003
    whole = {r["k"]: r["line"] for r in whole_tables(lines, ["k"], "pos", 1000).collect()}
    assert whole == {"big": "".join(f"{i} | -\n" for i in range(1000)), "small": "0 | -\n1 | -\n2 | -\n"}
    with pytest.raises(Exception, match="more than 999 rows"):
        whole_tables(lines, ["k"], "pos", 999).collect()


def test_turn_prompts_equal_the_whole_prompt(spark):
    turns = [(0, t) for t in range(130)] + [(1, 5)] + [(2, t) for t in range(65)] + [(3, 10), (3, 70), (3, 200), (3, 70)]
    df = spark.createDataFrame([(c, t, f"q{t}") for c, t in turns], "conv_id int, turn int, text string")
    whole = df.distinct().groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("t")).select(
        "conv_id", conversation_prompt(F.lit(""), F.lit(""), F.transform("t", lambda t: F.concat(F.lit("q"), t.cast("string")))).alias("p")
    )
    want = {r["conv_id"]: r["p"] for r in whole.collect()}
    pieces = turn_prompts(df.repartition(4))
    assert {r["conv_id"]: r["prompt"] for r in whole_prompts(pieces, 130).collect()} == want
    assert pieces.filter("is_first").count() == pieces.filter("is_last").count() == 4


def test_two_texts_under_one_turn_both_stay(spark):
    df = spark.createDataFrame([(1, 0, "first"), (1, 1, "b"), (1, 1, "a"), (1, 1, "a"), (2, 3, "y"), (2, 3, "x")], "conv_id int, turn int, text string")
    got = {r["conv_id"]: r["prompt"] for r in whole_prompts(turn_prompts(df), 10).collect()}
    prompt = lambda *q: spark.range(1).select(conversation_prompt(F.lit(""), F.lit(""), F.array(*map(F.lit, q)))).first()[0]
    assert got == {1: prompt("first", "a", "b"), 2: prompt("x", "y")}


def test_year_rows_do_not_depend_on_the_layout(spark):
    text = "| Year | Tax | tax |\n|---|---|---|\n| 2010 | 1 | 2 |\n| 2011 | 3 | x |\n| 02010 | 7 |\n"
    df = spark.createDataFrame([(1, text)], "table_id int, text string")
    for n in range(1, 9):
        got = to_year_rows(parse_markdown_table(df).repartition(n), ["tax"]).collect()
        assert sorted(map(tuple, got)) == [(1, 2010, 7), (1, 2011, 3)]
    plan = parse_markdown_table(df)._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.split("\n") if "Generate" in line and "text#" in line]


def test_votes_beyond_thirteen_bits_of_place(spark):
    rows = spark.range(20_000).select(F.lit("x").alias("id"), F.col("id").alias("sample_idx"), F.when(F.col("id") % 2 == 0, 4.0).otherwise(7.0).alias("answer"), F.col("id").cast("string").alias("code"))
    row = majority_vote(rows.repartition(5)).first()
    assert (row["prediction"]["num"], row["votes"], row["code"]) == (4.0, 10_000, "19998")
    far = rows.withColumn("sample_idx", F.lit(str(10**26)).cast("decimal(27,0)") + F.col("sample_idx"))
    assert majority_vote(far).first()["code"] == "19998"
    bare = majority_vote(rows, code_col=None)
    assert "SortAggregate" not in plan_of(bare) and bare.first()["prediction"]["num"] == 4.0
    with pytest.raises(Exception, match="out of range"):
        majority_vote(rows.withColumn("sample_idx", -F.col("sample_idx") - 1)).collect()


def test_sample_sizes_and_repeated_keys(spark):
    df = spark.range(3000).select((F.col("id") % 1500).alias("id"), F.col("id").alias("row"))
    order = [r["id"] for r in df.select("id", draw_key("id", "sample").alias("d")).orderBy("d").collect()]
    for n in (0, 1, 2, 999, 1000, 1001, 1500, 2999, 3000, 4000):
        got = sample_n(df.repartition(6), n, "id")
        assert Counter(r["id"] for r in got.collect()) == Counter(order[:n])
        assert "Window" not in plan_of(got)


def python_table(text):
    """Cells by row and column name, the later one standing."""
    lines = text.strip(" \t\n\x0b\f\r").split("\n")
    cells = lambda line: [c.strip(" \t\n\x0b\f\r") for c in line.strip("|").split("|")]
    names, found = [h.replace(" ", "_") for h in cells(lines[0])], {}
    for at, line in enumerate(lines[2:]):
        if line:
            row = cells(line)
            for k, value in enumerate(row[: len(names)]):
                found[row[0], names[k]] = (value, at, k)
    return found


def test_last_cells_of_any_table(spark):
    """Rows named twice, short and long lines, headers that repeat; texts of one id apart."""
    rng = random.Random(8)
    texts = []
    for _ in range(300):
        width = rng.randint(1, 5)
        line = lambda first, n: "| " + " | ".join([first, *(rng.choice(["1", "x y", "", " 2"]) for _ in range(n - 1))]) + rng.choice([" |", "", "||"])
        head = "| " + " | ".join(rng.choice(["a", "b", "net tax", "c", "d"]) for _ in range(width)) + " |"
        body = [rng.choice(["", line(rng.choice(["r", "s", "t u"]), rng.randint(1, width + 2))]) if rng.random() < 0.9 else "" for _ in range(rng.randint(0, 9))]
        texts.append("\n".join(["  " + head, "|---|", *body, " "]))
    df = spark.createDataFrame([(k // 2, t) for k, t in enumerate(texts)] + [(-1, None), (-2, "")], "table_id int, text string")
    long = parse_markdown_table(df)
    got = Counter((r["table_id"], r["row_key"], r["column"], r["value"], r["row_pos"], r["col_pos"]) for r in long.collect())
    want = Counter((k // 2, *key, *cell) for k, t in enumerate(texts) for key, cell in python_table(t).items())
    assert got == want
    plan = plan_of(long)
    assert plan.count("Scan ") == 1 and "Exchange" not in plan and "Join" not in plan and plan.count("Generate explode") == 2


def test_a_long_table_is_read_once(spark):
    text = "| Year | Tax |\n|---|---|\n" + "".join(f"| {k % 4000} | {k} |\n" for k in range(16_000))
    got = {r["row_key"]: r["value"] for r in parse_markdown_table(spark.createDataFrame([(1, text)], "table_id int, text string")).filter("column = 'Tax'").collect()}
    assert got == {str(k % 4000): str(k) for k in range(16_000)}


def test_examples_of_one_split_are_compared_by_many_tasks(spark):
    """Examples in a file of one split, joined by broadcast, used to be compared with their winners in one task."""
    examples = spark.range(0, 2_000, 1, 1).select(F.col("id").cast("string").alias("id"), F.try_parse_json(F.col("id").cast("string")).alias("answer"))
    samples = spark.range(0, 40, 1, 1).select(F.col("id").cast("string").alias("id"), F.lit(0).alias("sample_idx"), F.concat(F.lit("ans = "), "id").alias("text"))
    rows = vote_step(examples, samples).select("is_correct", F.spark_partition_id().alias("task")).collect()
    assert len(rows) == 2_000 and sum(bool(r.is_correct) for r in rows) == 40
    assert len({r.task for r in rows}) >= 8
