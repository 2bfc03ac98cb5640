import json

from pyspark.sql import functions as F

from ledgermark.functions.answers import number_answer
from ledgermark.operators.shards import dedup_keep_first
from ledgermark.plans.annotate import definition_step, render_prompts, vote_step
from ledgermark.plans.evaluate import check_predictions, conversation_submission, predict_from_outputs, scaled_submission
from ledgermark.schemas import COMPLETION, COMPLETION_CHOICES, EXAMPLE
from ledgermark.sources.readers import SHARD_ORDER, explode_choices, load_completions, read_json_array, read_jsonl_tree, resume_from
from ledgermark.sources.writers import write_errors, write_json, write_predictions, write_scored_split
from ledgermark.streaming.ingest import ingest_completions_stream, read_ingested


def write_lines(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in rows))


def test_json_array(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"id": "1", "x": 1}, {"id": "2"}], indent=4))
    assert sorted(map(tuple, read_json_array(spark, str(tmp_path / "a.json"), "id string, x int").collect()), key=str) == [("1", 1), ("2", None)]


def test_tree_in_line_order(spark, tmp_path):
    write_lines(tmp_path / "b" / "two.jsonl", [{"id": "x", "n": 3}, "not json", {"id": "y", "n": 4}])
    write_lines(tmp_path / "a.jsonl", [{"id": "x", "n": 1}, {"id": "x", "n": 2}, ""])
    rows = read_jsonl_tree(spark, str(tmp_path), "id string, n int")
    assert [r["n"] for r in rows.filter("id is not null").orderBy(*SHARD_ORDER).collect()] == [1, 2, 3, 4]
    assert [r[0] for r in rows.filter("_corrupt_record is not null").select("_corrupt_record").collect()] == ["not json"]
    first = dedup_keep_first(rows.filter("id is not null"), ["id"], SHARD_ORDER)
    assert {r["id"]: r["n"] for r in first.collect()} == {"x": 1, "y": 4}
    assert read_jsonl_tree(spark, str(tmp_path / "nowhere"), "id string, n int").count() == 0


def test_order_survives_splitting_a_file(spark, tmp_path):
    write_lines(tmp_path / "big.jsonl", [{"id": f"k{i % 7}", "n": i} for i in range(20_000)])
    limit = spark.conf.get("spark.sql.files.maxPartitionBytes")
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        rows = read_jsonl_tree(spark, str(tmp_path), "id string, n int")
        assert rows.select("block_start").distinct().count() > 5
        assert [r["n"] for r in rows.orderBy(*SHARD_ORDER).collect()] == list(range(20_000))
        assert {r["id"]: r["n"] for r in dedup_keep_first(rows, ["id"], SHARD_ORDER).collect()} == {f"k{i}": i for i in range(7)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", limit)
        spark.conf.set("spark.sql.files.openCostInBytes", cost)


def test_completions(spark, tmp_path):
    chat = {"id": "a", "choices": [{"message": {"role": "assistant", "content": "ans = 1"}}, {"text": "ans = 2", "logprobs": {"token_logprobs": [-0.5, -1.0]}}]}
    write_lines(tmp_path / "r.jsonl", [chat])
    got = load_completions(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == [("a", 0, "ans = 1", None), ("a", 1, "ans = 2", [-0.5, -1.0])]
    empty = spark.createDataFrame([], COMPLETION_CHOICES)
    assert explode_choices(empty).count() == 0
    assert resume_from(spark.range(10).withColumnRenamed("id", "pos"), 7).count() == 3


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("a", True, ["x"], ""), ("b", False, None, None), ("c", None, ["y"], "million")], "uid string, is_correct boolean, pred array<string>, pred_scale string")
    assert write_json(df, str(tmp_path / "all")) and spark.read.json(str(tmp_path / "all")).count() == 3
    assert not write_json(df.select(F.raise_error(F.lit("no")).alias("x")), str(tmp_path / "bad"))
    write_scored_split(df, str(tmp_path / "split"))
    assert spark.read.json(str(tmp_path / "split")).count() == 3
    assert [r["uid"] for r in spark.read.json(str(tmp_path / "split" / "is_correct=true")).collect()] == ["a"]
    write_errors(df, str(tmp_path / "errors"))
    assert sorted(r["uid"] for r in spark.read.json(str(tmp_path / "errors")).collect()) == ["b", "c"]
    write_predictions(df, str(tmp_path / "pred"))
    assert set(spark.read.json(str(tmp_path / "pred")).columns) == {"uid", "pred", "pred_scale"}


def test_stream_equals_batch(spark, tmp_path):
    schema = "id string, sample_idx int, text string"
    dirs = [str(tmp_path / d) for d in ("in", "out", "check")]

    def run():
        ingest_completions_stream(spark, *dirs, schema)

    write_lines(tmp_path / "in" / "1.jsonl", [{"id": "a", "sample_idx": 0, "text": "first"}, {"id": "a", "sample_idx": 0, "text": "again"}, {"id": "a", "sample_idx": 1, "text": "x"}])
    run()
    write_lines(tmp_path / "in" / "2.jsonl", [{"id": "a", "sample_idx": 1, "text": "late"}, {"id": "b", "sample_idx": 0, "text": "y"}])
    run()
    stored = read_ingested(spark, dirs[1], schema)
    want = [("a", 0, "first"), ("a", 1, "x"), ("b", 0, "y")]
    assert sorted(map(tuple, stored.drop("batch_id").collect())) == want
    before = stored.count()
    run()
    assert read_ingested(spark, dirs[1], schema).count() == before
    batch = dedup_keep_first(read_jsonl_tree(spark, dirs[0], schema), ["id", "sample_idx"], SHARD_ORDER).select("id", "sample_idx", "text")
    assert sorted(map(tuple, batch.collect())) == want


def examples(spark):
    rows = [
        {"id": "e1", "question": "q", "text": "t", "table": "a | b\n", "answer": 2.5, "program": "ans = 5 / 2", "gold": {}},
        {"id": "e2", "question": "q", "text": "", "table": "a | b\n", "answer": "yes", "program": "ans = 7 > 3", "gold": {}},
        {"id": "e3", "question": "q", "text": "", "table": "a | b\n", "answer": 4, "program": "ans = 1 + 3", "gold": {}},
    ]
    return spark.createDataFrame([(json.dumps(r),) for r in rows], "j string").select(F.from_json("j", EXAMPLE).alias("e")).select("e.*")


def completions(spark, rows):
    return spark.createDataFrame([(i, n, t, None) for i, n, t in rows], COMPLETION)


def test_annotation_in_two_steps(spark):
    first = completions(spark, [("e1", 0, "```python\nsales = 5\nyears = 2\n```"), ("e2", 0, "a = 9\n"), ("e1", 1, "ignored = 1")])
    step1 = definition_step(examples(spark), first)
    got = {r["id"]: (r["generated"][0], r["is_correct"]) for r in step1.collect()}
    assert got == {"e1": ("sales = 5\nyears = 2\n", True), "e2": ("a = 9\n", False), "e3": ("", False)}
    prompt = render_prompts(step1, "calculation").filter("id = 'e1'").first()["prompt"]
    assert prompt.endswith("#Python\nsales = 5\nyears = 2\n")
    second = completions(
        spark,
        [("e1", 0, "ans = sales / years"), ("e1", 1, "ans = 1"), ("e1", 2, "ans = sales / 2"), ("e2", 0, "ans = a > 3"), ("e2", 1, "import os"), ("e1", 3, "ans = nothing")],
    )
    result = vote_step(step1.drop("is_correct"), second)
    done = {r["id"]: r for r in result.collect()}
    assert [done[k]["is_correct"] for k in ("e1", "e2", "e3")] == [True, True, False]
    assert done["e1"]["generated"] == ["sales = 5\nyears = 2\n\nans = sales / 2"]
    assert done["e2"]["executed"]["text"] == "yes" and done["e3"]["executed"] is None


def test_model_evaluation(spark):
    outputs = completions(spark, [("a", 0, "p #Python:\nans = 5 / 2!\n\nmore"), ("a", 1, "p #Python:\nans = 2.5"), ("b", 0, "p #Python:\nans = 3 > 4"), ("c", 0, "p #Python:\nans = 'x'")]).select("id", "sample_idx", "text")
    predicted = predict_from_outputs(outputs)
    shown = {r["id"]: (r["prediction"], r["predicted"][0], r["predicted"][1]) for r in conversation_submission(predicted).collect()}
    assert shown == {"a": ("2.5", "add(", "2.5"), "b": ("no", "greater(", "0"), "c": (None, "add(", "None")}
    gold = spark.createDataFrame([("a", 2.5), ("b", 1.0), ("c", 1.0), ("d", 1.0)], "id string, answer double")
    assert {r["id"]: r["is_correct"] for r in check_predictions(gold, predicted).collect()} == {"a": True, "b": False, "c": False, "d": False}
    tagged = gold.withColumn("answer", number_answer(F.col("answer") * 100))
    assert {r["id"]: r["is_correct"] for r in check_predictions(tagged, predicted, True).collect()}["a"]


def test_scaled_submission(spark):
    outputs = completions(spark, [("a", 0, "p#Python\nans = [1.5, 'b, c']\nunits = 'million'"), ("b", 0, "p#Python\nans = '5 million'\nunits = 'million'\n\n"), ("c", 0, "p#Python\nans = 1 / 0"), ("d", 0, "p#Python\nans = []\nunits = 'none'")]).select("id", "sample_idx", "text")
    got = {r["uid"]: (r["pred"], r["pred_scale"]) for r in scaled_submission(outputs).collect()}
    assert got == {"a": (["1.5", "b, c"], "million"), "b": (["5 million"], ""), "c": ([""], ""), "d": ([""], "")}


def test_definitions_do_not_pin_the_vote_to_the_join(spark):
    """A hot example's samples may be split at the join only if the vote shuffles after it."""
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        ready = examples(spark).withColumn("generated", F.array(F.lit("a = 1")))
        plan = vote_step(ready, completions(spark, [("e1", 0, "ans = a")]))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    # leaves last: the shuffle of the first vote stands above the Python step, which stands above the join
    python = plan.index("ArrowEvalPython")
    assert "hashpartitioning(_key" in plan[:python] and "SortMergeJoin" in plan[python:]
    assert "Exchange" not in plan[python : plan.index("SortMergeJoin", python)]
