import json

import pytest
from pyspark.sql import functions as F

from ledgermark.functions import scoring as S
from ledgermark.operators.joins import join_predictions
from ledgermark.operators.metrics import count_pivot, evaluation_cells, metric_pivot, op_breakdown, overall_metrics, scale_breakdown
from ledgermark.operators.scoring import score_predictions
from ledgermark.plans.evaluate import evaluate_predictions, evaluation_reports, write_scored
from ledgermark.schemas import GOLD_DOCUMENT

PHRASE = "The fair value of options granted to directors during the year"

# type, gold, gold scale, prediction, predicted scale, EM, F1; worked out by hand
CASES = [
    ("span", ["net revenue fell, mainly abroad"], "", ["net revenue fell, mainly abroad"], "", 1, 1),
    ("span", ["815.4"], "million", ["815.4"], "thousand", 0, 0),
    ("span", ["815.4"], "million", ["815.4"], "million", 1, 1),
    ("multi-span", ["oslo", "lima", "cairo"], "", ["cairo", "oslo", "lima"], "", 1, 1),
    ("multi-span", ["oslo", "lima", "cairo"], "", ["lima", "oslo"], "", 0, 0.8),
    ("multi-span", ["$61,500", "$402.75"], "", ["402.75", "61,500"], "", 1, 1),
    # the scale is folded into the value
    ("arithmetic", 47.5, "million", ["47500000"], "", 1, 1),
    ("arithmetic", 47.5, "million", ["47.5"], "", 0, 0),
    # two decimals count, a third does not
    ("arithmetic", 47.53, "", ["47.5"], "", 0, 0),
    ("arithmetic", 47.5, "", ["47.504"], "", 1, 1),
    ("count", 8, "", ["8"], "", 1, 1),
    ("count", 8, "", ["about 8"], "7", 0, 0),
    # a share may stand for its percentage, once
    ("arithmetic", 36.4, "percent", ["0.364"], "", 1, 1),
    ("arithmetic", 36.4, "percent", ["0.36411"], "percent", 0, 0),
    ("arithmetic", ["58.25"], "percent", ["0.5825"], "", 1, 1),
    ("span", [36.4], "percent", ["36.4%"], "", 1, 1),
    ("span", [36.4], "percent", ["-36.4"], "", 0, 0),
    ("span", [36.4], "", ["$36.4"], "", 1, 1),
    ("arithmetic", 36.4, "million", ["3", "4"], "", 0, 0),
    # a printed list reads as its text
    ("span", ["$2.5 million"], "", ["['$2.5 million']"], "", 1, 1),
    # 5 of 9 words: precision 1, recall 5/9
    ("span", [PHRASE], "", ["fair value of options granted"], "", 0, 0.71),
]


@pytest.fixture(scope="module")
def golden(spark):
    questions = [
        {"uid": str(i), "answer_type": t, "answer_from": "table" if i % 2 else "text", "scale": s, "answer": g}
        for i, (t, g, s, *_) in enumerate(CASES)
    ]
    text = json.dumps({"questions": questions})
    documents = spark.createDataFrame([(text,)], "j string").select(F.from_json("j", GOLD_DOCUMENT).alias("d")).select("d.*")
    predictions = spark.createDataFrame([(str(i), p, ps) for i, (_, _, _, p, ps, _, _) in enumerate(CASES)], "uid string, pred array<string>, pred_scale string")
    return documents, predictions


def test_hand_worked_cases(golden):
    scored = {r["uid"]: r for r in evaluate_predictions(*golden)["scored"].collect()}
    assert len(scored) == len(CASES)
    for i, (*row, em, f1) in enumerate(CASES):
        got = scored[str(i)]
        assert got["f1"] == f1, row
        assert em is None or got["em"] == em, row


def test_missing_prediction_counts(golden):
    documents, predictions = golden
    reports = evaluate_predictions(documents, predictions.filter("uid < '2'"))
    total = reports["overall"].first()
    assert total["total"] == len(CASES)
    assert 0 < total["em"] < 1
    assert [len(v.split(".")[1]) for v in reports["percent"].first()] == [2, 2, 2]


def scored_rows(spark):
    return spark.createDataFrame(
        [
            ("span", "table", "", "", 1.0, 1.0, True, "Sum", "Sum"),
            ("span", "table", "million", "", 0.0, 0.5, False, "Sum", "Count"),
            ("count", "text", "percent", None, 0.0, 0.0, False, None, "ignore"),
        ],
        "answer_type string, answer_from string, scale string, pred_scale string, em double, f1 double, scale_em boolean, pred_op string, gold_op string",
    )


def test_reports(spark):
    scored = scored_rows(spark)
    assert metric_pivot(scored, "f1").orderBy("answer_type").collect() == [("count", 0.0, 0.0, 0.0), ("span", 0.75, 0.0, 0.0)]
    assert count_pivot(scored).orderBy("answer_type").collect() == [("count", 0, 1, 0), ("span", 2, 0, 0)]
    by_scale = {r["scale"]: tuple(r)[1:] for r in scale_breakdown(scored).collect()}
    assert by_scale == {"": (1, 1, 1.0), "million": (0, 1, 0.0), "percent": (0, 1, 0.0), "thousand": (0, 0, 0.0), "billion": (0, 0, 0.0)}
    by_op = {r["gold_op"]: tuple(r)[1:] for r in op_breakdown(scored, True).collect()}
    assert by_op["Sum"] == (1, 1, 1.0) and by_op["Count"] == (0, 1, 0.0) and by_op["ignore"] == (0, 0, 0.0) and len(by_op) == 11
    assert overall_metrics(scored.filter("false")).first() == (0.0, 0.0, 0.0, 0.0, 0)
    assert overall_metrics(scored).first()["op_em"] == pytest.approx(1 / 3)


def test_zero_prediction(spark):
    df = spark.createDataFrame(
        [("count", "", ["0"], ["0"], ""), ("span", "", ["x"], None, None), ("span", "", ["x"], [""], ""), ("span", "", [], ["x"], "")],
        "answer_type string, scale string, answer array<string>, pred array<string>, pred_scale string",
    )
    assert [r["em"] for r in score_predictions(df).collect()] == [1, 0, 0, 0]
    assert [r["em"] for r in score_predictions(df, strict_compat=True).collect()] == [0, 0, 0, 0]


def test_span_metrics(spark):
    df = spark.createDataFrame(
        [("span", "", ["x"], ["x"], "", ["a b"], ["a b c"])],
        "answer_type string, scale string, answer array<string>, pred array<string>, pred_scale string, pred_span array<string>, gold_span array<string>",
    )
    # 'a' is an article, so one token of two is shared
    row = score_predictions(df).first()
    assert (row["span_em"], row["span_f1"]) == (0.0, 0.67)


def test_pieces(spark):
    df = spark.range(1).select(
        F.array(F.lit("x"), F.lit("y")).alias("a"), F.array(F.lit("y"), F.lit("x")).alias("b"), F.array(F.lit("y")).alias("c"),
        F.array().cast("array<string>").alias("none"),
    )

    def one(col):
        return df.select(col).first()[0]

    assert one(S.bag_overlap("a", "c")) == 1
    assert one(S.same_span_set("a", "b")) and not one(S.same_span_set("a", "c"))
    assert one(S.bag_f1("none", "a")) == 0.0 and one(S.bag_f1("none", "none")) == 1.0
    assert one(S.aligned_f1("a", "c")) == one(S.bag_f1("a", "c")) == pytest.approx(2 / 3)
    assert one(S.em_f1(F.lit("The Net gain"), F.lit("net gain.")))[:] == (1.0, 1.0)
    assert one(S.em_f1(F.lit("net gain"), F.lit("gain")))[:] == (0.0, 0.67)
    assert one(S.numbers_agree("a", "c")) and not one(S.numbers_agree(F.array(F.lit("5")), "c"))
    assert one(S.best_over_pairs("none", "a"))[:] == (0.0, 0.0)


def test_prediction_listed_twice(spark):
    gold = spark.createDataFrame([("u",), ("v",)], "uid string")
    pred = spark.createDataFrame([("u", "old", 1), ("u", "new", 2), ("w", "x", 3)], "uid string, pred string, pos int")
    assert sorted(join_predictions(gold, pred, pos="pos").collect(), key=str) == [("u", "new"), ("v", None)]


def test_reports_from_one_pass(spark, tmp_path):
    """What the grouping sets give is what each report gives by itself."""
    scored = scored_rows(spark).unionByName(scored_rows(spark).withColumn("answer_type", F.lit("span")).withColumn("em", F.lit(None).cast("double")))
    for rows in (scored, scored.filter("false"), scored.drop("pred_op", "gold_op")):
        reports = evaluation_reports(evaluation_cells(rows), "pred_op" in rows.columns)
        own = {"overall": overall_metrics(rows), "em_by_type": metric_pivot(rows, "em"), "f1_by_type": metric_pivot(rows, "f1"), "count_by_type": count_pivot(rows), "by_scale": scale_breakdown(rows)}
        if "pred_op" in rows.columns:
            own["by_op"] = op_breakdown(rows)
        for name, df in own.items():
            assert sorted(map(tuple, reports[name].select(df.columns).collect())) == sorted(map(tuple, df.collect())), name
        listed = reports["listed"].collect()
        assert {r.report for r in listed} >= {"overall", "by_scale"} and ("by_op" in {r.report for r in listed}) == ("by_op" in own)
    totals = write_scored(scored, str(tmp_path / "scored"))
    assert totals["total"] == 6 == spark.read.json(str(tmp_path / "scored")).count() and totals["f1"] == pytest.approx(0.5)


def test_all_reports_score_once(golden):
    from tests.test_operators import plan_of  # noqa: PLC0415

    plan = plan_of(evaluate_predictions(*golden)["listed"])
    assert plan.count("Join") == 1 and "ReusedExchange" not in plan


def test_rows_of_one_split_are_scored_by_many_tasks(spark):
    """A file of one split, joined by broadcast, used to be scored in one task."""
    gold = spark.range(0, 4_000, 1, 1).select(F.col("id").alias("uid"), F.lit("span").alias("answer_type"), F.lit("").alias("scale"), F.array(F.lit("a b")).alias("answer"))
    pred = spark.range(0, 4_000, 2, 1).select(F.col("id").alias("uid"), F.array(F.lit("a c")).alias("pred"), F.lit("").alias("pred_scale"))
    scored = score_predictions(gold.join(F.broadcast(pred), "uid", "left"))
    sizes = [r["count"] for r in scored.groupBy(F.spark_partition_id().alias("task")).count().collect()]
    assert sum(sizes) == 4_000 and len(sizes) >= 8 and max(sizes) <= 600
