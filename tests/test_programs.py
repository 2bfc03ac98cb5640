import pytest
from pyspark.sql import functions as F

from ledgermark.functions import answers as A
from ledgermark.functions import cleanup as C
from ledgermark.functions import programs as P
from tests.test_numbers import column, texts


def test_infix(spark):
    given = [
        "subtract(5829, 5735), divide(#0, const_100)", "table_sum(net sales, none)", "add(const_m1, CONST_2)",
        "exp(2, 3), greater(#0, 5)", "what(1, 2)", "", "add(1, 2), add(3",
    ]
    want = [
        "x0 = 5829 - 5735; ans = x0 / 100", "ans = sum(net sales)", "ans = -1 + 2", "x0 = 2 ^ 3; ans = x0 > 5", None, "", "ans = 1 + 2",
    ]
    assert column(texts(spark, given), P.program_to_infix("t")) == want
    assert column(texts(spark, given[:1]), P.program_tokens("t")) == [
        ["subtract(", "5829", "5735", ")", "divide(", "#0", "const_100", ")"]
    ]
    assert column(texts(spark, ["#3", "const_m5", "CONST_2", "m4"]), P.program_arg("t")) == ["x3", "-5", "2", "m4"]


def test_evaluate_program(spark):
    df = texts(
        spark,
        ["subtract(5829, 5735), divide(#0, const_100)", "divide(1, 0)", "exp(2, const_3)", "greater(2, 1)", "add(x, 1)", "table_sum(a, none)",
         "table_average(b, none), add(#0, const_m1)", "table_max(c, none)", "add(#4, 1)", ""],
    ).withColumn("tab", F.expr("array(array('', '2019', '2018'), array('a', '$ 1,000', '5'), array('b', '2', '4 ( 4 )'), array('c', 'x', '1'))"))
    got = column(df, P.evaluate_program("t", "tab")["text"])
    assert got == ["0.94", None, "8.0", "True", None, "1005.0", "2.0", None, None, None]


CODE = {
    "a = 5\nb = 2\nans = a / b": 2.5,
    "x = [1, 2, 3]\nans = sum(x) / len(x)": 2.0,
    "ans = 2 ** 3 - -1": 9,
    "ans = (3 > 2)": True,
    "a = 1\na += 4\nans = round(a / 3, 2)": 1.67,
    "x = [4, 5]\nans = x[-1]": 5,
    "ans = 'yes'": "yes",
    "a = float('2.5')\nprint(a)\na\nans = int(a) + a": 4.5,
    "ans = [1.5, 'b']": [1.5, "b"],
}
REFUSED = [
    "import os\nans = 1", "ans = __import__('os')", "ans = (1).__class__", "ans = 9 ** 9 ** 9", "ans = 1 / 0", "ans = [0] * 10",
    "ans = (lambda: 1)()", "ans = missing", "ans = 1 +", "while True: pass", "ans = open('x')", "ans = 1\nprint(missing)", "ans = 1\nprint(open('x'))", "ans = 'a' * 5", "a = 1\nans = a\nb = 1 / 0",
    "ans = (-8) ** 0.5", "ans = round(5, -10 ** 9)", "a = [1]\nb = [a, a]\nans = b",
]


def test_run_assignments(spark):
    df = texts(spark, [*CODE, *REFUSED, None, "b = 1"])
    got = [r[0] for r in df.orderBy("i").select(P.run_assignments("t")).collect()]
    for row, value in zip(got, CODE.values(), strict=False):
        assert row["ok"] and row["ans"]["text"] == str(value)
    assert not any(r["ok"] for r in got[len(CODE) : len(CODE) + len(REFUSED) + 1])
    assert got[-1]["ok"] and got[-1]["ans"] is None


def test_budget_and_reasons(spark):
    codes = ["ans = 1 # " + "x" * 60_000, "ans = 10 ** 5000", "import os", "ans = 9 ** 9 ** 9", "ans = 1 / 0", None]
    got = [r[0] for r in texts(spark, codes).orderBy("i").select(P.run_assignments("t")).collect()]
    assert [r["ok"] for r in got] == [True, True, False, False, False, False]
    assert got[0]["ans"]["num"] == 1 and got[1]["ans"]["text"] == "1" + "0" * 5000
    assert [r["reason"] for r in got] == [None, None, "refused: Import", "refused: over budget", "failed: ZeroDivisionError", "no program"]
    small = texts(spark, ["ans = 2 + 3 * 4", "ans = 2"]).orderBy("i").select(P.run_assignments("t", budget=2)).collect()
    assert [r[0]["ok"] for r in small] == [False, True]


def test_only_the_code_column_reaches_python(spark):
    plan = texts(spark, ["ans = 1"]).withColumn("other", F.lit("x")).select("i", "other", P.run_assignments("t"))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in text


@pytest.fixture(scope="module")
def tagged(spark):
    js = ["14", "14.0", '"14"', "true", '"yes"', "null", '[3, "x"]', "[]", '["q"]', "0", '"12d"', '" 1_000 "', '"nan"', "0.285"]
    return texts(spark, js).select("i", A.answer_from_variant(F.try_parse_json("t")).alias("v"))


def test_answer_kinds(tagged):
    kinds = column(tagged, F.col("v.kind"))
    assert kinds == ["int", "float", "text", "bool", "text", None, "list", "list", "list", "int", "text", "text", "text", "float"]


def test_coerce(tagged):
    got = [(r[0] and (r[0]["kind"], r[0]["text"])) for r in tagged.orderBy("i").select(A.coerce_answer("v")).collect()]
    assert got == [
        ("float", "14.0"), ("float", "14.0"), ("float", "14.0"), ("bool", "True"), ("text", "yes"), None, ("float", "3.0"), None,
        ("text", "q"), ("float", "0.0"), ("text", "12d"), ("float", "1000.0"), ("float", "nan"), ("float", "0.285"),
    ]


def test_simplify_and_label(tagged):
    assert column(tagged, A.simplify_answer("v"))[:10] == ["14", "14.0", "14", "True", "yes", None, '[3,"x"]', None, "q", None]
    assert column(tagged, A.simplify_answer("v", False)["kind"])[8] == "text"
    assert column(tagged, A.answer_to_label("v")["text"])[:6] == ["14", "14.0", None, "yes", None, None]
    assert column(tagged, A.label_reject_reason("v"))[4:6] == ["answer is text", "no answer"]
    assert column(tagged, A.simplify_number(F.col("v.num")))[-1] == "0.28"


def test_prediction_to_program(tagged):
    got = column(tagged, A.prediction_to_program(A.answer_to_label("v")))
    assert got[1] == ["add(", "14.0", "0", ")", "EOF"]
    assert got[3] == ["greater(", "1", "0", ")", "EOF"]
    assert got[5] == ["add(", "None", "0", ")", "EOF"]


def test_matches_display(spark):
    rows = [("$ 14.5", 14.46), ("25.0%", 0.25), ("14", 14.2), ("14", 15.0), ("yes", None)]
    df = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(rows)], "i int, t string, x double")
    value = F.coalesce(A.number_answer("x"), A.text_answer(F.lit("yes")))
    assert column(df, A.answer_matches_display("t", value)) == [True, True, True, False, True]


def test_finalise(spark):
    df = spark.createDataFrame(
        [(0, "5", None, "million"), (1, "5 million", None, "million"), (2, None, [], "percent"), (3, None, ["a", "b"], "none")],
        "i int, t string, l array<string>, s string",
    )
    assert [tuple(r[0]) for r in df.orderBy("i").select(A.finalise_scaled("t", "l", "s")).collect()] == [
        (["5"], "million"), (["5 million"], ""), ([""], "percent"), (["a", "b"], ""),
    ]


def test_fences_and_markers(spark):
    df = texts(spark, ["```python\nx = 1 & 2!\n```", "p #Python:\na #Python:\nb = 1\n\nrest", "no mark"])
    assert column(df, C.strip_fences("t"))[0] == "x = 1 & 2!\n"
    assert column(df, C.sanitise_code("t", True))[0] == "```python\nx = 1 _ 2\n```"
    assert column(df, C.sanitise_code("t"))[0] == "```python\nx = 1 _ 2!\n```"
    assert column(df, C.after_marker("t", "#Python:\n"))[1:] == ["b = 1", "no mark"]
    assert column(df, C.after_marker("t", "#Python:\n", 2))[1:] == ["a ", None]


def test_definitions(spark):
    df = texts(spark, ["a = 5\nb = 7 = 8\nprint(a)\nc = 9", "none", "x=1"])
    got = [tuple(r[0]) for r in df.orderBy("i").select(C.definition_prefix("t")).collect()]
    assert got == [("a = 5\nb = 7 = 8\n", ["5", "7"]), ("", []), ("x=1\n", ["1"])]
    values = F.array(F.lit("5"))
    program = F.lit("ans = 75 / 3")
    one = df.limit(1)
    assert column(one, C.definitions_consistent(values, program)) == [True]
    assert column(one, C.definitions_consistent(values, program, True)) == [False]
    assert column(one, C.definitions_consistent(F.array().cast("array<string>"), program)) == [True]


def test_code_text(spark):
    df = texts(spark, ["a = 1  # one\n\n    b =  2\n#c\nd", "x\n    y\nz\n    w"])
    assert column(df, C.remove_comments("t")) == ["a = 1\n    b = 2\nd", "x\n    y\nz\n    w"]
    assert column(df, C.remove_comments("t", False)) == ["a = 1 \n b = 2\nd", "x\n y\nz\n w"]
    assert column(df, C.indented_body("t", "def solver():\n"))[1] == "def solver():\nx\n    y\nans = solver()"
    assert column(df.limit(1), C.prepend_definitions(F.lit("a = 1"), F.lit("b = a"))) == ["a = 1\nb = a"]
