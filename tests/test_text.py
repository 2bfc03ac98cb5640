import re
import string

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgermark.functions import text as X
from tests.test_numbers import column, texts


# The first four texts and their results here, and the first three in the next test, are published vectors.
def test_golden(spark):
    given_texts = ["-134.12", "134.12", "(134.12)", "18.3%", "The Cash, a  Flow", "$1.0", "007", "1e5", "12 a-b", ".5", "+3", "5\nmillion", "a\nthe"]
    want = ["-134.12", "134.12", "-134.12", "0.183", "cash flow", "1.0", "7", "5", "12 ab", ".5", "3", "5000000", ""]
    assert column(texts(spark, given_texts), X.normalise_answer("t")) == want


def test_ws_tokens(spark):
    given_texts = ["2.3   million", "2.3 \nmillion", "2.3\n\tmillion", "  ", "(Net) “income”. -- x_", "‘a’"]
    want = [["2.3", "million"], ["2.3", "million"], ["2.3", "million"], [], ["net", "“income”", "", "x"], ["a"]]
    assert column(texts(spark, given_texts), X.ws_tokens("t")) == want


FLOAT = re.compile(r"[+-]?(?:(?:\d+(?:_\d+)*\.?(?:\d+(?:_\d+)*)?|\.\d+(?:_\d+)*)(?:e[+-]?\d+(?:_\d+)*)?|inf(?:inity)?)$", re.A)
# Characters that the number rules leave aside.
NOISE = "'\"\\$€£¥%(),[]"


def expected(text):
    """Token by token, as the definition reads, for ASCII digits."""
    parts = []
    for token in text.lower().split(" "):
        cleaned = "".join(c for c in token if c not in NOISE)
        words = cleaned.split()
        scales = {"hundred": 100, "thousand": 1000, "million": 10**6, "billion": 10**9, "percent": 0.01}
        named = [f for w, f in scales.items() if len(words) > 1 and w in words[1]]
        numeric = bool(words) and FLOAT.match(words[0]) and (len(words) == 1 or named)
        found = re.findall(r"[+-]?\d+(?:\.\d+)?|[+-]?\.\d+", cleaned, re.A)
        if numeric and found and not re.match(r"[+-]?\.", found[-1]):
            value = float(found[-1]) if "." in found[-1] else int(found[-1])
            word = re.search(r"[\d.]+\s?([a-zA-Z]+)", token)
            for name, factor in scales.items():
                if word and name in word.group(1):
                    value *= factor
                    break
            value *= -1 if re.search(r"\([\d.\s]+\)", token) else 1
            value *= 0.01 if re.search(r"[\d.\s]%", token) else 1
            token = str(round(value, 4))
        elif not numeric:
            token = "".join(c for c in token if c not in string.punctuation)
        parts.append(" ".join(re.sub(r"\b(a|an|the)\b", " ", token).split()))
    return " ".join(p for p in parts if p.strip())


ALPHABET = st.sampled_from(list("aantheTHE  \n\t.,-+%()$19e5_é’x;") + ["inf", "-inf", "$inf", "infinity", " +Infinity ", " the ", " (1.5) ", "million", "12,000"])


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(ALPHABET, max_size=25).map("".join), min_size=200, max_size=400))
def test_normalise_matches_token_by_token(spark, values):
    got = column(texts(spark, values), X.normalise_answer("t"))
    for value, result in zip(values, got, strict=True):
        assert result == expected(value), repr(value)


def test_display_answer(spark):
    df = spark.createDataFrame(
        [
            (0, ["1234.1"], "million"), (1, ["b", "a"], "percent"), (2, ["22.12%"], "percent"), (3, ["$1.0 million"], ""),
            (4, ["34.125"], ""), (5, [".5"], "million"),
        ],
        "i int, a array<string>, s string",
    )
    assert column(df, X.display_answer("a", "s")) == ["1234100000.0000", "a percent b percent", "0.2212", "1000000.0000", "34.1200", ".5 million"]
    assert column(df.filter("i = 4"), X.percent_variants("a", "s")) == [["34.1200", "34.1250"]]


def test_small_functions(spark):
    df = texts(spark, ["The cat, an (1.5) hat"])
    assert column(df, X.remove_articles(F.lower("t"))) == ["  cat,   (1.5) hat"]
    assert column(df, X.remove_punctuation("t")) == ["The cat an 15 hat"]
    assert column(texts(spark, ["(1.5)"]), X.remove_punctuation("t")) == ["(1.5)"]
    assert column(df, X.split_blank("t")) == [["The", "cat,", "an", "(1.5)", "hat"]]
    assert column(texts(spark, [" a   b\n"]), X.fix_spaces("t")) == ["a b"]


def test_long_runs_stay_linear(spark):
    import time

    from ledgermark.functions.cleanup import remove_comments
    from ledgermark.functions.numbers import expand_scaled_words, is_number, to_number
    from ledgermark.functions.prompts import qa_prompt

    n = 200_000
    runs = ["1" * n + "x", "." * n + "x", "!" * n + "x", "a" + " " * n + "b", "1." * n + "x", "1_" * n, "(" * n + "1" * n, "a#" + "=" * n, "the " * n]
    start = time.monotonic()
    df = texts(spark, runs)
    cols = [X.normalise_answer("t"), F.size(X.ws_tokens("t")), is_number("t"), to_number("t"), expand_scaled_words("t"), remove_comments("t"), qa_prompt("t", "t", "t")]
    df.select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).write.format("noop").mode("overwrite").save()
    assert time.monotonic() - start < 60
