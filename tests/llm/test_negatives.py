"""Operator 11 against all pairs."""

from __future__ import annotations

import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from ledgermark.llm.negatives import Lists, hard_negatives, quantised
from ledgermark.llm.negatives_query import ORACLES, op11_hard_negatives

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def vectors(rows):
    """Rows that take part, as the operator says: id -> (label, whole numbers)."""
    sound = {}
    for vec_id, embedding, label in rows:
        if vec_id is None or label is None or embedding is None or any(x is None or not math.isfinite(x) for x in embedding):
            continue
        whole = [math.floor(256 * x) for x in embedding]
        if sum(x * x for x in whole) <= 1 << 61:
            sound[vec_id] = min(sound.get(vec_id, (label, whole)), (label, whole))
    return sound


def brute(rows, every=3, positives=5, negatives=10, low=30, high=90):
    held, out = vectors(rows), []
    for a, (label, vector) in held.items():
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(vector, v)), i, l) for i, (l, v) in held.items() if i != a)
        for s, p, _ in [r for r in scored if r[2] == label][:positives]:
            inside = [(n, -t) for t, n, l in scored if l != label and low * -s <= -100 * t <= high * -s]
            out += [(a, p, rank + 1, n, -s, t) for rank, (n, t) in enumerate(inside[:negatives])]
    return sorted(out)


def mined(spark, rows, every=3, **how):
    frame = spark.createDataFrame(rows, SCHEMA)
    return sorted(map(tuple, hard_negatives(quantised(frame), F.col("vec_id") % every == 0, **how).collect()))


def clouds(seed, count, width=6, labels=4):
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(width)] for _ in range(labels)]
    rows = []
    for i in range(count):
        label = r.randrange(labels)
        rows.append((i, [float(round(x + r.gauss(0, 0.7), 2)) for x in centres[(label + (r.random() < 0.2)) % labels]], label))
    return rows


def test_all_pairs(spark):
    rows = clouds(1, 150)
    found = mined(spark, rows)
    assert found == brute(rows) and len(found) > 500


def test_hot_label_copies_and_ties(spark):
    rows = clouds(2, 60) + [(1000 + i, [1.0, 0.5, -0.25, 0.0, 0.5, 1.0], 1) for i in range(60)]
    rows += [(2000 + i, [0.75, 0.5, -0.25, 0.0, 0.5, 0.5], 2) for i in range(40)]
    assert mined(spark, rows, positives=3, negatives=4) == brute(rows, positives=3, negatives=4)


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = clouds(3, 40) + [(None, [1.0] * 6, 1), (100, None, 1), (101, [1.0] * 6, None), (102, [1.0, None], 1), (103, [nan] * 6, 1), (104, [inf, 1.0], 2)]
    rows += [(105, [], 1), (105, [], 1), (106, [2.0], 0), (107, [0.0] * 6, 1), (108, [1.0] * 9, 2), (108, [3.0] * 9, 2), (111, [1e30] * 6, 1), (114, [-1e6, 1e6], 3), (117, [1e6, 1e6], 1)]
    assert mined(spark, rows) == brute(rows)


def test_exact_beyond_floats(spark):
    """Scores that single and double precision would round."""
    r = random.Random(5)
    rows = [(i, [float(r.randrange(-(1 << 20), 1 << 20)) for _ in range(4)], i % 3) for i in range(60)]
    assert mined(spark, rows) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(1, [1.0], 1)], [(3, [1.0], 1), (4, [1.0], 2)], [(0, None, None)]])
def test_nothing_to_find(spark, rows):
    assert mined(spark, rows) == []


def test_stops_early():
    """Where a few rows stand out, the threshold ends the search long before all rows are met."""
    import numpy as np

    r = np.random.default_rng(0)
    matrix = np.concatenate([r.normal(0, 1, (20_000, 4)).round(2), np.full((20, 4), 30.0)])
    lists = Lists(np.arange(len(matrix)), np.zeros(len(matrix), np.int64), matrix)
    anchor = np.array([1.0, 1.0, 1.0, 1.0])
    places, scores = lists.search(anchor, lambda p, s, t: len(s) >= 5 and t < np.sort(s)[-5])
    assert len(places) < 2_000 and sorted(scores)[-5:] == [120.0] * 5


def test_clashing_columns(spark):
    rows = clouds(6, 30)
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("block", F.lit("x")).withColumn("id", F.lit("y")).withColumn("score", F.lit(1)).withColumn("row", F.lit(2))
    assert sorted(map(tuple, hard_negatives(quantised(frame), F.col("vec_id") % 3 == 0).collect())) == brute(rows)


def test_query_on_awkward_table(spark, tmp_path):
    rows = [(i * 25, e, l) for i, e, l in clouds(7, 60)] + [(100, [0.5] * 6, 3), (None, [1.0] * 6, 1), (7, None, 2), (14, [float("nan")] * 6, 1)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = sorted(db.execute(ORACLES["op11_hard_negatives"]).fetchall())
    found = op11_hard_negatives(spark, str(tmp_path)).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    assert sorted(map(tuple, found.collect())) == want and want
