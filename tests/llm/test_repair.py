"""Operator 12 against a search of all edits, and the piecewise form against the whole one."""

from __future__ import annotations

import hashlib
import itertools
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from ledgermark.llm import repair
from ledgermark.llm.repair_query import ORACLES, op12_lightest_repair

SCHEMA = "conv_id bigint, turn bigint, role string, text string, live boolean"
GRAMMAR = re.compile(r"(s?(ua)+)?")


def judged(rows):
    """initial, must go, cut short, and the counts, straight from the definitions."""
    seen, out, counts = set(), [], [0, 0, 0]
    for role, text in rows:
        solid = text.strip(" \t\n\x0b\x0c\r")
        fault = 0 if not solid else 1 if (role, text) in seen else 2 if solid[-1] not in ".!?" else None
        seen.add((role, text))
        if fault is not None:
            counts[fault] += 1
        out.append((role[:1], fault in (0, 1), fault == 2))
    return out, counts


def cheapest(rows):
    """All edits of each row, with up to two insertions before each row and at the end."""
    slots = []
    inserted = [("I" * n, 5 * n, "".join(w)) for n in range(3) for w in itertools.product("ua", repeat=n)]
    for initial, must_go, short in rows:
        rest = 5 if short else 0
        own = [] if must_go else [("K", rest, initial), ("R", 1 + rest, "u"), ("R", 1 + rest, "a")]
        slots += [inserted, [("D", 2, ""), *own]]
    picks = itertools.product(*slots, inserted)
    return min((sum(e[1] for e in p), "".join(e[0] for e in p)) for p in picks if GRAMMAR.fullmatch("".join(e[2] for e in p)))


@pytest.mark.parametrize("seed", range(40))
def test_lightest_of_all_edits(seed):
    r = random.Random(seed)
    rows = [(r.choice("suaauux"), r.random() < 0.2, r.random() < 0.3) for _ in range(r.randint(0, 3))]
    assert repair.repair(rows) == cheapest(rows)


def conversations(seed, count=60, longest=40):
    r = random.Random(seed)
    stock = ["Yes.", "No!", "why", "", " \n", "So be it?", "and then", None, "é漢.", "...", "x.\t"]
    rows = []
    for conv in range(count):
        for turn in range(r.randint(1, longest)):
            role = r.choice(["user", "assistant"] * 5 + ["system", "tool", "", None, "usher"])
            text = r.choice(stock) if r.random() < 0.3 else f"text {r.random()}" + r.choice([".", "!", "", "?"])
            rows.append((conv or None, None if r.random() < 0.03 else turn + (r.random() < 0.1), role, text, r.random() > 0.05))
    return rows


def expected(rows):
    """Each conversation by itself, one row after the other."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = [(t is not None, t or 0, " " if role is None else role, " " if text is None else text) for c, t, role, text, live in rows if c == conv and live]
        own.sort()
        cases, (blank, duplicate, truncated) = judged([(r[2], r[3]) for r in own])
        turns = {r[1] for r in own if r[0]}
        cost, audit = repair.repair(cases)
        lines, state, at = [], repair.START, 0
        for letter in audit:
            text = "" if letter == "I" else own[at][3]
            role = next(v for k, v in repair.ROLES.items() if k in repair.MOVES[state]) if letter in "IR" else own[at][2]
            if letter != "D":
                state = repair.MOVES[state][role[:1]]
                lines.append(f"{role}:{text}")
            at += letter != "I"
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(cases, cases[1:]))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, blank, duplicate, truncated, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def found(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


@pytest.mark.parametrize("limits", [{}, {"most_rows": 3, "piece": 4}, {"most_rows": 0, "piece": 1}, {"most_bytes": 200, "piece": 7}])
def test_whole_and_in_pieces(spark, limits):
    """Turns that tie are told apart by role and text; here no text is repeated in a turn, so both orders agree."""
    rows = [r for r in conversations(1)]
    rows = list({(r[0], r[1]): r for r in rows}.values())
    rows += [(900 + k, None, "user", "Yes.", True) for k in range(3)] + [(950, 1, "user", "gone.", False)] + [(951, 1, "user", "same.", True)] * 9
    got = found(repair.repaired(spark.createDataFrame(rows, SCHEMA), **limits))
    assert got == expected(rows)


def test_long_conversation_in_pieces(spark):
    """A conversation with most of the rows; ties of cost decided by audits across pieces."""
    r = random.Random(4)
    rows = [(1, k, r.choice(["user", "assistant"]), f"{k}" + r.choice([".", "."]), True) for k in range(3000)]
    rows += [(2, k, "user", f"{k}.", True) for k in range(20)]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert found(repair.repaired(frame, most_rows=10, piece=64)) == expected(rows)


def test_empty_and_clashing(spark):
    assert repair.repaired(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = list({(r[0], r[1]): r for r in conversations(2, 10)}.values())
    frame = spark.createDataFrame(rows, SCHEMA)
    for name in "fate piece place digest initial blank short first n bytes audit edits".split():
        frame = frame.withColumn(name, F.lit("other"))
    assert found(repair.repaired(frame)) == expected(rows)


def test_query_on_awkward_table(spark, tmp_path):
    rows = [r[:4] for r in {(r[0], r[1]): r for r in conversations(3, 200, 6)}.values()]
    rows += [(5000, 1, "user", "Twice."), (5000, 1, "user", "Twice."), (5001, None, None, None)]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    cursor = db.execute(ORACLES["op12_lightest_repair"])
    names = [d[0] for d in cursor.description]
    want = {r[0]: r[1:] for r in cursor.fetchall()}
    assert found(op12_lightest_repair(spark, str(tmp_path)).select(names)) == want
