"""Programs run by shape against the same programs run one by one."""

from __future__ import annotations

import random
import sys

import pyarrow as pa
import pytest

from ledgermark.functions import assignments as A

NAMES = ["a", "b", "c", "ans", "x1"]
LITERALS = ["0", "1", "2", "3", "7", "10", "19", "64", "100", "1.5", "0.0", "2.", ".5", "1e3", "1E-2", "1e400", "9007199254740993", "4611686018427387905", "99999999999999999999", "007", "1_0", "0x1f", "2.5e10"]
SAME_KIND = {k: [t for t in LITERALS if any(c in t for c in ".eE") == k and t.isascii() and t not in ("007", "1_0", "0x1f")] for k in (True, False)}


def expression(r: random.Random, depth: int) -> str:
    if depth == 0 or r.random() < 0.25:
        return r.choice(LITERALS) if r.random() < 0.5 else r.choice(NAMES)
    sub = lambda: expression(r, depth - 1)
    return r.choice(
        [
            lambda: f"({sub()} {r.choice(['+', '-', '*', '/', '//', '%'])} {sub()})",
            lambda: f"{sub()} ** {r.choice(['2', '0.5', '3', 'b', '-1'])}",
            lambda: f"{r.choice(['-', '+', 'not '])}{sub()}",
            lambda: f"({sub()} {r.choice(['>', '<', '>=', '<=', '==', '!='])} {sub()})",
            lambda: f"{r.choice(['sum', 'min', 'max', 'len'])}([{sub()}, {sub()}])",
            lambda: f"{r.choice(['max', 'min'])}({sub()}, {sub()})",
            lambda: f"round({sub()}, {r.choice(['2', '0', '1', '25', '-1', '1.0'])})",
            lambda: f"{r.choice(['abs', 'int', 'float', 'round', 'sum', 'len'])}({sub()})",
            lambda: f"[{sub()}, {sub()}, {sub()}][{r.choice(['0', '1', '-1', '2', '5', 'a'])}]",
            lambda: f"[{sub()}, {sub()}]",
            lambda: f"sum([{sub()}], {sub()})",
            lambda: f"{sub()}({sub()})",
        ]
    )()


def program(r: random.Random) -> str:
    lines = [f"{n} = {r.choice(LITERALS)}" for n in NAMES[: r.randint(1, 4)]]
    for _ in range(r.randint(1, 4)):
        lines.append(f"{r.choice(NAMES)} {r.choice(['=', '=', '=', '+=', '*=', '/='])} {expression(r, 3)}")
    lines += r.choice([[], ["print(ans)"], ["# 5 things é"], ["import os"], ["5 = a"], ["f(5=3)"], ["a.b"], ["s = 'a 5'"], ["\\"], ["é = 4 + 漢"]])
    r.shuffle(lines) if r.random() < 0.1 else None
    return "\n".join(lines)


def renumbered(r: random.Random, source: str) -> str:
    """The same shape with other numbers of the same kind."""
    return A._NUMBER.sub(lambda m: r.choice(SAME_KIND[any(c in m.group() for c in ".eE")]) if r.random() < 0.5 else m.group(), source)


@pytest.fixture(autouse=True)
def long_integers():
    held = sys.get_int_max_str_digits()
    sys.set_int_max_str_digits(0)
    yield
    sys.set_int_max_str_digits(held)


@pytest.mark.filterwarnings("ignore::SyntaxWarning")
@pytest.mark.parametrize("seed", range(20))
def test_both_ways_agree(seed):
    r = random.Random(seed)
    shapes = [program(r) for _ in range(25)]
    sources = [renumbered(r, s) for s in shapes for _ in range(12)] + shapes
    r.shuffle(sources)
    for budget in (A.BUDGET, 40, 12):
        together = A.evaluate_batch(pa.array(sources), tuple(NAMES), budget).to_pylist()
        apart = A._one_by_one(sources, tuple(NAMES), budget).to_pylist()
        for source, got, want in zip(sources, together, apart, strict=True):
            assert repr(got) == repr(want), source


def test_a_shape_is_parsed_once(monkeypatch):
    parsed = []
    parse = A.ast.parse
    monkeypatch.setattr(A.ast, "parse", lambda source: parsed.append(source) or parse(source))
    sources = [f"a = {k}\nb = {k}.5\nans = round((a + b) * 100 / {k + 1}, 2)" for k in range(1_000)]
    results = A.evaluate_batch(pa.array(sources), ("ans",)).to_pylist()
    assert len(parsed) == 1
    assert results[10]["ans"]["num"] == round((10 + 10.5) * 100 / 11, 2)


def test_rows_apart_from_their_shape():
    """A division by zero and numbers beyond 62 bits leave the others in their columns."""
    sources = [f"a = {v}\nans = a * a / (a - 3)" for v in [1, 2, 3, 4, 10**30, 5 * 10**17, 7, 8, 9, 10, 11]]
    results = A.evaluate_batch(pa.array(sources), ("ans",)).to_pylist()
    assert results[2]["reason"] == "failed: ZeroDivisionError"
    assert results[4]["ans"]["num"] == 10**60 / (10**30 - 3) and results[5]["ans"]["num"] == (25 * 10**34) / (5 * 10**17 - 3)


def test_batch_of_answers():
    sources = [f"ans = {k} > 3\nunit = [{k}, {k}.5]" for k in range(20)] + [None, "ans ="]
    rows = A.evaluate_batch(pa.array(sources), ("ans", "unit")).to_pylist()
    assert rows[4]["ans"] == {"kind": "bool", "num": 1.0, "text": "True", "flag": True, "items": None}
    assert rows[7]["unit"] == {"kind": "list", "num": 7.0, "text": "[7, 7.5]", "flag": None, "items": ["7", "7.5"]}
    assert rows[20]["reason"] == "no program" and rows[21]["reason"] == "failed: SyntaxError"
