"""Operator 13 against plain patterns and a plain graph."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from ledgermark.llm import pii
from ledgermark.llm.pii_query import digests
from tests.llm.samples import SCHEMA, awkward, clashing, frame

PLAIN = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]


def luhn(digits: str) -> bool:
    doubled = [int(d) * (1 + k % 2) for k, d in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def passes(kind: int, value: str) -> bool:
    digits = re.sub("[^0-9]", "", value)
    return [
        True,
        kind == 1 and all(int(p) <= 255 for p in value.split(".")),
        12 <= len(digits) <= 19 and luhn(digits),
        9 <= len(digits) <= 15,
    ][kind]


def base(text: str | None) -> list[tuple[int, int, int]]:
    return sorted(
        (m.start(), kind, m.end()) for kind, p in enumerate(PLAIN) for m in re.finditer(p, text or "") if passes(kind, m.group())
    )


def items(text: str):
    """start, stop, kind, value, patterns of each item."""
    ws = r"\x20\x09-\x0D"
    item = re.compile(rf"(?<![^{ws}])(?:{PLAIN[3]}|{PLAIN[2]}(?![^{ws}])|[^{ws}0-9]*[0-9][^{ws}]*)")
    found = list(item.finditer(text))
    words = lambda s: [w for w in re.split(f"[{ws}]+", s.lower()) if w]
    for k, m in enumerate(found):
        value = m.group()
        lead = 0
        while not (value[lead].isalnum() or value[lead] == "+"):
            lead += 1
        stop = len(value)
        while not value[stop - 1].isalnum():
            stop -= 1
        before = text[found[k - 1].end() if k else 0 : m.start()]
        after = text[m.end() : found[k + 1].start() if k + 1 < len(found) else len(text)]
        left = ["#" if k else "^"] + words(before[-pii.CONTEXT :])
        right = words(after[: pii.CONTEXT]) + ["#" if k + 1 < len(found) else "$"]
        core = value[lead:stop]
        kinds = [n for n, p in enumerate(PLAIN) if re.fullmatch(p, core) and passes(n, core)]
        patterns = {f"{left[-1]} _", f"{left[-1]} _ {right[0]}", f"{left[-2] if len(left) > 1 else ''} {left[-1]} _"}
        yield m.start() + lead, m.start() + stop, kinds[-1] if kinds else None, core.lower(), patterns


def bootstrapped(texts: list[str | None]) -> list[list[tuple[int, int, int]]]:
    """Spans of each text after the rounds of scoring."""
    every = [list(items(t or "")) for t in texts]
    edges = {(p, v) for row in every for *_, v, patterns in row for p in patterns}
    seeds = {(v, k) for row in every for _, _, k, v, _ in row if k is not None}
    known = {s: 1_000_000 for s in seeds}
    for _ in range(pii.ROUNDS):
        held, sizes = {}, {}
        for p, v in edges:
            sizes[p] = sizes.get(p, 0) + 1
            for k in range(4):
                if (v, k) in known:
                    held[p, k] = held.get((p, k), 0) + known[v, k]
        passed = {pk: s // (sizes[pk[0]] + 1) for pk, s in held.items() if s // (sizes[pk[0]] + 1) >= pii.ACCEPT}
        known = {s: 1_000_000 for s in seeds}
        for p, v in edges:
            for k in range(4):
                if (p, k) in passed and not any((v, n) in seeds for n in range(4)):
                    known[v, k] = max(known.get((v, k), 0), passed[p, k])
    out = []
    for text, row in zip(texts, every):
        own, more = base(text), []
        for start, stop, kind, _, patterns in row:
            best = max(((passed[p, k], -k) for p in patterns for k in range(4) if (p, k) in passed), default=None)
            if kind is None and best and all(stop <= a or e <= start for a, _, e in own):
                more.append((start, -best[1], stop))
        out.append(sorted(own + more))
    return out


def letter(seed: int) -> str:
    """Prose with identifiers behind telling and behind meaningless words."""
    r = random.Random(seed)
    say = lambda n: " ".join(r.choice(["the", "an", "era", "con", "ßt", "漢", "of"]) for _ in range(n))
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    telling = [
        f"write to mail{r.randrange(500)}@host{r.randrange(9)}.org",
        f"write to user{r.randrange(40)} at host" if r.random() < 0.2 else f"write to u{d(3)}@h.example.com,",
        f"call me: +1 ({d(3)}) 555-{d(4)}" if r.random() < 0.9 else f"call me: {d(3)}/{d(4)}",
        f"from host 10.0.{r.randrange(256)}.{r.randrange(256)}" if r.random() < 0.9 else "from host node7",
        f"paid with {d(16)}",
        f"in {r.randrange(1900, 2030)}",
        f"#{d(5)}!!",
    ]
    return say(r.randint(0, 9)) + " " + (" " + say(3) + " ").join(r.sample(telling, 5)) + say(r.randint(0, 4))


@pytest.fixture(scope="module")
def letters():
    return [letter(k) for k in range(150)]


def result(df):
    return [(r.doc_id, [tuple(s) for s in r.base], [tuple(s) for s in r.spans]) for r in df.collect()]


def test_graph_against_plain_version(spark, letters):
    docs = frame(spark, [(k, t, None, None, None) for k, t in enumerate(letters)], SCHEMA)
    got = sorted(result(pii.personal_data(docs)))
    want = [(k, base(t), s) for (k, t), s in zip(enumerate(letters), bootstrapped(letters), strict=True)]
    assert got == want
    added = {letters[k][s[0] : s[2]] for k, own, spans in got for s in set(spans) - set(own)}
    assert "node7" in added and any(a.startswith("user") for a in added) and not any(a.isdigit() and len(a) == 4 for a in added)


def test_awkward_texts(spark):
    texts = [r[1] for r in awkward()] + ["1" * 60_000, "a." * 30_000 + "@", "1.2.3.4." * 9_000, "+1 " * 20_000, "a@b.c_d@e.f g@@h.i 1@2.3", "@a.b .@a.b %@-.-"]
    texts += ["4111 1111 1111 1111 1", "4111-1111-1111-1111", "1.2.3.256 01.002.255.0 1.2.3.4.5.6.7.8", "+49 (30) 1234567.", "++1 234 567 890 1", "😀 x@y.z 漢 +1 555 555 5555"]
    docs = frame(spark, [(k, t, None, None, None) for k, t in enumerate(texts)], SCHEMA)
    assert sorted(result(pii.personal_data(docs))) == [(k, base(t), s) for (k, t), s in zip(enumerate(texts), bootstrapped(texts), strict=True)]


def test_many_matches_in_one_text(spark):
    text = " ".join(f"10.1.{k % 256}.{k // 256}" for k in range(3_000))
    docs = frame(spark, [(1, text, None, None, None)], SCHEMA)
    (_, own, _), = result(pii.personal_data(docs))
    assert own == base(text) and len(own) == 3_000


def test_repeated_null_ids_empty_and_clashing(spark):
    rows = [(1, "at a@b.cd", None, None, None)] * 2 + [(None, "at a@b.cd", None, None, None), (None, None, None, None, None)]
    got = sorted(result(pii.personal_data(clashing(frame(spark, rows, SCHEMA)))), key=repr)
    assert got == [(1, [(3, 0, 9)], [(3, 0, 9)])] * 2 + [(None, [(3, 0, 9)], [(3, 0, 9)]), (None, [], [])]
    assert result(pii.personal_data(frame(spark, [], SCHEMA))) == []


def test_query_columns(spark):
    docs = frame(spark, [(1, "a@b.cd 1.2.3.4", None, None, None), (2, None, None, None, None)], SCHEMA)
    rows = {r.doc_id: r.asDict() for r in digests(docs).collect()}
    spans = "email:0:6,ip:7:14"
    assert rows[1] == {"doc_id": 1, "n_email": 1, "n_ip": 1, "n_card": 0, "n_phone": 0, "base_sha256": hashlib.sha256(spans.encode()).hexdigest(), "spans": spans}
    assert rows[2]["base_sha256"] == hashlib.sha256(b"").hexdigest() and rows[2]["spans"] == ""


def test_running_sums(spark):
    lengths = [random.Random(k).randrange(9) for k in range(1_000)]
    for n in (0, 1, pii.BLOCK, pii.BLOCK + 1, 1_000):
        row = spark.createDataFrame([(lengths[:n],)], "a array<bigint>").select(pii.running(F.col("a"))).first()[0]
        assert row == [sum(lengths[: k + 1]) for k in range(n)]


def test_every_base_span_is_a_seed(spark):
    """Without a digit, before a stop, in brackets or behind a word of the same token: an identifier enters the graph."""
    texts = ["to jane@host.org now", "to <jane@host.org>, now", "mailto:jane@host.org?x", "ip=10.0.0.1:80 up", "(10.0.0.1).", "paid 4111 1111 1111 1111, then",
             "nr.4111 1111 1111 1111", "call (+1 555 123 4567)", "tel:+49 30 1234567.", "x4111111111111111y a1@b.cd, 10.0.0.1."]
    rows = frame(spark, [(k, t, None, None, None) for k, t in enumerate(texts)], SCHEMA).select("doc_id", pii.items(F.col("text")).alias("i")).collect()
    for row in rows:
        assert [(i.start, i.kind, i.stop) for i in row.i if i.kind is not None] == base(texts[row.doc_id]), texts[row.doc_id]


def test_an_address_without_digits_is_learnt_from_others(spark):
    """Contexts of addresses without a digit count, and what stands there with an @ but without a suffix is found."""
    names = ["ann", "bob", "cid", "dan", "eva", "fay", "gus", "hal"]
    texts = [f"please write to {n}@host.org, today" for n in names] + ["please write to ivy@localhost today"]
    docs = frame(spark, [(k, t, None, None, None) for k, t in enumerate(texts)], SCHEMA)
    got = sorted(result(pii.personal_data(docs)))
    assert got[-1] == (8, [], [(16, 0, 29)])
    assert all(own == spans == base(texts[k]) for k, own, spans in got[:-1])
