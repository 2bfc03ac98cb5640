import random

import pytest

from ledgermark.llm import chunks, near_dups
from ledgermark.llm.components import components
from tests.llm.samples import SCHEMA, awkward, clashing, frame, linked, prose, shingles


def variants(seed: int, n: int, edits: int, words: int = 160) -> list[str]:
    """Copies of one text with single words changed."""
    r, base = random.Random(seed), prose(seed, words).split()
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(edits):
            own[r.randrange(len(own))] = f"new{r.randrange(1000)}"
        out.append(" ".join(own))
    return out


@pytest.fixture(scope="module")
def rows():
    texts = [prose(50 + i, 90) for i in range(40)]
    texts += variants(1, 30, 1) + variants(2, 25, 2) + variants(3, 20, 3) + variants(4, 12, 6, 300)
    texts += [texts[5].upper(), texts[6].replace(" ", "\n"), "a b", "A  B", "a b c"]
    random.Random(9).shuffle(texts)
    return [(i * 3, t, "en", "a", 1) for i, t in enumerate(texts)]


def test_components_of_copies_against_all_pairs(spark, rows):
    want = linked([(r[0], r[1]) for r in rows])
    got = {r["doc_id"]: r for r in near_dups.near_duplicates(clashing(frame(spark, rows))).collect()}
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())
    assert all(got[r[0]]["n_shingles"] == len(shingles(r[1])) for r in rows)


def test_rest_finds_what_centres_leave(spark, rows, monkeypatch):
    """Without rounds of centres all pairs of a bucket are compared; both must give the same."""
    want = linked([(r[0], r[1]) for r in rows])
    monkeypatch.setattr(near_dups, "CENTRES", 0)
    monkeypatch.setattr(near_dups, "BROADCAST_IDS", 0)
    again = near_dups.near_duplicates(frame(spark, rows).repartition(7)).collect()
    assert {r["doc_id"]: r["component_id"] for r in again} == want


def test_awkward_rows(spark):
    got = near_dups.near_duplicates(clashing(frame(spark, awkward()))).collect()
    assert len(got) == len(awkward())
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert by[0]["n_shingles"] == by[1]["n_shingles"] == 0 and by[0]["kept"] and by[1]["kept"]
    assert by[10]["component_id"] == 9 and by[14]["component_id"] == 13
    assert near_dups.near_duplicates(frame(spark, [], SCHEMA)).collect() == []


def test_components_of_chains_and_stars(spark):
    r = random.Random(4)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(r.randrange(200, 260), r.randrange(200, 260)) for _ in range(40)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {x["id"]: x["component"] for x in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


def gear_cuts(data: bytes) -> list[tuple[int, int]]:
    """Chunk spans of one text, byte by byte."""
    table, spans, at, last = chunks.gear().tolist(), [], 0, -chunks.LONGEST
    for i in range(len(data)):
        rolled = 0
        for b in data[max(0, i - chunks.WINDOW + 1) : i + 1]:
            rolled = (rolled * 2 + table[b]) % 2**32
        low = rolled < (1 << 32) // chunks.SPACING
        if (low and i - last > chunks.SHORTEST or i + 1 - at == chunks.LONGEST) and i + 1 < len(data):
            spans.append((at, i + 1))
            at = i + 1
        if low:
            last = i
    return [*spans, (at, len(data))] if data else spans


def without_repeats(docs: list[tuple[int, str]], min_words: int = chunks.MIN_WORDS) -> dict[int, str]:
    """The operator, one document after the other."""
    blank, seen, out = set(b" \t\n\x0b\x0c\r"), set(), {}
    for doc_id, text in sorted(docs):
        data, flags, spans = text.encode(), [], gear_cuts(text.encode())
        own = set()
        for a, b in spans:
            flags.append(data[a:b] in seen or data[a:b] in own)
            own.add(data[a:b])
        seen |= own
        kept, at, i = b"", 0, 0
        while i < len(spans):
            j = i
            while j < len(spans) and flags[j]:
                j += 1
            if j > i:
                a, b = spans[i][0], spans[j - 1][1]
                while 0 < a < b and data[a] not in blank and data[a - 1] not in blank:
                    a += 1
                while a < b < len(data) and data[b] not in blank and data[b - 1] not in blank:
                    b -= 1
                words = bytes(32 if x in blank else x for x in data[a:b]).split(b" ")
                if sum(map(bool, words)) >= min_words:
                    kept, at = kept + data[at:a], b
            i = max(j, i + 1)
        out[doc_id] = (kept + data[at:]).decode()
    return out


def test_cut_texts_against_brute_force(spark):
    passages = [prose(70 + i, 60 + 10 * i) for i in range(4)]
    r, rows = random.Random(5), []
    for i in range(60):
        parts = [prose(300 + i, 40), r.choice([*passages, prose(900 + i, 30)]), prose(600 + i, 25)]
        rows.append((i, r.choice([" ", "\n"]).join(parts), "en", "a", 1))
    rows += [(60, rows[3][1], "en", "a", 1), (61, passages[0], "en", "a", 1), (62, "é" * 700, "en", "a", 1), (63, "", "en", "a", 0)]
    got = {x["doc_id"]: x for x in chunks.without_repeats(clashing(frame(spark, rows)).repartition(5)).collect()}
    assert {i: x["text"] for i, x in got.items()} == without_repeats([(x[0], x[1]) for x in rows])
    for i, text, *_ in rows:
        left, at = "", 0
        for s in got[i]["removed"]:
            left, at = left + text[at : s["start"]], s["stop"]
        assert left + text[at:] == got[i]["text"]
    for passage in passages:
        assert sum(passage in x["text"] for x in got.values()) <= 1
    assert all(x["text"] == rows[i][1] for i, x in got.items() if i < 60 and not any(p in rows[i][1] for p in passages))


def test_insertions_shift_nothing():
    import numpy as np

    text = prose(8, 3000).encode()
    spans = lambda data: {data[a:b] for a, b in gear_cuts(data)}
    moved = text[:4000] + b"inserted words " + text[4000:]
    assert len(spans(text) - spans(moved)) <= 4
    bounds, firsts = chunks.chunk_bounds(np.frombuffer(text + moved, np.uint8), np.array([0, len(text), len(text) + len(moved)]))
    assert [(a, b) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)][: firsts[1]] == gear_cuts(text)


def test_chunks_of_awkward_rows(spark):
    rows = awkward()
    got = chunks.without_repeats(clashing(frame(spark, rows))).collect()
    assert len(got) == len(rows)
    assert [x for x in got if x["doc_id"] == 0][0]["text"] is None
    nameless = [x for x in got if x["doc_id"] is None and x["text"] is not None]
    assert nameless and nameless[0]["text"] == rows[9][1]  # a null id comes first and keeps the passage
    assert all(x["text"] == "" for x in got if x["doc_id"] in (9, 10))
    assert chunks.without_repeats(frame(spark, [], SCHEMA)).collect() == []
