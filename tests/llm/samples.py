"""Small tables with every awkward case, and brute-force versions of the operators."""

from __future__ import annotations

import random
import re

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def prose(seed: int, n: int, words: int = 400) -> str:
    r = random.Random(seed)
    stock = ["".join(r.choice("abcdefgéßñ") for _ in range(r.randint(2, 9))) for _ in range(words)]
    return " ".join(r.choice(stock) for _ in range(n))


def awkward() -> list[tuple]:
    """Nulls in every column, empty, blank, one-word and very long texts, copies, ties, repeated rows."""
    long = prose(1, 30_000)
    shared = prose(2, 120)
    texts = [None, "", "  \n\t ", "word", "one two three four", long, "a" * 30_000, "x y " * 2_000, "漢字 😀   é\x00 z", shared, shared]
    texts += [prose(3, 80) + " " + shared, shared + "\n" + prose(4, 90), prose(5, 60), prose(5, 60) + " end", "same line\nsame line\n" * 40]
    rows = [(i, t, ["en", "de", None][i % 3], ["a", "b", None, "é"][i % 4], None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[9], rows[9], (None, shared, None, None, None), (None, None, None, None, None), (-5, prose(6, 70), "en", "a", 3)]
    return rows


def frame(spark, rows, schema: str = SCHEMA):
    return spark.createDataFrame(rows, schema)


def clashing(df):
    """The frame with extra columns named like those the operators add or use."""
    from pyspark.sql import functions as F

    for name in "kept size copies target ids decoded digest hash id key row removed n_chunks n_words fence _id _repeated _source _range _text _own bucket component value level".split():
        df = df.withColumn(name, F.lit("other"))
    return df


def shingles(text: str | None, width: int = 5) -> frozenset:
    words = WORDS.findall((text or "").translate(LOWER))
    return frozenset(tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))) if words else frozenset()


def linked(docs: list[tuple[int, str | None]], percent: int = 85) -> dict[int, int]:
    """Smallest id reachable for each id, all pairs compared."""
    sets = {i: shingles(t) for i, t in docs}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            small, large = sorted((len(sets[a]), len(sets[b])))
            if small and 100 * small >= percent * large:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (small + large - both):
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}
