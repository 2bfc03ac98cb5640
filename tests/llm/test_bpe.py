import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from ledgermark.llm import bpe
from ledgermark.llm.bpe_query import RANKS, digests
from tests.llm.samples import SCHEMA, awkward, clashing, frame

PATH = public_tokenizers.path(RANKS)


@pytest.fixture(scope="module")
def ranks():
    with open(PATH, "rb") as file:
        return bpe.read_ranks(file.read())


@pytest.fixture(scope="module")
def library(ranks):
    with open(PATH, "rb") as file:
        assert ranks == {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_random_texts(ranks, library):
    encoder, r = bpe.TextEncoder(ranks, public_tokenizers.PATTERN), random.Random(3)
    alphabet = "ab thein \n\t.é漢😀’0'sS\x1c\x85᠎ ​\0 "
    for _ in range(3000):
        text = "".join(r.choice(alphabet) for _ in range(r.randint(0, 40)))
        assert encoder.encode(text).tolist() == library.encode_ordinary(text)


def test_tables_that_start_afresh(ranks, library, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_TRANSITIONS", 50)
    monkeypatch.setattr(bpe, "KEPT_STATES", 60)
    monkeypatch.setattr(bpe, "KEPT_PAIRS", 5)
    monkeypatch.setattr(bpe, "KEPT_STRETCHES", 3)
    monkeypatch.setattr(bpe, "LOOKAHEAD", 300)
    encoder = bpe.TextEncoder(ranks, public_tokenizers.PATTERN)
    for text in ("thereforeininteresting " * 40, "a" * 5000, "thtiontheraunfathomable" * 200, " " * 700 + "b"):
        assert encoder.encode(text).tolist() == library.encode_ordinary(text)


def test_a_small_vocabulary_with_a_token_no_merge_makes():
    ranks = {b"a": 0, b"b": 1, b"c": 2, b"ab": 3, b"bc": 4, b"abc": 5, b"cab": 6, b"aab": 7}
    library = tiktoken.Encoding("small", pat_str=r"[abc]+", mergeable_ranks=ranks, special_tokens={})
    machine, r = bpe.Transducer(ranks), random.Random(1)
    for _ in range(2000):
        text = "".join(r.choice("abc") for _ in range(r.randint(1, 14)))
        assert list(machine.encode(text.encode())) == library.encode_ordinary(text)


def test_streamed_decoding():
    data = "é漢😀a".encode() + b"\xff\xe6\xbc" + "b\U0010ffff".encode() + b"\xed\xa0\x80\xf0\x9f"
    for size in (1, 2, 3, 5):
        parts = [data[i : i + size] for i in range(0, len(data), size)]
        assert "".join(bpe.stream_text(parts)) == data.decode(errors="replace")
    assert list(bpe.stream_text([b"\xe6\xbc", b"\xa2!"])) == ["", "漢!", ""]


def test_digests(spark, library):
    rows = awkward()
    got = digests(clashing(frame(spark, rows))).collect()
    want = []
    for doc_id, text, *_ in rows:
        ids = library.encode_ordinary(text or "")
        want.append((doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert digests(frame(spark, [], SCHEMA)).collect() == []


def test_ids_and_text_of_the_operator(spark):
    df = clashing(frame(spark, awkward())).drop("ids", "decoded")
    back = bpe.decode(bpe.encode(df, PATH, public_tokenizers.PATTERN), PATH, text="again").collect()
    assert all(r["again"] == (r["text"] or "") == bytes(r["decoded"]).decode() for r in back)


def test_a_share_of_the_tables_gives_the_same_ids(ranks, library):
    """Where several operators share an executor a worker keeps a quarter; what it encodes stays the same."""
    whole, part = bpe.TextEncoder(ranks, public_tokenizers.PATTERN), bpe.TextEncoder(ranks, public_tokenizers.PATTERN, bpe.SHARED)
    for kept, all_ in ((part.stretches, whole.stretches), (part.pieces, whole.pieces), (part.machine.steps, whole.machine.steps), (part.machine.pairs, whole.machine.pairs)):
        assert 0 < kept.most <= all_.most // bpe.SHARED
    for text in ("thereforeininteresting " * 40, "é漢😀 of the era, 12 ways"):
        assert part.encode(text).tolist() == library.encode_ordinary(text)
