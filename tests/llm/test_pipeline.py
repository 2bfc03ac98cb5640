import hashlib
from collections import Counter

import duckdb
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from ledgermark.llm import language
from ledgermark.llm.bpe import read_ranks
from ledgermark.llm.bpe_query import RANKS
from ledgermark.llm.mixing_query import ORACLES
from tests.llm.samples import SCHEMA, awkward, clashing, frame, linked
from tests.llm.test_near_dups_chunks import without_repeats


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("corpus"))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    unique = {r[0]: r for r in awkward() if r[0] is not None}
    rows = [tuple(r) for r in docs] + [(100_000 + i, *r[1:]) for i, r in unique.items()]
    frame(spark, rows).repartition(3).write.parquet(f"{root}/documents.parquet")
    return root


def test_stages_and_result_against_brute_force(spark, folder):
    stages, docs = dict(corpus_pipeline.STAGES), spark.read.parquet(f"{folder}/documents.parquet")
    assert list(stages) == ["language", "near_copies", "passages", "mixture", "tokens"]
    columns = docs.columns
    first = stages["language"](spark, docs, folder)
    assert first.columns == columns
    left = {r["doc_id"]: r for r in first.collect()}
    assert len(left) > 195

    component = linked([(i, r["text"]) for i, r in left.items()])
    left = {i: r for i, r in left.items() if component[i] == i}
    cut = without_repeats([(i, r["text"] or "") for i, r in left.items()])
    cut = {i: t for i, t in cut.items() if t == left[i]["text"] or t.split()}
    db = duckdb.connect()
    db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    db.executemany("INSERT INTO documents VALUES (?, ?, ?)", [(i, t, left[i]["source"]) for i, t in cut.items()])
    copies = {r[0]: (r[4] // r[1] if r[1] else 0) for r in db.execute(ORACLES["op7_systematic_mixture"]).fetchall()}

    with open(public_tokenizers.path(RANKS), "rb") as file:
        library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(file.read()), special_tokens={})
    want = Counter()
    for i, t in cut.items():
        ids = library.encode_ordinary(t)
        row = (i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
        want[row] += copies[i]
    got = corpus_pipeline.run(spark, folder)
    assert Counter(map(tuple, got.collect())) == +want


def test_awkward_and_empty_tables(spark, tmp_path):
    for name, rows in (("odd", awkward()), ("none", [])):
        clashing(frame(spark, rows, SCHEMA)).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        got = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert (len(got) == 0) == (name == "none")


def test_rejected_documents_go(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    gone = {r["doc_id"] for r in docs.collect()} - {r["doc_id"] for r in language.accepted(docs).collect()}
    assert {100_000, 100_001, 100_002} <= gone
