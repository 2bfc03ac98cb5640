import hashlib
import random
from datetime import datetime, timedelta, timezone

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from ledgermark.llm import fixity, separators, url_lists
from ledgermark.llm.bpe import read_ranks
from ledgermark.llm.fixity_query import ORACLES as FIXITY_SQL
from ledgermark.llm.fixity_query import op1_merkle_fixity
from ledgermark.llm.separators_query import END, RANKS, op5_separator_scan
from ledgermark.llm.url_lists_query import ORACLES as LISTS_SQL
from ledgermark.llm.url_lists_query import op8_temporal_url_lists
from tests.llm.samples import SCHEMA, awkward, clashing, frame
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.01"
RECORDS = "replica string, archive string, offset bigint, record_id bigint, data string"


def test_fixity_against_sql(spark):
    problems, n = compare(spark, connect(SF), op1_merkle_fixity, FIXITY_SQL["op1_merkle_fixity"], SF)
    assert not problems and n > 3


def test_damage_is_found_and_nothing_else(spark):
    r, rows, want = random.Random(2), [], set()
    for archive in ("x", "y", "z", None):
        at = 0
        for i in range(400):
            data, other = f"record {archive} {i} " * r.randint(1, 400), None
            fate = r.random() if archive != "z" else 1
            if fate < 0.01:
                want.add((archive or "", at, "missing"))
            elif fate < 0.02:
                other = data[:-1] + "#"
                want.add((archive or "", at, "changed"))
            elif fate < 0.03:
                other = data
                rows.append(("b", archive, at + 1, 900 + i, "extra"))
                want.add((archive or "", at + 1, "extra"))
            else:
                other = data
            rows.append(("a", archive, at, i, data))
            if other is not None:
                rows.append(("b", archive, at, i, other))
            at += len(data) + 2
    rows += [("a", "t", 5, 1, "one"), ("a", "t", 5, 2, "two"), ("b", "t", 5, 2, "two"), ("b", "t", 5, 1, "one")]
    rows += [("a", "t", 9, 1, "same"), ("a", "t", 9, 1, "same"), ("b", "t", 9, 1, "same")]
    rows += [("a", "t", None, 1, None), ("b", "t", None, 1, "")]
    want.add(("t", 9, "changed"))
    found = fixity.audit(fixity.record_hashes(frame(spark, rows, RECORDS).repartition(6)), "a", "b").collect()
    assert {(x["archive"], x["offset"], x["kind"]) for x in found} == want
    levels = fixity.build_tree(fixity.record_hashes(frame(spark, rows, RECORDS)))
    assert len(levels) > 2 and levels[-1].groupBy("replica", "archive").count().filter("count > 1").count() == 0


def test_fixity_of_nothing(spark):
    empty = fixity.record_hashes(frame(spark, [], RECORDS))
    assert fixity.audit(empty, "a", "b").collect() == []


def test_lists_against_sql(spark):
    problems, n = compare(spark, connect(SF), op8_temporal_url_lists, LISTS_SQL["op8_temporal_url_lists"], SF)
    assert not problems and n == 250


def test_lists_as_of_each_capture(spark):
    start, r = datetime(2024, 3, 1, tzinfo=timezone.utc), random.Random(7)
    hosts = ["a.example.com", "b.a.example.com", "example.org", "EXAMPLE.net:8080", "x.y.example.com"]
    patterns = ["example.com", "a.example.com", "http://Example.org/bad/", "example.net", "y.example.com", "nowhere.test"]
    entries = [(r.choice(["m", "s", "ok", "other"]), r.choice(patterns), r.random() < 0.6, start + timedelta(minutes=r.randrange(6000))) for _ in range(160)]
    entries += [(None, "example.com", True, start), ("m", None, True, start), ("m", "example.com", True, None), entries[0], entries[1]]
    captures = [(i, f"https://{r.choice(hosts)}{r.choice(['', '/', '/bad', '/bad/?q=1#f', '/good'])}", start + timedelta(minutes=r.randrange(6000))) for i in range(400)]
    captures += [(1000, None, start), (1001, "no url", start), (1002, "http://a.example.com/", None), (None, "http://a.example.com/", start + timedelta(days=3)), captures[0]]
    captures += [(2000 + i, "http://a.example.com/", e[3]) for i, e in enumerate(entries) if e[3]]

    def on(name, pattern, at):
        """The last entry up to a time decides; of one time, adding does."""
        past = [(e[3], bool(e[2])) for e in entries if e[0] == name and e[1] == pattern and e[3] and e[3] <= at]
        return bool(past) and max(past)[1]

    def covers(pattern, url):
        bare = pattern.lower().replace("http://", "").rstrip("/")
        rest = url.lower().split("://", 1)[1]
        host = rest.split("/", 1)[0].split(":")[0]
        page = host + "/" + rest.split("/", 1)[1].split("?")[0].rstrip("/") if "/" in rest else host
        return bare == page.rstrip("/") or bare == host or host.endswith("." + bare)

    frame_of = clashing(spark.createDataFrame(captures, "page_id bigint, url string, fetched_at timestamp")).drop("key")
    listed = spark.createDataFrame(entries, "list string, pattern string, adds boolean, at timestamp")
    got = {(x["page_id"], x["url"], x["fetched_at"]): x for x in url_lists.evaluate(frame_of, listed, ["m", "s", "ok"], allow=["ok"]).collect()}
    assert len(got) == len(set(captures))
    for page_id, url, at in captures:
        x = got[(page_id, url, at.replace(tzinfo=None) if at else None)]
        names = [n for n in ("m", "s", "ok") if url and "://" in url and at and any(covers(p, url) and on(n, p, at) for p in patterns)]
        assert x["lists"] == names
        assert x["blocked"] == (("m" in names or "s" in names) and "ok" not in names)
    with pytest.raises(ValueError):
        url_lists.evaluate(frame_of, listed, [str(i) for i in range(63)])
    nothing = url_lists.evaluate(frame_of.limit(0), listed.limit(0), ["m"])
    assert nothing.collect() == []


def test_validity_intervals(spark):
    day = lambda n: datetime(2024, 1, n)
    rows = [("m", "p", True, day(1)), ("m", "p", True, day(2)), ("m", "p", False, day(3)), ("m", "p", False, day(4)), ("m", "p", True, day(5)), ("m", "q", False, day(1))]
    got = url_lists.intervals(spark.createDataFrame(rows, "list string, pattern string, adds boolean, at timestamp")).collect()
    assert sorted((x["since"].day, x["until"].day if x["until"] else None) for x in got) == [(1, 3), (5, None)]


def test_separators_across_blocks(spark, tmp_path):
    r, want = random.Random(3), []
    for f, n in enumerate((0, 1, 7, 64, 1000, 5000)):
        tokens = np.array([9 if r.random() < (0.0 if f == 3 else 0.08) else 1 for _ in range(n)], "<u2")
        tokens.tofile(tmp_path / f"f{f}.bin")
        start = ordinal = 0
        for i, t in enumerate(tokens.tolist()):
            if t == 9:
                want.append((f"f{f}.bin", ordinal, start, i - start, True))
                ordinal, start = ordinal + 1, i + 1
        if start < n:
            want.append((f"f{f}.bin", ordinal, start, n - start, False))
    files = spark.createDataFrame([(f"f{f}.bin",) for f in range(6)], "file string")
    for block, span in ((1, 3), (5, 2), (16, 1024), (1 << 20, 1024)):
        blocks = separators.token_blocks(files, str(tmp_path), block=block)
        found = separators.separators(blocks, str(tmp_path), 9, block=block)
        got = separators.documents(found, block=block, span=span).collect()
        assert sorted(map(tuple, got)) == sorted(want)


def test_token_counts_of_documents(spark, tmp_path):
    with open(public_tokenizers.path(RANKS), "rb") as file:
        library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(file.read()), special_tokens={})
    assert END == library.n_vocab
    clashing(frame(spark, awkward())).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = op5_separator_scan(spark, str(tmp_path)).collect()
    want = [(i, len(library.encode_ordinary(t or "")), True) for i, t, *_ in awkward()]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    frame(spark, [], SCHEMA).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert op5_separator_scan(spark, f"{tmp_path}/none").collect() == []


def test_fixity_hashes_are_of_the_bytes(spark):
    row = fixity.record_hashes(frame(spark, [("a", "x", 0, 1, "é")], RECORDS)).first()
    assert row["sha256"] == hashlib.sha256("é".encode()).hexdigest() and row["length"] == 2
    assert fixity.record_hashes(frame(spark, [("a", None, None, None, None)], RECORDS)).filter(F.col("offset") == -1).count() == 1
