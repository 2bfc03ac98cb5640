"""Ingest by keyed state: order, replay, and batches that read nothing of earlier ones."""

from __future__ import annotations

import datetime
import json
import random
import shutil

import pyarrow as pa
import pytest

from ledgermark.streaming import ingest
from ledgermark.streaming.ingest import first_rows, ingest_completions_stream, read_ingested

SCHEMA = "id string, sample_idx int, text string"


@pytest.fixture
def dirs(tmp_path):
    (tmp_path / "in").mkdir()
    return tmp_path


def drop(dirs, name, rows):
    (dirs / "in" / name).write_text("".join(json.dumps(r) + "\n" for r in rows))


def run(spark, dirs, **how):
    ingest_completions_stream(spark, str(dirs / "in"), str(dirs / "out"), str(dirs / "check"), SCHEMA, **how)


def stored(spark, dirs):
    return sorted(map(tuple, read_ingested(spark, str(dirs / "out"), SCHEMA).drop("batch_id").collect()), key=repr)


def test_first_rows_of_every_key():
    r = random.Random(1)
    rows = [(r.choice(["a", "b", None]), r.choice([1, 2, None]), k) for k in r.sample(range(3_000), 3_000)]
    batch = lambda part: pa.RecordBatch.from_pylist([dict(zip("xyz", p, strict=True)) for p in part], schema=pa.schema([("x", pa.string()), ("y", pa.int64()), ("z", pa.int64())]))
    found = first_rows([batch(rows[k : k + 700]) for k in range(0, 3_000, 700)], ["x", "y"], ["z"])
    want = {}
    for x, y, z in sorted(rows, key=lambda t: t[2]):
        want.setdefault((x, y), z)
    assert {(d["x"], d["y"]): d["z"] for b in found for d in b.to_pylist()} == want
    assert first_rows([batch([])], ["x"], ["z"]) == []


def test_one_key_holds_most_rows_and_nulls_are_equal(spark, dirs):
    rows = [{"id": "hot", "sample_idx": 0, "text": f"t{k}"} for k in range(5_000)] + [{"id": None, "sample_idx": None, "text": f"n{k}"} for k in range(3)]
    drop(dirs, "1.jsonl", rows)
    run(spark, dirs)
    drop(dirs, "2.jsonl", [{"id": "hot", "sample_idx": 0, "text": "late"}, {"id": None, "text": "late"}, {"id": "hot", "sample_idx": 1, "text": "new"}])
    run(spark, dirs)
    assert stored(spark, dirs) == sorted([("hot", 0, "t0"), (None, None, "n0"), ("hot", 1, "new")], key=repr)


def test_a_batch_reads_nothing_of_earlier_ones(spark, dirs):
    """With what was stored gone, repeated keys still stay out: they are state, not output."""
    drop(dirs, "1.jsonl", [{"id": "a", "sample_idx": 0, "text": "first"}])
    run(spark, dirs)
    shutil.move(dirs / "out", dirs / "elsewhere")
    drop(dirs, "2.jsonl", [{"id": "a", "sample_idx": 0, "text": "again"}, {"id": "b", "sample_idx": 0, "text": "x"}])
    run(spark, dirs)
    assert stored(spark, dirs) == [("b", 0, "x")]


def test_a_batch_that_was_written_but_not_committed_is_replayed(spark, dirs):
    drop(dirs, "1.jsonl", [{"id": "a", "sample_idx": 0, "text": "first"}])
    run(spark, dirs)
    drop(dirs, "2.jsonl", [{"id": k, "sample_idx": 0, "text": f"second {k}"} for k in "abc"])
    run(spark, dirs)
    done = [("a", 0, "first"), ("b", 0, "second b"), ("c", 0, "second c")]
    assert stored(spark, dirs) == done
    for commit in (dirs / "check" / "commits").glob("*1*"):
        commit.unlink()
    run(spark, dirs)
    assert stored(spark, dirs) == done


def test_several_batches_in_one_run(spark, dirs):
    for n in range(4):
        drop(dirs, f"{n}.jsonl", [{"id": f"k{k}", "sample_idx": 0, "text": f"{n}"} for k in range(n + 1, 6)])
    run(spark, dirs, max_files=1)
    rows = read_ingested(spark, str(dirs / "out"), SCHEMA).collect()
    assert len({r.batch_id for r in rows}) == 1 and sorted(r.id for r in rows) == ["k1", "k2", "k3", "k4", "k5"]


def test_tasks_hold_keys_and_not_rows(monkeypatch):
    """Texts of 120 MB under distinct keys used to be held whole by a task; now a few MB are."""
    monkeypatch.setattr(ingest, "HELD_BYTES", 1 << 20)
    # 120 batches of ten texts of 100 KB; the last one repeats the keys of the first
    names = ["id", "text", *ingest._ORDER]
    at = pa.array([datetime.datetime(2026, 1, 1)] * 10, pa.timestamp("us"))
    rows = lambda k: pa.RecordBatch.from_arrays(
        [pa.array([f"{k % 119}-{j}" for j in range(10)]), pa.array([chr(97 + k % 26) * 100_000] * 10), at, pa.array(["f"] * 10), pa.array([0] * 10, pa.int64()), pa.array(range(10 * k, 10 * k + 10), pa.int64())], names=names
    )
    before, most, found = pa.total_allocated_bytes(), 0, []
    for batch in ingest._settled(["id"], ingest._ORDER)(rows(k) for k in range(120)):
        most = max(most, pa.total_allocated_bytes() - before)
        found += [(i, t[0], len(t)) for i, t in zip(batch["id"].to_pylist(), batch["text"].to_pylist(), strict=True)]
    assert found == [(f"{k}-{j}", chr(97 + k % 26), 100_000) for k in range(119) for j in range(10)]
    assert most < 8_000_000
    parts = list(ingest._combined(["id"], ingest._ORDER[:-1])(rows(k).drop_columns([ingest._LINE]) for k in range(120)))
    assert len(parts) > 50 and max(b.nbytes for b in parts) < 3_000_000 and {i for b in parts for i in b["id"].to_pylist()} == {f"{k}-{j}" for k in range(119) for j in range(10)}
