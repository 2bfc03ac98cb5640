"""Arrays read by blocks, against the same rows and against the reader of whole files."""

import json
import random
from contextlib import contextmanager

import pytest

from ledgermark.sources.json_arrays import read_large_json_array
from ledgermark.sources.readers import read_json_array

SCHEMA = "id bigint, note string, inner struct<a: array<struct<b: string>>>"
PIECES = ["{", "}", "[", "]", '"', "\\", "\\\\", '\\"', "\n", "é", "語", "🙂", ",", ":", " ", "word", '"}', '{"id": 1}', "\\}"]


@contextmanager
def blocks_of(spark, size):
    names = {"spark.sql.files.maxPartitionBytes": str(size), "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    before = {name: spark.conf.get(name, None) for name in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value) if value is not None else spark.conf.unset(name)


def records(seed, n):
    draw = random.Random(seed)
    text = lambda: "".join(draw.choices(PIECES, k=draw.randrange(12)))
    for i in range(n):
        inner = {"a": [{"b": text()} for _ in range(draw.randrange(3))]}
        yield draw.choice([{"id": i, "note": text(), "inner": inner}, {"id": i}, {"id": i, "note": None, "inner": None}, {"id": i, "inner": {}, "more{": [[{}], {"}": "{"}]}])


def rows_of(df):
    return [(r["file_path"].rsplit("/", 1)[-1], r["pos"], r["id"], r["note"], r["inner"]) for r in df.orderBy("file_path", "pos").collect()]


@pytest.mark.parametrize("size", [40, 200, 1_000_000])
@pytest.mark.parametrize("broadcast_blocks", [0, 100_000])
def test_rows_and_places(spark, tmp_path, size, broadcast_blocks):
    files = {f"{k}.json": list(records(k, 60)) for k in range(3)}
    for k, (name, rows) in enumerate(files.items()):
        (tmp_path / name).write_text(json.dumps(rows, indent=(None, 4, 1)[k], ensure_ascii=k == 1), encoding="utf-8")
    with blocks_of(spark, size):
        whole = [(r["id"], r["note"], r["inner"]) for r in read_json_array(spark, str(tmp_path), SCHEMA).collect()]
        found = rows_of(read_large_json_array(spark, str(tmp_path), SCHEMA, place=True, broadcast_blocks=broadcast_blocks))
    assert [(f, pos, id_, note) for f, pos, id_, note, _ in found] == [(f, i, r["id"], r.get("note")) for f, rows in files.items() for i, r in enumerate(rows)]
    assert sorted(map(repr, whole)) == sorted(repr(r[2:]) for r in found)


def test_objects_longer_than_blocks(spark, tmp_path):
    rows = [{"id": i, "note": "{" * 500 + '"' * i} for i in range(5)]
    (tmp_path / "a.json").write_text(json.dumps(rows))
    with blocks_of(spark, 100):
        found = rows_of(read_large_json_array(spark, str(tmp_path), SCHEMA, place=True))
    assert [(r[2], r[3]) for r in found] == [(r["id"], r["note"]) for r in rows]


def test_small_files(spark, tmp_path):
    for name, text in {"a": "[]", "b": "", "c": " [ ]\n", "d": '{"id": 4}', "e": '﻿[{"id": 5}]\n', "f": '[{"id": 6},\r\n{}]', "g": '[{"id": "x"}, null, {"id": 7}]'}.items():
        (tmp_path / f"{name}.json").write_bytes(text.encode())
    found = rows_of(read_large_json_array(spark, str(tmp_path), SCHEMA, place=True))
    assert [(f[0], pos, id_) for f, pos, id_, *_ in found] == [("d", 0, 4), ("e", 0, 5), ("f", 0, 6), ("f", 1, None), ("g", 0, None), ("g", 1, 7)]
    assert read_large_json_array(spark, str(tmp_path / "a.json"), SCHEMA).columns == ["id", "note", "inner"]


def test_one_file_by_many_tasks_and_only_borders_shuffled(spark, tmp_path):
    rows = [{"id": i, "note": "x" * 80} for i in range(20_000)]
    (tmp_path / "a.json").write_text(json.dumps(rows))
    with blocks_of(spark, 200_000):
        df = read_large_json_array(spark, str(tmp_path), SCHEMA)
        assert df.count() == len(rows)
        assert df.rdd.getNumPartitions() > 8
        plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan


def test_other_blocks_are_an_error(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"id": i} for i in range(100)]))
    with blocks_of(spark, 200):
        df = read_large_json_array(spark, str(tmp_path), SCHEMA)
    with blocks_of(spark, 300), pytest.raises(Exception, match="blocks differ"):
        df.select("id").collect()
