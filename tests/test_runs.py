import pytest
from pyspark.sql import functions as F

from ledgermark.sources.runs import committed_runs, read_errors, read_run, write_run, write_scored_run


def scored(spark, shift=0):
    return spark.createDataFrame([(1 + shift, True), (2 + shift, False), (3 + shift, None)], "id bigint, is_correct boolean")


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_both_outputs_from_one_commit(spark, tmp_path):
    path = str(tmp_path / "out")
    run = write_scored_run(scored(spark), path, {"report": spark.range(2)})
    assert ids(read_run(spark, path, "scored")) == [1, 2, 3]
    assert ids(read_errors(spark, path)) == [2, 3]
    assert read_run(spark, path, "report", run).columns == ["id"]
    assert "PartitionFilters: [isnotnull(is_correct" in read_errors(spark, path)._jdf.queryExecution().executedPlan().toString()


def test_a_failing_output_leaves_the_earlier_run(spark, tmp_path):
    path = str(tmp_path / "out")
    write_scored_run(scored(spark), path, {"report": spark.range(1)})
    broken = spark.range(5).select(F.when(F.col("id") == 4, F.raise_error(F.lit("lost")).cast("bigint")).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="lost"):
        write_scored_run(scored(spark, 10), path, {"report": broken})
    assert ids(read_run(spark, path, "scored")) == [1, 2, 3]
    assert ids(read_run(spark, path, "report")) == [0]
    write_scored_run(scored(spark, 20), path, {"report": spark.range(3)})
    assert ids(read_run(spark, path, "scored")) == [21, 22, 23]
    assert committed_runs(spark, path).count() == 2


def test_nothing_committed_and_unknown_outputs(spark, tmp_path):
    path = str(tmp_path / "out")
    assert committed_runs(spark, path).count() == 0
    with pytest.raises(LookupError):
        read_run(spark, path, "scored")
    with pytest.raises(ValueError):
        write_run({}, path)
    run = write_run({"empty": spark.createDataFrame([], "a string, b array<int>")}, path)
    assert read_run(spark, path, "empty", run).schema.simpleString() == "struct<a:string,b:array<int>>"
    assert read_run(spark, path, "empty").count() == 0
    with pytest.raises(LookupError):
        read_run(spark, path, "other")
    with pytest.raises(LookupError):
        read_run(spark, path, "empty", "no such run")
