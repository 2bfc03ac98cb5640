"""Several outputs that become visible together (SNK-2, SNK-3 and reports of one run).

Outputs are written below a folder of their run; one small file that names the
run is put in place when all of them are whole. Readers go by that file alone, so
a job that dies between two outputs leaves the state before it, and its folder
is never read. Folders of runs that were not committed may be deleted at any time.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_COMMIT = "run string, at bigint, outputs array<struct<name: string, schema: string>>"


def write_run(outputs: dict[str, DataFrame], path: str, partition_by: dict[str, list[str]] | None = None) -> str:
    """Write all ``outputs`` as Parquet and commit them as one; returns the run's name.

    ``partition_by`` lays an output out by columns. Spark's own commit makes each output
    whole; a task that is run again leaves no rows twice. Of two runs at once, both are
    written, and readers see the one that was committed last.
    """
    if not outputs:
        raise ValueError("a run has at least one output")
    run = uuid.uuid4().hex
    for name, df in outputs.items():
        df.write.partitionBy(*(partition_by or {}).get(name, [])).parquet(f"{path}/runs/{run}/{name}")
    spark = next(iter(outputs.values())).sparkSession
    described = [(name, df.schema.json()) for name, df in outputs.items()]
    spark.createDataFrame([(run, time.time_ns(), described)], _COMMIT).coalesce(1).write.mode("append").json(f"{path}/commits")
    return run


def committed_runs(spark: SparkSession, path: str) -> DataFrame:
    """``run, at, outputs`` of every committed run; no rows where there is none."""
    try:
        return spark.read.schema(_COMMIT).json(f"{path}/commits")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], _COMMIT)


def read_run(spark: SparkSession, path: str, name: str, run: str | None = None) -> DataFrame:
    """An output of the run committed last, or of ``run``; an error if that is not committed or has no such output.

    One row of the commits comes to the driver, not their list.
    """
    runs = committed_runs(spark, path)
    if run is not None:
        runs = runs.filter(F.col("run") == run)
    last = runs.orderBy(F.desc("at"), "run").limit(1).select("run", F.filter("outputs", lambda o: o["name"] == name).alias("found")).collect()
    if not last or not last[0]["found"]:
        raise LookupError(f"no committed output {name!r} below {path}")
    schema = StructType.fromJson(json.loads(last[0]["found"][0]["schema"]))
    return spark.read.schema(schema).parquet(f"{path}/runs/{last[0]['run']}/{name}").select(schema.names)


def write_scored_run(scored: DataFrame, path: str, reports: dict[str, DataFrame] | None = None, flag: str = "is_correct") -> str:
    """SNK-2 and SNK-3 in one commit: every row once, as output ``scored``, laid out by verdict; ``reports`` beside it.

    A missing verdict counts as wrong. The verified rows and the errors are each a folder of ``scored``.
    """
    rows = scored.withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))
    return write_run({"scored": rows, **(reports or {})}, path, {"scored": [flag]})


def read_errors(spark: SparkSession, path: str, run: str | None = None, flag: str = "is_correct") -> DataFrame:
    """SNK-3: rows of the committed run with a wrong or missing prediction; the other folder is not read."""
    return read_run(spark, path, "scored", run).filter(~F.col(flag))
