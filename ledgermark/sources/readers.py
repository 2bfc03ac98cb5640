"""Reading corpora and result shards (SRC-1..4)."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgermark.schemas import COMPLETION_CHOICES


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC-1: files that each hold one JSON array of objects.

    Such a file is read by one task, so parallelism is the number of files;
    ``json_arrays.read_large_json_array`` reads large ones by blocks.
    """
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_jsonl_tree(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC-2: every line of every file below ``path``, with its place in the shard order.

    Adds ``file_path``, ``block_start`` and ``line_id``: sorting by the three
    gives file order, then line order. Files stay splittable: a task reads one
    block of a file from front to back, so an increasing id ranks the lines of
    a block, and the block's offset ranks the blocks. A line that is not JSON
    keeps its text in ``_corrupt_record``. A missing path gives no rows.
    """
    fields = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    with_bad = T.StructType([*fields.fields, T.StructField("_corrupt_record", T.StringType())])
    try:
        lines = spark.read.option("recursiveFileLookup", True).text(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        place = "file_path string, block_start bigint, line_id bigint"
        empty = T.StructType([*with_bad.fields, *T._parse_datatype_string(place).fields])
        return spark.createDataFrame([], empty)
    return (
        lines.select(
            "value",
            F.col("_metadata.file_path").alias("file_path"),
            F.col("_metadata.file_block_start").alias("block_start"),
            F.monotonically_increasing_id().alias("line_id"),
        )
        .filter(F.trim("value") != "")
        .select(
            F.from_json("value", with_bad, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("_r"),
            "file_path",
            "block_start",
            "line_id",
        )
        .select("_r.*", "file_path", "block_start", "line_id")
    )


SHARD_ORDER = ["file_path", "block_start", "line_id"]


def explode_choices(responses: DataFrame) -> DataFrame:
    """One row per sample of each model response; chat and plain responses alike."""
    return responses.select("id", F.posexplode("choices").alias("sample_idx", "c")).select(
        "id",
        "sample_idx",
        F.coalesce("c.message.content", "c.text").alias("text"),
        F.col("c.logprobs.token_logprobs").alias("token_logprobs"),
    )


def load_completions(spark: SparkSession, path: str) -> DataFrame:
    """SRC-3: ``id, sample_idx, text, token_logprobs`` from stored responses, one per line."""
    return explode_choices(spark.read.schema(COMPLETION_CHOICES).option("recursiveFileLookup", True).json(path))


def resume_from(df: DataFrame, start: int, pos: str = "pos") -> DataFrame:
    """SRC-4: rows from a start position on; ``joins.without_done`` resumes by id instead."""
    return df.filter(F.col(pos) >= start)
