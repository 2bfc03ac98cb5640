"""Writing results (SNK-1..4)."""

from __future__ import annotations

import logging

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_json(df: DataFrame, path: str) -> bool:
    """SNK-1: JSON lines at ``path``; False instead of an error when the write fails."""
    try:
        df.write.mode("overwrite").json(path)
        return True
    except PySparkException as error:
        logging.getLogger(__name__).error("could not write %s: %s", path, error)
        return False


def write_scored_split(df: DataFrame, path: str, flag: str = "is_correct") -> None:
    """SNK-2: all rows in one pass, laid out so that the verified ones are a folder of their own."""
    df.withColumn(flag, F.coalesce(F.col(flag), F.lit(False))).write.mode("overwrite").partitionBy(flag).json(path)


def write_errors(df: DataFrame, path: str, flag: str = "is_correct") -> None:
    """SNK-3: rows with a wrong or missing prediction."""
    df.filter(~F.coalesce(F.col(flag), F.lit(False))).write.mode("overwrite").json(path)


def write_predictions(df: DataFrame, path: str, key: str = "uid", payload: tuple[str, ...] = ("pred", "pred_scale")) -> None:
    """SNK-4: the prediction payload by id."""
    df.select(key, *payload).write.mode("overwrite").json(path)
