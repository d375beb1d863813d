"""Whole text files, one row per file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skillgap.sources.snapshots import path_below


def read_resumes(spark: SparkSession, path: str) -> DataFrame:
    """(id, text): the file's path below ``path``, and its whole content."""
    return spark.read.text(path, wholetext=True).select(path_below(path).alias("id"), F.col("value").alias("text"))
