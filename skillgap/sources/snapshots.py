"""Posting snapshots: one JSON object per file, read in path and array order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.readwriter import DataFrameReader
from pyspark.sql.streaming.readwriter import DataStreamReader

from skillgap import catalog
from skillgap.functions.text import empty_to_null
from skillgap.operators.merge import ARRIVAL
from skillgap.schema import SNAPSHOT_FILE


def _reader(reader: DataFrameReader | DataStreamReader):
    return (
        reader.schema(SNAPSHOT_FILE)
        .option("multiLine", True)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt_record")
        .option("pathGlobFilter", "*.json")
    )


def path_below(path: str):
    """A file's path below the folder that is read."""
    whole = F.col("_metadata.file_path")
    root = path.rstrip("/").rpartition(":")[2]
    return F.regexp_replace(F.substring_index(whole, root + "/", -1) if root else whole, "^/+", "")


def explode_files(files: DataFrame, path: str) -> DataFrame:
    """One row per posting, stamped with its file's capture time, phrase and region.

    Arrival is by path below ``path``, then place in the file: file names may
    repeat in folders. A file that is not readable JSON gives no rows (see
    ``rejected_files``); the others go on.
    """
    postings = F.when(F.size("jobs") > 0, F.col("jobs")).otherwise(F.col("jobs_results"))
    return (
        files.where(F.col("_corrupt_record").isNull())
        .select(
            path_below(path).alias("file_name"),
            "captured_at",
            F.coalesce("query_params.q", F.lit("")).alias("source_query"),
            F.coalesce("query_params.gl", F.lit(catalog.DEFAULT_REGION)).alias("source_gl"),
            F.posexplode(postings).alias("position", "posting"),
        )
        .where(F.col("posting").isNotNull())
        .select(
            F.struct("file_name", "position").alias(ARRIVAL),
            empty_to_null(F.col("captured_at")).alias("captured_at"),
            "source_query",
            "source_gl",
            "posting.*",
        )
    )


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    return explode_files(_reader(spark.read).json(path), path)


def rejected_files(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, content) of the files under ``path`` that are not readable JSON."""
    whole = _reader(spark.read).json(path)
    # Spark reads the corrupt column only together with others: a row that is not corrupt has one of these.
    read = F.coalesce("slug", "captured_at", F.to_json("query_params"), F.to_json("jobs"), F.to_json("jobs_results")).isNotNull()
    content = F.when(~read, F.col("_corrupt_record"))
    return whole.select(path_below(path).alias("file_name"), content.alias("content")).where("content IS NOT NULL")


def stream_snapshots(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    return explode_files(_reader(spark.readStream).option("maxFilesPerTrigger", files_per_batch).json(path), path)
