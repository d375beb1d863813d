"""CSV and JSON files of a filtered page of postings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skillgap.catalog import EMPTY_EXPORT_MESSAGE
from skillgap.operators.browse import browse
from skillgap.operators.params import check_bounds


def export_rows(df: DataFrame, limit: int | None = 500, **filters) -> DataFrame:
    """The rows an export holds: newest first, at most ``limit`` (None: all)."""
    check_bounds(limit=limit)
    return browse(df, limit=limit, **filters)


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text; CSV takes no arrays."""
    nested = (T.ArrayType, T.StructType, T.MapType)
    return df.select(
        *[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in df.schema.fields]
    )


def export_csv(df: DataFrame, path: str) -> None:
    """With a header; a table without rows becomes one message row."""
    spark = df.sparkSession
    writer = flat(df).write.option("header", True).option("quoteAll", False).option("escape", '"')
    # Blanks at the ends of a text are part of it.
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    # What was written tells whether there were rows; the plan runs once.
    if spark.read.option("header", True).csv(path).isEmpty():
        message = spark.createDataFrame([(EMPTY_EXPORT_MESSAGE,)], "message string")
        message.write.mode("overwrite").option("header", True).csv(path)


def export_json(df: DataFrame, path: str, compression: str = "none") -> None:
    """A JSON object a line; a whole table is best written with ``gzip``, its field names repeat in every line."""
    df.write.option("ignoreNullFields", False).json(path, compression=compression)
