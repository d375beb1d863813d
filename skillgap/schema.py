"""Table shapes, and bringing older or narrower tables into them."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skillgap import catalog
from skillgap.functions.recency import moment

APPLY_OPTION = T.StructType([T.StructField("title", T.StringType()), T.StructField("link", T.StringType())])
APPLY_OPTIONS = T.ArrayType(APPLY_OPTION)
STRINGS = T.ArrayType(T.StringType())


def _fields(*pairs) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in pairs])


POSTING = _fields(
    ("job_id", T.StringType()),
    ("title", T.StringType()),
    ("company_name", T.StringType()),
    ("location", T.StringType()),
    ("via", T.StringType()),
    ("description", T.StringType()),
    ("schedule_type", T.StringType()),
    ("work_from_home", T.BooleanType()),
    ("salary", T.StringType()),
    ("apply_link", T.StringType()),
    ("posted_at", T.StringType()),
    ("scraped_at", T.TimestampNTZType()),
    ("via_platform", T.StringType()),
    ("salary_raw", T.StringType()),
    ("location_type", T.StringType()),
    ("skills_required", STRINGS),
    ("apply_options", APPLY_OPTIONS),
    ("portal_count", T.IntegerType()),
    ("salary_min_lpa", T.DoubleType()),
    ("salary_max_lpa", T.DoubleType()),
    ("source_query", T.StringType()),
    ("source_gl", T.StringType()),
    ("is_snapshot", T.BooleanType()),
    ("source_token", T.StringType()),
    ("source_queries", STRINGS),
    ("posted_days_ago", T.IntegerType()),
)

SEARCH_CACHE = _fields(
    ("cache_key", T.StringType()),
    ("query", T.StringType()),
    ("location", T.StringType()),
    ("gl", T.StringType()),
    ("hl", T.StringType()),
    ("date_posted", T.StringType()),
    ("response_json", T.StringType()),
    ("fetched_at", T.TimestampNTZType()),
)

RAW_POSTING = _fields(
    ("job_id", T.StringType()),
    ("title", T.StringType()),
    ("company_name", T.StringType()),
    ("location", T.StringType()),
    ("via", T.StringType()),
    ("description", T.StringType()),
    ("extensions", STRINGS),
    ("apply_options", APPLY_OPTIONS),
    ("salary", T.StringType()),
    ("apply_link", T.StringType()),
    (
        "detected_extensions",
        _fields(
            ("posted_at", T.StringType()),
            ("salary", T.StringType()),
            ("schedule_type", T.StringType()),
            ("work_from_home", T.BooleanType()),
        ),
    ),
    ("job_highlights", T.ArrayType(_fields(("title", T.StringType()), ("items", STRINGS)))),
)

SNAPSHOT_FILE = _fields(
    ("slug", T.StringType()),
    ("captured_at", T.StringType()),
    ("query_params", _fields(("q", T.StringType()), ("location", T.StringType()), ("gl", T.StringType()), ("hl", T.StringType()))),
    ("jobs", T.ArrayType(RAW_POSTING)),
    ("jobs_results", T.ArrayType(RAW_POSTING)),
    ("_corrupt_record", T.StringType()),
)

# Values given to a column the table did not have before.
_ADDED_DEFAULTS = {"portal_count": 1, "is_snapshot": False}


def column_or_null(df: DataFrame, name: str) -> Column:
    """The column, or a typed null where a narrower table lacks it."""
    if name in df.columns:
        return F.col(name)
    return F.lit(None).cast(POSTING[name].dataType).alias(name)


def conform_schema(df: DataFrame) -> DataFrame:
    """Any older postings table in the current 26-column shape; repeatable."""
    columns = []
    for f in POSTING.fields:
        if f.name in df.columns:
            present = df.schema[f.name].dataType
            if f.name == "apply_options" and isinstance(present, T.StringType):
                columns.append(F.from_json(f.name, APPLY_OPTIONS).alias(f.name))
            else:
                columns.append(F.col(f.name).cast(f.dataType).alias(f.name))
        else:
            columns.append(F.lit(_ADDED_DEFAULTS.get(f.name)).cast(f.dataType).alias(f.name))
    return df.select(*columns)


def _leaked_into_salary(c: Column) -> Column:
    lowered = F.lower(F.trim(c))
    return F.coalesce(
        lowered.rlike(catalog.RELATIVE_TIME_PATTERN)
        | lowered.isin(*catalog.RELATIVE_TIME_WORDS)
        | (lowered == ""),
        F.lit(False),
    )


def backfill(df: DataFrame, now: dt.datetime) -> DataFrame:
    """Fill phrases and age on older rows and clear times that leaked into the salary."""
    leaked = _leaked_into_salary(F.col("salary_raw")) | _leaked_into_salary(F.col("salary"))
    days = F.datediff(moment(now).cast("date"), F.col("scraped_at").cast("date"))
    return df.withColumns(
        {
            "source_queries": F.when(
                F.col("source_queries").isNull() & F.col("source_query").isNotNull(), F.array("source_query")
            ).otherwise(F.col("source_queries")),
            "salary_raw": F.when(~leaked, F.col("salary_raw")),
            "salary": F.when(~leaked, F.col("salary")),
            "posted_days_ago": F.coalesce("posted_days_ago", F.greatest(F.lit(0), days), F.lit(0)).cast("int"),
        }
    )


def stringify(df: DataFrame) -> DataFrame:
    """Every cell as text, null as the empty string."""
    def cell(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)):
            c = F.to_json(c)
        return F.coalesce(c.cast("string"), F.lit("")).alias(f.name)

    return df.select(*[cell(f) for f in df.schema.fields])

