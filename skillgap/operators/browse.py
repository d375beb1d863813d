"""Filtered, totally ordered pages of postings."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skillgap.functions.recency import moment
from skillgap.operators.market import discloses_salary
from skillgap.operators.params import check_bounds, check_dates
from skillgap.schema import POSTING

_NO_ESCAPE = "\u0001"  # so that a backslash in a keyword is an ordinary character


def contains_text(c: Column, text: str) -> Column:
    """Case-insensitive LIKE %text%; percent and underscore in the text stay wildcards."""
    return F.like(F.lower(c), F.lit(f"%{text.strip().lower()}%"), F.lit(_NO_ESCAPE))


def keyword(text: str) -> Column:
    return (
        contains_text(F.col("title"), text)
        | contains_text(F.col("description"), text)
        | contains_text(F.col("company_name"), text)
    )


def browse_location(kind: str) -> Column | None:
    """Arrangement as browsing sees it: by flag and by words in the text."""
    flag, location = F.col("work_from_home"), F.lower("location")
    match kind.strip().lower():
        case "remote":
            return flag | location.contains("remote")
        case "hybrid":
            return location.contains("hybrid") | F.lower("description").contains("hybrid")
        case "on-site":
            return ~flag & ~location.contains("remote") & ~location.contains("hybrid")
    return None


def any_skill_text(description: Column, names: Column) -> Column:
    """The description contains one of the names as a plain substring, inside words too.

    ``description`` is lowered once per row, not once per name.
    """
    held = F.transform(F.array(F.lower(description)), lambda text: F.exists(names, lambda s: text.contains(F.lower(s))))
    return F.element_at(held, 1)


_ORDERS = {"company": "company_name", "title": "title"}


def newest_first(first: str | None = None) -> list[Column]:
    lead = [F.asc_nulls_last(first)] if first else []
    return [*lead, F.desc_nulls_last("scraped_at"), F.asc_nulls_last("job_id")]


def filtered(
    df: DataFrame,
    text: str | None = None,
    location_type: str | None = None,
    company: str | None = None,
    has_salary: bool | None = None,
    from_date: str | None = None,
    to_date: str | None = None,
) -> DataFrame:
    check_dates(from_date, to_date)
    if text and text.strip():
        df = df.where(keyword(text))
    if location_type and location_type.strip():
        wanted = browse_location(location_type)
        df = df if wanted is None else df.where(wanted)
    if company and company.strip():
        df = df.where(contains_text(F.col("company_name"), company))
    if has_salary is True:
        df = df.where(discloses_salary(F.col("salary")))
    if from_date and from_date.strip():
        df = df.where(F.to_date("scraped_at") >= F.lit(from_date.strip()).cast("date"))
    if to_date and to_date.strip():
        df = df.where(F.to_date("scraped_at") <= F.lit(to_date.strip()).cast("date"))
    return df


def browse(
    df: DataFrame,
    text: str | None = None,
    location_type: str | None = None,
    company: str | None = None,
    has_salary: bool | None = None,
    from_date: str | None = None,
    to_date: str | None = None,
    sort_by: str = "newest",
    limit: int | None = 50,
    offset: int = 0,
) -> DataFrame:
    """One page, or all rows without a limit; the order is total, so pages never overlap."""
    check_bounds(limit=limit)
    chosen = filtered(df, text, location_type, company, has_salary, from_date, to_date)
    ordered = chosen.orderBy(*newest_first(_ORDERS.get(sort_by))).offset(max(0, offset))
    return ordered if limit is None else ordered.limit(limit)


def after_row(scraped_at: dt.datetime | None, job_id: str) -> Column:
    """Rows that come after a given one, newest first."""
    at, id_ = F.col("scraped_at"), F.col("job_id")
    later_id = (id_ > F.lit(job_id)) | id_.isNull()
    if scraped_at is None:
        return at.isNull() & later_id
    return (at < moment(scraped_at)) | ((at == moment(scraped_at)) & later_id) | at.isNull()


#: How a table of pages may be cut: the name of a period for Spark and for Python.
PERIODS = {"day": ("yyyy-MM-dd", "%Y-%m-%d"), "month": ("yyyy-MM", "%Y-%m")}


class Pages:
    """Postings laid out by the period they were found in, so that a page reads the periods it shows and no others.

    A page is asked for by the last row of the one before it, not by a number of rows to pass over. Periods are read
    newest first, in steps that double until the page is full; rows without a date come last. The period is a day, or a month
    for tables that span many years.
    """

    def __init__(self, spark: SparkSession, path: str, period: str = "day"):
        self.spark, self.path, self.period = spark, path.rstrip("/"), PERIODS[period]
        self._found: list[str] | None = None

    def write(self, df: DataFrame) -> None:
        """Replace the table; each period is sorted, newest first."""
        period = F.coalesce(F.date_format("scraped_at", self.period[0]), F.lit("none")).alias("period")
        rows = df.select("*", period).hint("rebalance", F.col("period"))
        rows.sortWithinPartitions("period", *newest_first()).write.mode("overwrite").partitionBy("period").parquet(self.path)
        self._found = None

    def periods(self) -> list[str]:
        """Periods that have rows, newest first; rows without a date are under the last, ``none``."""
        if self._found is None:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
            names = [s.getPath().getName() for s in path.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(path)]
            found = [n.removeprefix("period=") for n in names if n.startswith("period=")]
            self._found = sorted((d for d in found if d != "none"), reverse=True) + [d for d in found if d == "none"]
        return self._found

    def page(self, limit: int = 50, after: tuple[dt.datetime | None, str] | None = None, first_step: int = 4, **chosen) -> DataFrame:
        """The next ``limit`` rows after the row with (scraped_at, job_id), or the first; ``chosen`` as in ``filtered``."""
        check_bounds(limit=limit)
        periods = self.periods()
        if not periods:
            return self.spark.createDataFrame([], POSTING)
        if after is not None:
            last = "none" if after[0] is None else after[0].strftime(self.period[1])
            periods = [p for p in periods if p == "none" or (last != "none" and p <= last)]
        step = first_step
        while True:
            # The folders themselves are named, so that no others are listed.
            some = periods[:step] or self.periods()[-1:]
            rows = self.spark.read.parquet(*[f"{self.path}/period={p}" for p in some])
            rows = filtered(rows, **chosen) if after is None else filtered(rows, **chosen).where(after_row(*after))
            found = rows.orderBy(*newest_first()).limit(limit)
            # The row that fills the page tells that it is full; a page has few rows.
            if step >= len(periods) or found.count() == limit:
                return found
            step *= 2


def recommended(df: DataFrame, names: Column | Sequence[str], limit: int = 6) -> DataFrame:
    """The newest postings whose description mentions one of the skills."""
    wanted = names if isinstance(names, Column) else F.array(*[F.lit(n) for n in names])
    return (
        df.withColumn("_names", wanted)
        .where(any_skill_text(F.col("description"), F.col("_names")))
        .orderBy(*newest_first())
        .limit(limit)
        .select("job_id", "title", "company_name", "location", "via", "apply_link", "salary", "schedule_type")
    )
