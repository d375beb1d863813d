"""Market figures kept up to date from what a merge changes.

A posting adds to counts per (kind, value): one of each skill, one of its company,
and so on. A merge takes away what the touched rows added before and adds what they add
now, so the counts are those of the whole table without reading it, deletions
and changed values included. The figures are read from the counts alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skillgap.functions.postings import platform_name
from skillgap.operators.market import discloses_salary, says_remote

#: A value may be null, as in a posting without a company.
KEPT = T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("value", T.StringType()), T.StructField("n", T.LongType()),
])


def contributions(rows: DataFrame, sign: int) -> DataFrame:
    """(kind, value, n) that postings add to the counts, or take away with sign -1."""
    one = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("value"))
    if_so = lambda kind, when: F.when(F.coalesce(when, F.lit(False)), one(kind, F.lit("")))
    each = lambda kind, values: F.coalesce(F.transform(values, lambda v: one(kind, v)), F.array())
    own = F.array_compact(F.array(
        one("posting", F.lit("")),
        if_so("remote", says_remote(F.col("work_from_home"), F.col("location"))),
        if_so("salary", discloses_salary(F.col("salary"))),
        if_so("snapshot", F.col("is_snapshot")),
        one("company", F.col("company_name")),
        one("platform", platform_name(F.col("via"))),
        one("site", F.coalesce("via_platform", F.lit("Direct / Portal"))),
        F.when(F.col("salary_raw").isNotNull(), one("site_salary", F.coalesce("via_platform", F.lit("Direct / Portal")))),
        one("arrangement", F.col("location_type")),
        F.when(F.col("scraped_at").isNotNull(), one("captured", F.col("scraped_at"))),
    ))
    items = F.concat(own, each("skill", F.col("skills_required")), each("phrase", F.col("source_queries")))
    # Summed here, so that a value in a third of all rows leaves each task once.
    return rows.select(F.inline(items)).groupBy("kind", "value").agg((F.count("*") * sign).alias("n"))


def updated(counts: DataFrame, changed: DataFrame) -> DataFrame:
    """The counts with changes added; values that nothing has any more go."""
    both = counts.unionByName(changed.select("kind", "value", "n"))
    return both.groupBy("kind", "value").agg(F.sum("n").alias("n")).where("n <> 0")


def _of(counts: DataFrame, kind: str) -> DataFrame:
    return counts.where(F.col("kind") == kind)


def kept_counters(counts: DataFrame) -> DataFrame:
    """As ``market.corpus_counters``."""
    total = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0))
    found = counts.where(F.col("kind").isin("posting", "remote", "salary")).agg(
        total("posting").alias("total_jobs"), total("remote").alias("remote_jobs"), total("salary").alias("salary_disclosed_jobs")
    )
    return found.select(
        "total_jobs", "remote_jobs", F.greatest(F.lit(0), F.col("total_jobs") - F.col("remote_jobs")).alias("on_site_jobs"),
        "salary_disclosed_jobs",
    )


def _top(counts: DataFrame, kind: str, name: str, limit: int) -> DataFrame:
    ranked = _of(counts, kind).orderBy(F.desc("n"), F.asc_nulls_last("value")).limit(limit)
    return ranked.select(F.col("value").alias(name), F.col("n").alias("count"))


def kept_top_skills(counts: DataFrame, limit: int = 12) -> DataFrame:
    return _top(counts, "skill", "skill", limit)


def kept_top_companies(counts: DataFrame, limit: int = 8) -> DataFrame:
    return _top(counts, "company", "company_name", limit)


def kept_top_platforms(counts: DataFrame, limit: int = 6) -> DataFrame:
    return _top(counts, "platform", "platform", limit)


def kept_platform_disclosure(counts: DataFrame, limit: int = 10) -> DataFrame:
    """As ``market.platform_disclosure``."""
    by_site = counts.where(F.col("kind").isin("site", "site_salary")).groupBy(F.col("value").alias("platform")).agg(
        F.sum(F.when(F.col("kind") == "site", F.col("n"))).alias("openings"),
        F.coalesce(F.sum(F.when(F.col("kind") == "site_salary", F.col("n"))), F.lit(0)).alias("stated"),
    )
    share: Column = F.round(F.col("stated") * 100.0 / F.col("openings"), 1)
    return by_site.orderBy(F.desc("openings"), F.asc("platform")).limit(limit).select("platform", "openings", share.alias("salary_disclosure_pct"))


def kept_arrangements(counts: DataFrame) -> DataFrame:
    """(location_type, total_jobs)."""
    return _of(counts, "arrangement").select(F.col("value").alias("location_type"), F.col("n").alias("total_jobs"))


def kept_corpus(counts: DataFrame) -> DataFrame:
    """(jobs, as_of_min, as_of_max, snapshot_share, distinct_queries) as in ``market.corpus_stats``."""
    total = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0))
    at = F.when(F.col("kind") == "captured", F.col("value").cast("timestamp_ntz"))
    found = counts.agg(
        total("posting").alias("jobs"), F.min(at).alias("as_of_min"), F.max(at).alias("as_of_max"), total("snapshot").alias("snapshots"),
        F.count(F.when(F.col("kind") == "phrase", F.col("value"))).alias("distinct_queries"),
    )
    share = F.coalesce(F.round(F.col("snapshots") / F.nullif("jobs", F.lit(0)), 4), F.lit(0.0))
    return found.select("jobs", "as_of_min", "as_of_max", share.alias("snapshot_share"), "distinct_queries")
