"""Corpus-wide counts: roles, corpus shape, companies, platforms, skills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skillgap import catalog
from skillgap.catalog import ROLES, SKILLS, RoleCatalog, SkillCatalog
from skillgap.functions.coverage import distinct_list
from skillgap.functions.postings import platform_name, role_flags
from skillgap.functions.text import combined_text, count_mentions
from skillgap.schema import column_or_null

_ROLE_MIN_SKILLS = 3


def _unpivot(row: DataFrame, columns: list[str], key: str, value: str) -> DataFrame:
    """One wide row as one row per column, with its place in the list."""
    pairs = [F.struct(F.lit(i).alias("place"), F.lit(c).alias(key), F.col(f"`{c}`").alias(value)) for i, c in enumerate(columns)]
    return row.select(F.inline(F.array(*pairs)))


def role_summary(df: DataFrame, roles: RoleCatalog = ROLES) -> DataFrame:
    """(role, label, jobs) over eligible postings, and a last row for those matching no role."""
    flags = role_flags(F.col("title"), roles)
    none = F.lit(False)
    for flag in flags.values():
        none = none | flag
    counts = df.where(F.size(distinct_list(F.col("skills_required"))) >= _ROLE_MIN_SKILLS).agg(
        *[F.count_if(flag).alias(role) for role, flag in flags.items()],
        F.count_if(~none).alias("any_role_unmatched"),
    )
    names = [*flags, "any_role_unmatched"]
    labels = F.create_map(*[F.lit(x) for r in flags for x in (r, roles.labels.get(r, r))])
    return _unpivot(counts, names, "role", "jobs").select(
        "role", F.coalesce(F.try_element_at(labels, F.col("role")), F.lit("Unmatched")).alias("label"), "jobs"
    )


def distinct_queries(df: DataFrame) -> DataFrame:
    """Number of distinct source phrases."""
    return df.select(F.explode(column_or_null(df, "source_queries")).alias("phrase")).agg(
        F.count_distinct("phrase").alias("distinct_queries")
    )


def corpus_stats(df: DataFrame) -> DataFrame:
    """Size, capture range, snapshot share and phrase count of the table, in one row."""
    # One pass: counted by phrase first, a posting itself under the first of its phrases.
    own = df.select(
        F.coalesce(column_or_null(df, "is_snapshot"), F.lit(False)).alias("snapshot"),
        column_or_null(df, "scraped_at").alias("at"),
        F.posexplode_outer(column_or_null(df, "source_queries")).alias("place", "phrase"),
    )
    lead = F.coalesce("place", F.lit(0)) == 0
    by_phrase = own.groupBy("phrase").agg(
        F.count_if(lead).alias("jobs"), F.count_if(lead & F.col("snapshot")).alias("snapshots"),
        F.min("at").alias("lo"), F.max("at").alias("hi"),
    )
    share = F.sum("snapshots") / F.nullif(F.sum("jobs"), F.lit(0))
    return (
        by_phrase.agg(
            F.coalesce(F.sum("jobs"), F.lit(0)).alias("jobs"),
            F.min("lo").alias("as_of_min"),
            F.max("hi").alias("as_of_max"),
            F.coalesce(F.round(share, 4), F.lit(0.0)).alias("snapshot_share"),
            F.count("phrase").alias("distinct_queries"),
        )
        .withColumn(
            "sample_note",
            F.replace(F.lit(catalog.CORPUS_NOTE), F.lit("{n}"), F.col("distinct_queries").cast("string")),
        )
    )


def corpus_note(stats: DataFrame) -> DataFrame:
    """The sentence shown about the snapshot share, and the date the data is of."""
    share = F.col("snapshot_share")
    pct = F.floor(share * 100 + 0.5).cast("int")
    sentence = F.when(share >= 0.999, "All listings come from saved Google Jobs snapshots.").otherwise(
        F.concat(pct.cast("string"), F.lit("% of listings come from saved Google Jobs snapshots."))
    )
    return stats.select(sentence.alias("snapshot_sentence"), F.to_date("as_of_max").alias("as_of"))


def says_remote(df_flag: Column, location: Column) -> Column:
    """Remote as browsing and analytics see it: the flag, or the word in the location."""
    return F.coalesce(df_flag, F.lit(False)) | F.coalesce(F.lower(location).contains("remote"), F.lit(False))


def discloses_salary(salary: Column) -> Column:
    return salary.isNotNull() & (salary != "")


def corpus_counters(df: DataFrame) -> DataFrame:
    counts = df.agg(
        F.count("*").alias("total_jobs"),
        F.count_if(says_remote(F.col("work_from_home"), F.col("location"))).alias("remote_jobs"),
        F.count_if(discloses_salary(F.col("salary"))).alias("salary_disclosed_jobs"),
    )
    return counts.select(
        "total_jobs",
        "remote_jobs",
        F.greatest(F.lit(0), F.col("total_jobs") - F.col("remote_jobs")).alias("on_site_jobs"),
        "salary_disclosed_jobs",
    )


def indexed_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("indexed_jobs_count"))


def _top(df: DataFrame, key: str, limit: int, count: str = "count") -> DataFrame:
    counted = df.groupBy(key).agg(F.count("*").alias(count))
    return counted.orderBy(F.desc(count), F.asc_nulls_last(key)).limit(limit)


def top_companies(df: DataFrame, limit: int = 8) -> DataFrame:
    return _top(df, "company_name", limit)


def top_platforms(df: DataFrame, limit: int = 6) -> DataFrame:
    return _top(df.select(platform_name(F.col("via")).alias("platform")), "platform", limit)


def top_skills(df: DataFrame, limit: int = 12) -> DataFrame:
    return _top(df.select(F.explode("skills_required").alias("skill")), "skill", limit)


def skill_demand(df: DataFrame, limit: int = 10) -> DataFrame:
    """The unnested-skill console preset."""
    return _top(df.select(F.explode("skills_required").alias("skill")), "skill", limit, "demand_count")


def mention_counts(df: DataFrame, skills: SkillCatalog = SKILLS) -> DataFrame:
    """Occurrences of each skill over all titles and descriptions; catalog order breaks ties.

    Each row is counted by itself and the counts are summed, so the text is
    never joined into one value.
    """
    text = combined_text(F.col("title"), F.col("description"), F.lit(None).cast("string"))
    per_row = count_mentions(F.col("_text"), skills)
    names = list(skills.names)
    totals = (
        df.select(text.alias("_text"))
        .select(per_row.alias("_counts"))
        .agg(*[F.coalesce(F.sum(F.col("_counts")[i]), F.lit(0)).alias(n) for i, n in enumerate(names)])
    )
    return (
        _unpivot(totals, names, "skill", "count")
        .where("`count` > 0")
        .orderBy(F.desc("count"), "place")
        .drop("place")
    )


def platform_disclosure(df: DataFrame, limit: int = 10) -> DataFrame:
    """Openings per platform and the percentage of them that state a salary."""
    stated = F.when(F.col("salary_raw").isNotNull(), F.lit(100.0)).otherwise(F.lit(0.0))
    return (
        df.groupBy(F.coalesce("via_platform", F.lit("Direct / Portal")).alias("platform"))
        .agg(F.count("*").alias("openings"), F.round(F.avg(stated), 1).alias("salary_disclosure_pct"))
        .orderBy(F.desc("openings"), F.asc("platform"))
        .limit(limit)
    )


def arrangement_share(df: DataFrame) -> DataFrame:
    """Postings per arrangement and their share; the window runs over the few counted rows."""
    counted = df.groupBy("location_type").agg(F.count("*").alias("total_jobs"))
    total = F.sum("total_jobs").over(Window.partitionBy())
    return counted.withColumn("share_percentage", F.round(F.col("total_jobs") * 100.0 / total, 1))


def snapshot_watermark(df: DataFrame) -> DataFrame:
    return df.where("is_snapshot").agg(
        F.count("*").alias("snapshot_rows"), F.max("scraped_at").alias("latest_capture")
    )
