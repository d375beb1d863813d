"""Raw postings into incoming rows of the postings table."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skillgap import catalog
from skillgap.catalog import SKILLS, SkillCatalog
from skillgap.functions import postings as P
from skillgap.functions.recency import age_days, age_fallback, moment, parse_instant, pick_posted_at
from skillgap.functions.salary import clean_salary, pick_salary, salary_lpa
from skillgap.functions.text import canonical_id, combined_text, empty_to_null, extract_skills
from skillgap.operators.merge import ARRIVAL
from skillgap.schema import POSTING, column_or_null


#: Marks rows whose ``job_id`` is the content hash already.
CONTENT_ID = "content_id"


def normalize_postings(
    raw: DataFrame,
    now: dt.datetime,
    default_location: str | None = None,
    cap: int | None = None,
) -> DataFrame:
    """Upstream posting records as incoming rows, before the skills are extracted.

    ``raw`` has the raw posting fields and may have ``captured_at``,
    ``source_query``, ``source_gl`` and ``arrival``. ``default_location`` is
    the searched place of a live fetch; ``cap`` the number of results wanted
    of each fetch, that is of each phrase and region.
    """
    present = set(raw.columns)
    if cap is not None:
        fetch = [F.col(c) for c in ("source_query", "source_gl") if c in present] or [F.lit(1)]
        place = F.row_number().over(Window.partitionBy(*fetch).orderBy(ARRIVAL))
        raw = raw.withColumn("_place", place).where(F.col("_place") <= cap).drop("_place")
    captured = F.col("captured_at") if "captured_at" in present else F.lit(None).cast("string")
    phrase = F.col("source_query") if "source_query" in present else F.lit(None).cast("string")
    region = F.col("source_gl") if "source_gl" in present else F.lit(None).cast("string")
    detected = F.col("detected_extensions")
    location = F.coalesce("location", F.lit(default_location or ""))
    searched = F.coalesce(empty_to_null(F.col("location")), F.lit(default_location or ""))
    pay = pick_salary(detected["salary"], F.col("salary"), F.col("extensions"))
    posted = pick_posted_at(detected["posted_at"], F.col("extensions"))
    wfh = P.remote_flag(detected["work_from_home"], F.col("extensions"), searched)
    title = F.coalesce("title", F.lit(catalog.DEFAULT_TITLE))
    company = F.coalesce("company_name", F.lit(catalog.DEFAULT_COMPANY))
    description = F.coalesce("description", F.lit(""))
    passed_on = [ARRIVAL] if ARRIVAL in present else []
    return (
        raw.withColumns({"_pay": pay, "_posted": posted, "_remote": wfh})
        .withColumn("_lpa", salary_lpa(F.col("_pay")))
        .select(
            canonical_id(title, company, location, description).alias("job_id"),
            F.lit(True).alias(CONTENT_ID),
            F.col("job_id").alias("source_token"),
            title.alias("title"),
            company.alias("company_name"),
            location.alias("location"),
            F.coalesce("via", F.lit(catalog.DEFAULT_VIA)).alias("via"),
            description.alias("description"),
            F.coalesce(detected["schedule_type"], F.lit(catalog.DEFAULT_SCHEDULE)).alias("schedule_type"),
            F.col("_remote").alias("work_from_home"),
            F.when(F.col("_remote"), "Remote").otherwise("On-site").alias("location_type"),
            F.col("_pay").alias("salary"),
            F.col("_pay").alias("salary_raw"),
            F.col("_lpa.min").alias("salary_min_lpa"),
            F.col("_lpa.max").alias("salary_max_lpa"),
            P.apply_link(F.col("apply_link"), F.col("apply_options")).alias("apply_link"),
            F.coalesce("apply_options", F.array().cast(POSTING["apply_options"].dataType)).alias("apply_options"),
            P.portal_count(F.col("apply_options")).alias("portal_count"),
            F.col("_posted").alias("posted_at"),
            F.coalesce(age_days(F.col("_posted")), age_fallback(captured, now)).alias("posted_days_ago"),
            captured.alias("captured_at"),
            phrase.alias("source_query"),
            F.when(empty_to_null(phrase).isNotNull(), F.array(phrase))
            .otherwise(F.array().cast("array<string>"))
            .alias("source_queries"),
            region.alias("source_gl"),
            P.highlights_text(F.col("job_highlights")).alias("highlights_text"),
            *passed_on,
        )
    )


def prepare_batch(
    raw: DataFrame,
    now: dt.datetime,
    source_query: str | None = None,
    region: str | None = None,
    is_snapshot: bool = False,
    skills: SkillCatalog = SKILLS,
) -> DataFrame:
    """Incoming rows in the full posting shape, with ``arrival`` kept for the merge."""
    def given(name: str) -> Column:
        return column_or_null(raw, name)

    def extra(name: str, kind: str = "string") -> Column:
        return F.col(name) if name in raw.columns else F.lit(None).cast(kind)

    base = raw.select(
        *[given(f.name).alias(f.name) for f in POSTING.fields],
        extra("captured_at").alias("captured_at"),
        extra("extensions", "array<string>").alias("extensions"),
        extra("highlights_text").alias("highlights_text"),
        F.col(ARRIVAL),
    ).withColumns(P.with_defaults())
    # Normalised postings bring the hash of their content along; it is not taken again.
    ident = F.col("job_id") if CONTENT_ID in raw.columns else P.choose_id(F.col("source_token"), F.col("job_id"))

    raw_pay = clean_salary(F.coalesce(empty_to_null(F.col("salary_raw")), clean_salary(F.col("salary"))))
    remote = P.remote_flag(F.col("work_from_home"), F.col("extensions"), F.col("location"))
    # Named once below: the skill patterns each read it.
    text = combined_text(F.col("title"), F.col("description"), F.col("highlights_text"))
    phrase = F.coalesce(empty_to_null(F.col("source_query")), F.lit(source_query or ""))
    place = F.coalesce(
        empty_to_null(F.col("location_type")), F.when(F.col("_remote"), "Remote").otherwise("On-site")
    )
    unparsed = F.col("_pay").isNotNull() & F.col("salary_min_lpa").isNull() & F.col("salary_max_lpa").isNull()
    options = F.coalesce("apply_options", F.array().cast(POSTING["apply_options"].dataType))

    values = {
        "job_id": ident,
        "source_token": empty_to_null(F.col("source_token")),
        "salary": F.col("_pay"),
        "salary_raw": F.col("_pay"),
        "salary_min_lpa": F.when(unparsed, F.col("_lpa.min")).otherwise(F.col("salary_min_lpa")),
        "salary_max_lpa": F.when(unparsed, F.col("_lpa.max")).otherwise(F.col("salary_max_lpa")),
        "location_type": place,
        "work_from_home": F.col("_remote") | (place == "Remote"),
        "skills_required": F.when(F.size("skills_required") > 0, F.col("skills_required")).otherwise(
            extract_skills(F.col("_text"), skills)
        ),
        "apply_options": options,
        "apply_link": P.apply_link(F.col("apply_link"), options),
        "portal_count": F.coalesce("portal_count", F.greatest(F.lit(1), F.size(options))),
        "source_query": phrase,
        "source_queries": F.when(
            F.col("source_queries").isNull(),
            F.when(phrase != "", F.array(phrase)).otherwise(F.array().cast("array<string>")),
        ).otherwise(P.source_list(F.col("source_queries"), phrase)),
        "source_gl": F.coalesce(
            empty_to_null(F.col("source_gl")), F.lit(region or catalog.DEFAULT_REGION)
        ),
        "via_platform": F.coalesce(empty_to_null(F.col("via_platform")), F.col("via")),
        "scraped_at": F.coalesce("scraped_at", parse_instant(F.col("captured_at")), moment(now)),
        "is_snapshot": F.coalesce("is_snapshot", F.lit(is_snapshot)),
    }
    return (
        base.withColumns({"_pay": raw_pay, "_remote": remote, "_text": text})
        .withColumn("_lpa", salary_lpa(F.col("_pay")))
        .select(
            *[values.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in POSTING.fields],
            F.col(ARRIVAL),
        )
    )
