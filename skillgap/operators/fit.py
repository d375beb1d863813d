"""How well each eligible posting fits one candidate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skillgap.catalog import ROLES, RoleCatalog
from skillgap.functions.coverage import fit_status, matched_missing, percent
from skillgap.functions.postings import rank_portals, role_class
from skillgap.functions.text import empty_to_null, snippet
from skillgap.operators.params import check_bounds
from skillgap.operators.unlock import eligible
from skillgap.schema import column_or_null


def job_fit(
    df: DataFrame,
    held: Sequence[str],
    threshold: int = 60,
    min_skills: int = 3,
    location_type: str | None = None,
    role: str | None = None,
    limit: int | None = 500,
    max_age_days: int | None = None,
    roles: RoleCatalog = ROLES,
) -> DataFrame:
    """The ``limit`` best-fitting postings (None: all), by match percentage, title and id.

    The ranking runs on what it needs; the portal sort, the snippet and the
    rest are done for the rows that remain (a projection above the top-k).
    """
    check_bounds(threshold=threshold, limit=limit)
    elig = eligible(df, held, min_skills, location_type, role, max_age_days, roles)
    m, n = F.col("m"), F.col("n")
    source = elig.select(
        "job_id", "title", "company_name",
        *[column_or_null(df, c) for c in (
            "location", "location_type", "portal_count", "salary", "apply_link",
            "apply_options", "posted_at", "description", "posted_days_ago",
        )],
        "skills", "n", "m",
        percent(m, n).cast("int").alias("match_pct"),
    )
    best = source.orderBy(F.desc("match_pct"), F.asc_nulls_last("title"), F.asc_nulls_last("job_id"))
    if limit is not None:
        best = best.limit(limit)
    matched, missing = matched_missing(F.col("skills"), held)
    options = F.col("apply_options")
    return best.select(
        "job_id", "title", "company_name",
        F.coalesce("location", F.lit("")).alias("location"),
        F.coalesce(empty_to_null(F.col("location_type")), F.lit("On-site")).alias("location_type"),
        F.coalesce(F.nullif("portal_count", F.lit(0)), F.lit(1)).alias("portal_count"),
        "match_pct",
        matched.alias("matched"),
        missing.alias("missing"),
        role_class(F.col("title"), roles).alias("role"),
        fit_status(m, n, threshold).alias("status"),
        "salary", "apply_link",
        F.when(F.size(options) > 1, rank_portals(options)).otherwise(options).alias("apply_options"),
        "posted_at",
        F.coalesce(snippet(F.col("description")), F.lit("")).alias("description_snippet"),
        "posted_days_ago",
    )
