"""Which one skill lifts the most postings over the coverage threshold, and what next.

For a posting with distinct skills S (n of them, m of them held) and threshold
T: it is matched if 100*m >= T*n, and unlocked by a missing skill of S if it is
not matched but 100*(m+1) >= T*n.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skillgap.catalog import ROLES, RoleCatalog
from skillgap.functions.coverage import distinct_list, is_matched, one_away, percent, string_array
from skillgap.operators.params import check_bounds
from skillgap.schema import column_or_null


def eligible(
    df: DataFrame,
    held: Sequence[str],
    min_skills: int = 3,
    location_type: str | None = None,
    role: str | None = None,
    max_age_days: int | None = None,
    roles: RoleCatalog = ROLES,
) -> DataFrame:
    """Postings with enough distinct skills, with their skill count n and held count m.

    All of ``df`` is kept beside ``skills``, ``n`` and ``m``; the optimizer
    prunes what the query on top does not use.
    """
    check_bounds(min_skills=min_skills, max_age_days=max_age_days)
    if location_type:
        df = df.where(F.col("location_type") == location_type)
    if max_age_days is not None and "posted_days_ago" in df.columns:
        df = df.where(F.col("posted_days_ago") <= max_age_days)
    if role:
        df = df.where(F.col("title").rlike(roles.regex(role)))
    skills = distinct_list(F.col("skills_required"))
    return (
        df.withColumn("skills", skills)
        .where(F.size("skills") >= min_skills)
        .withColumn("n", F.size("skills"))
        .withColumn("m", F.size(F.array_intersect("skills", string_array(held))))
    )


def baseline(elig: DataFrame, threshold: int = 60) -> DataFrame:
    return elig.agg(
        F.count("*").alias("eligible_jobs"),
        F.count_if(is_matched(F.col("m"), F.col("n"), threshold)).alias("matched_jobs"),
    )


def salary_benchmark(elig: DataFrame, threshold: int = 60) -> DataFrame:
    """Disclosed pay among matched postings against the ceiling over all eligible ones."""
    matched = is_matched(F.col("m"), F.col("n"), threshold)
    low, high = column_or_null(elig, "salary_min_lpa"), column_or_null(elig, "salary_max_lpa")
    found = elig.select(matched.alias("matched"), low.alias("low"), high.alias("high")).agg(
        F.count(F.when(F.col("matched"), F.col("low"))).alias("disclosed_count"),
        F.min(F.when(F.col("matched"), F.col("low"))).alias("matched_min_lpa"),
        F.max(F.when(F.col("matched"), F.col("high"))).alias("matched_max_lpa"),
        F.max("high").alias("unlocked_max_lpa"),
    )
    rounded = found.select(
        "disclosed_count",
        *[F.round(c, 1).alias(c) for c in ("matched_min_lpa", "matched_max_lpa", "unlocked_max_lpa")],
    )
    floor, ceiling = F.col("matched_max_lpa"), F.col("unlocked_max_lpa")
    boost = F.bround((ceiling - floor) / floor * 100, 0).cast("int")
    return rounded.withColumn("ceiling_boost_pct", F.when((floor > 0) & (ceiling > floor), boost))


def ranking() -> list[Column]:
    """Most unlocks, then most demand, then name."""
    return [F.desc("unlocks"), F.desc("demand"), F.asc("skill")]


def _missing(held: Sequence[str]) -> Column:
    return F.array_except("skills", string_array(held))


def _skill_counts(elig: DataFrame, held: Sequence[str], threshold: int) -> DataFrame:
    """(skill, unlocks, demand) for each missing skill.

    Only one flag and one name per missing skill leave the scan, and they are
    counted before the shuffle, so a skill in a third of all postings costs no
    more than any other.
    """
    near = one_away(F.col("m"), F.col("n"), threshold).alias("near")
    return (
        elig.select(near, F.explode(_missing(held)).alias("skill"))
        .groupBy("skill")
        .agg(F.count_if("near").alias("unlocks"), F.count("*").alias("demand"))
    )


def unlocks(elig: DataFrame, held: Sequence[str], threshold: int = 60, top_n: int | None = None) -> DataFrame:
    """(skill, unlocks, demand) for each skill that unlocks anything; the first ``top_n`` if given."""
    check_bounds(threshold=threshold, top_n=top_n)
    counted = _skill_counts(elig, held, threshold).where("unlocks > 0")
    return counted if top_n is None else counted.orderBy(*ranking()).limit(top_n)


def unlock_examples(elig: DataFrame, top_skills: DataFrame, threshold: int = 60, per_skill: int = 3) -> DataFrame:
    """The closest postings each skill of ``top_skills`` would unlock.

    Spark keeps only the first few rows per skill in each task before the
    shuffle, and broadcasts a short ranking by itself.
    """
    m, n = F.col("m"), F.col("n")
    near = elig.where(one_away(m, n, threshold)).select(
        F.explode("skills").alias("skill"),
        "job_id",
        "title",
        "company_name",
        percent(m, n).cast("int").alias("match_before"),
        percent(m + 1, n).cast("int").alias("match_after"),
    )
    closest = Window.partitionBy("skill").orderBy(F.desc("match_before"), F.asc("job_id"))
    return (
        near.join(top_skills.select("skill"), "skill", "left_semi")
        .withColumn("rn", F.row_number().over(closest))
        .where(F.col("rn") <= per_skill)
    )


def attach_examples(top_skills: DataFrame, examples: DataFrame) -> DataFrame:
    """The ranking with its examples as a list; both sides have at most 25 skills."""
    fields = ["job_id", "title", "company_name", "match_before", "match_after"]
    lists = examples.groupBy("skill").agg(
        F.array_sort(F.collect_list(F.struct("rn", *fields))).alias("ranked")
    )
    return top_skills.join(lists, "skill", "left").select(
        "skill",
        "unlocks",
        "demand",
        F.coalesce(
            F.transform("ranked", lambda r: F.struct(*[r[f].alias(f) for f in fields])), F.array()
        ).alias("example_jobs"),
    )


def unlock_path(elig: DataFrame, held: Sequence[str], threshold: int = 60, steps: int = 3) -> DataFrame:
    """(step, skill, unlocks, cumulative_gain): the best skill, then the best after it, and so on.

    One lazy plan over two passes of the eligible postings. The first counts
    unlocks and demand per skill; it gives the first step, and demand does not
    change later. The second keeps postings that lack at most ``steps`` skills
    to their threshold, counted by (missing skills, gap); every later step reads
    that one shuffle. Each choice enters the next step as a scalar subquery.
    """
    check_bounds(threshold=threshold)
    counts = _skill_counts(elig, held, threshold)
    # Reading the unlock count as well lets Spark reuse the shuffle of the first step.
    demand = counts.where("unlocks >= 0").select("skill", "demand")
    gap = F.call_function("div", F.col("n") * threshold + 99, F.lit(100)) - F.col("m")
    near = (
        elig.select(gap.cast("int").alias("gap"), F.array_sort(_missing(held)).alias("missing"))
        .where(F.col("gap").between(1, steps))
        .groupBy("missing", "gap")
        .agg(F.count("*").alias("postings"))
    )

    def best(ranked: DataFrame, chosen: Column) -> Column:
        pick = F.struct("skill", "unlocks", chosen.alias("chosen"))
        return ranked.orderBy(*ranking()).limit(1).select(pick).scalar()

    picks = [best(counts.where("unlocks > 0"), F.array("skill"))]
    while len(picks) < steps:
        # No filter that Spark could push below the shared shuffle: it would differ from step to step.
        gains = (
            near.withColumn("chosen", picks[-1]["chosen"])
            .select(
                F.when(F.col("gap") - F.size(F.array_intersect("missing", "chosen")) == 1, F.col("postings"))
                .alias("unlocked"),
                "chosen",
                F.explode_outer(F.array_except("missing", "chosen")).alias("skill"),
            )
            .groupBy("skill")
            .agg(F.sum("unlocked").alias("unlocks"), F.any_value("chosen").alias("chosen"))
            .where("unlocks > 0")
        )
        picks.append(best(gains.join(demand, "skill"), F.array_append("chosen", F.col("skill"))))

    names = [f"pick{i}" for i in range(1, steps + 1)]
    rows, running = [], F.lit(0).cast("long")
    for number, name in enumerate(names, start=1):
        running = running + F.col(f"{name}.unlocks")
        rows.append(
            F.struct(
                F.lit(number).alias("step"),
                F.col(f"{name}.skill").alias("skill"),
                F.col(f"{name}.unlocks").alias("unlocks"),
                running.alias("cumulative_gain"),
            )
        )
    return (
        elig.sparkSession.range(1)
        .select(*[p.alias(n) for p, n in zip(picks, names)])
        .select(F.inline(F.array(*rows)))
        .where(F.col("skill").isNotNull())
    )


def projected_matches(base: DataFrame, path: DataFrame) -> DataFrame:
    """Matched now and after each step of the path, with each step's share of the eligible postings."""
    total = base.select(F.greatest("eligible_jobs", F.lit(1))).scalar()
    matched = base.select("matched_jobs").scalar()
    now = base.select(
        F.lit(0).alias("step"),
        F.lit("NOW").alias("skill"),
        F.col("matched_jobs").alias("jobs"),
        F.least(F.lit(100.0), F.col("matched_jobs") / F.greatest("eligible_jobs", F.lit(1)) * 100).alias("share_pct"),
    )
    later = path.select(
        "step",
        "skill",
        (matched + F.col("cumulative_gain")).alias("jobs"),
        F.least(F.lit(100.0), F.col("unlocks") / total * 100).alias("share_pct"),
    )
    return now.unionByName(later)
