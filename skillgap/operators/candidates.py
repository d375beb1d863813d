"""Coverage and unlocks for a whole table of candidates.

Postings are reduced to their distinct skill sets with a count, candidates to their distinct
held sets, and the two meet by a set-containment join: a posting of n skills matters to a candidate who
lacks at most one to its threshold, so who holds ``need`` = ceil(T * n / 100) - 1 of them or more. With
skills in one order, rarest first, such a candidate holds one of the posting's first
``n - need + 1``; only these are met with the held skills. Counts are all that leaves the join: matched
postings per held set, and unlocks per held set and missing skill.

What is met still grows with the number of distinct sets on both sides that share a skill: a skill that
most sets have among their first is compared with every held set that has it. It is no join of
candidates with postings, but for tables of many different candidates it is the dearest way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skillgap.functions.coverage import distinct_list, is_matched, one_away
from skillgap.operators.params import check_bounds
from skillgap.sources.scratch import materialize


def _met(postings: DataFrame, candidates: DataFrame, threshold: int, min_skills: int) -> tuple[DataFrame, DataFrame]:
    """(held_set, m, n, postings, missing) for sets within one skill of the threshold; candidates with their ``held_set``."""
    check_bounds(threshold=threshold, min_skills=min_skills)
    if -(-threshold * min_skills // 100) < 2:
        raise ValueError(f"a posting of {min_skills} skills at {threshold} percent can match who holds none of them")
    own = F.array_sort(distinct_list(F.col("skills_required")))
    sets = materialize(
        postings.select(own.alias("skills")).where(F.size("skills") >= min_skills).groupBy("skills").agg(F.count("*").alias("postings"))
        .withColumn("posting_set", F.monotonically_increasing_id()),
        "posting-sets",
    )
    held = F.array_sort(distinct_list(F.coalesce("skills", F.array().cast("array<string>"))))
    known = candidates.select("candidate_id", held.alias("held"))
    groups = materialize(known.groupBy("held").agg(F.count("*").alias("_n")).drop("_n").withColumn("held_set", F.monotonically_increasing_id()), "held-sets")
    each = sets.select("posting_set", F.size("skills").alias("n"), F.explode("skills").alias("skill"))
    # One row per skill: how many sets have it.
    common = each.groupBy("skill").agg(F.count("*").alias("sets"))
    ordered = each.join(common, "skill").groupBy("posting_set", "n").agg(F.array_sort(F.collect_list(F.struct("sets", "skill"))).alias("ordered"))
    need = F.call_function("div", F.col("n") * threshold + 99, F.lit(100)) - 1
    first = ordered.select("posting_set", F.explode(F.slice("ordered", 1, (F.col("n") - need + 1).cast("int"))).alias("at")).select("posting_set", "at.skill")
    pairs = first.join(groups.select("held_set", F.explode("held").alias("skill")), "skill").select("posting_set", "held_set").distinct()
    both = pairs.join(sets, "posting_set").join(groups, "held_set").select(
        "held_set", "postings", F.size("skills").alias("n"), F.size(F.array_intersect("skills", "held")).alias("m"),
        F.array_except("skills", "held").alias("missing"),
    )
    return both.where((F.col("m") + 1) * 100 >= F.col("n") * threshold), known.join(groups, "held")


def matched_for(postings: DataFrame, candidates: DataFrame, threshold: int = 60, min_skills: int = 3) -> DataFrame:
    """(candidate_id, matched_jobs) for each row of ``candidates`` (candidate_id, skills)."""
    met, known = _met(postings, candidates, threshold, min_skills)
    counted = met.where(is_matched(F.col("m"), F.col("n"), threshold)).groupBy("held_set").agg(F.sum("postings").alias("matched_jobs"))
    return known.join(counted, "held_set", "left").select("candidate_id", F.coalesce("matched_jobs", F.lit(0)).alias("matched_jobs"))


def unlocks_for(postings: DataFrame, candidates: DataFrame, threshold: int = 60, min_skills: int = 3) -> DataFrame:
    """(candidate_id, skill, unlocks) for each skill that unlocks anything for a candidate."""
    met, known = _met(postings, candidates, threshold, min_skills)
    near = met.where(one_away(F.col("m"), F.col("n"), threshold)).select("held_set", "postings", F.explode("missing").alias("skill"))
    counted = near.groupBy("held_set", "skill").agg(F.sum("postings").alias("unlocks"))
    return known.join(counted, "held_set").select("candidate_id", "skill", "unlocks")
