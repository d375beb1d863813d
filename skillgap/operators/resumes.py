"""Candidates: their skills from a text or a list, the resume gate, and matching to the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skillgap import catalog
from skillgap.catalog import SKILLS, SkillCatalog
from skillgap.functions.coverage import string_array
from skillgap.functions.numbers import any_of
from skillgap.functions.text import extract_skills, fold_case, hinted, resolve_skill, strip
from skillgap.operators.browse import newest_first, recommended
from skillgap.sources.scratch import materialize

_MIN_RESUME_CHARS = 80
_MIN_SECTIONS = 2
_MIN_RESUME_SKILLS = 2


def resolve_skills(names: DataFrame, skills: SkillCatalog = SKILLS) -> DataFrame:
    """Adds ``canonical`` to a table with a ``name`` column; null where unknown."""
    return names.withColumn("canonical", resolve_skill(F.col("name"), skills))


def candidate_skills(
    df: DataFrame, skills: SkillCatalog = SKILLS, max_text: int | None = None, max_skills: int | None = None
) -> DataFrame:
    """(candidate_id, skills, ignored, status) from exactly one of resume_text and skills.

    Longer texts than ``max_text`` and lists than ``max_skills`` are refused, if given.

    The status says what was wrong instead of raising, so one bad row does not
    stop a table of candidates.
    """
    text, typed = F.col("resume_text"), F.col("skills")
    pairs = F.transform(
        F.array_compact(typed), lambda s: F.struct(s.alias("typed"), resolve_skill(s, skills).alias("canonical"))
    )
    too_long = F.lit(False) if max_text is None else F.coalesce(F.length(text) > max_text, F.lit(False))
    parsed = df.select(
        "candidate_id",
        text.isNotNull().alias("has_text"),
        typed.isNotNull().alias("has_list"),
        too_long.alias("long_text"),
        (F.lit(False) if max_skills is None else F.size(typed) > max_skills).alias("long_list"),
        F.when(text.isNotNull() & ~too_long, extract_skills(text, skills)).alias("from_text"),
        pairs.alias("pairs"),
    )
    known = F.filter("pairs", lambda p: p["canonical"].isNotNull())
    from_list = F.array_distinct(F.transform(known, lambda p: p["canonical"]))
    unknown = F.transform(F.filter("pairs", lambda p: p["canonical"].isNull()), lambda p: p["typed"])
    found = F.when(F.col("has_text"), F.col("from_text")).otherwise(from_list)
    status = (
        F.when(F.col("has_text") == F.col("has_list"), "provide_one")
        .when(F.col("long_text"), "text_too_long")
        .when(F.col("long_list"), "too_many_skills")
        .when(F.size(found) == 0, "no_recognized_skills")
        .otherwise("ok")
    )
    empty = F.array().cast("array<string>")
    return parsed.withColumn("status", status).select(
        "candidate_id",
        F.when(F.col("status") == "ok", found).otherwise(empty).alias("skills"),
        F.when((F.col("status") == "ok") & F.col("has_list"), unknown).otherwise(empty).alias("ignored"),
        "status",
    )


def _word_hints(pattern: str) -> list[str]:
    """The last word of each alternative, if all are plain words; else nothing."""
    body = pattern.removeprefix(r"\b(").removesuffix(r")\b")
    words = [alternative.split(r"\s+")[-1] for alternative in body.split("|")]
    return words if all(w.isalpha() for w in words) else []


def _family(pattern: str) -> str:
    """SQL for a family of words in ``_text``, looked for in ``_folded``."""
    return hinted("(?U)" + pattern, "_folded", _word_hints(pattern), "_folded")


def resume_gate(df: DataFrame, skills: SkillCatalog = SKILLS) -> DataFrame:
    """(id, accepted, reason, skills, char_count): is this text a technical resume?

    The checks stand in one CASE, so a text that fails an early one is not
    searched for the patterns of a later one.
    """
    sections = " + ".join(f"CAST({_family(p)} AS INT)" for p in catalog.RESUME_SECTIONS)
    email, phone = ("(?U)" + p for p in catalog.RESUME_IDENTIFIERS_EXACT_CASE)
    identified = any_of(
        [_family(p) for p in reversed(catalog.RESUME_IDENTIFIERS)]
        + [hinted(email, "_text", ["@"], "_text"), hinted(phone, "_text", [], "_text")]
    )
    reason = f"""CASE
        WHEN char_count < {_MIN_RESUME_CHARS} THEN 'no_extractable_text'
        WHEN sections < {_MIN_SECTIONS} THEN 'not_resume_structure'
        WHEN NOT {identified} THEN 'no_identifiers'
        WHEN size(skills) < {_MIN_RESUME_SKILLS} THEN 'too_few_skills'
    END"""
    return (
        df.select("id", strip(F.coalesce("text", F.lit(""))).alias("_text"))
        .withColumn("_folded", fold_case(F.col("_text")))
        .withColumns(
            {
                "char_count": F.length("_text"),
                "sections": F.expr(sections),
                "skills": extract_skills(F.col("_text"), skills, F.col("_folded")),
            }
        )
        .withColumn("reason", F.expr(reason))
        .select("id", F.col("reason").isNull().alias("accepted"), "reason", "skills", "char_count")
    )


def match_summary(text_df: DataFrame, skills: SkillCatalog = SKILLS) -> DataFrame:
    """(matched_skills, missing_skills, match_score_percentage) for each row's ``text``."""
    names = string_array(skills.names)
    held = extract_skills(F.col("text"), skills)
    count = F.size("matched_skills")
    score = F.floor(count / len(skills.names) * 100).cast("int")
    return (
        text_df.withColumn("matched_skills", held)
        .withColumn("missing_skills", F.slice(F.array_except(names, F.col("matched_skills")), 1, 8))
        .withColumn("match_score_percentage", F.least(score * 2, F.lit(100)))
    )


def match_resume(
    df: DataFrame, text: str, skills: SkillCatalog = SKILLS, limit: int = 6
) -> tuple[DataFrame, DataFrame]:
    """(summary, recommended postings) for one resume text; nothing is recommended for no skill."""
    one = df.sparkSession.range(1).select(F.lit(text).alias("text"))
    summary = match_summary(one, skills).drop("text")
    return summary, recommended(df, summary.select("matched_skills").scalar(), limit)


_SHOWN_POSTING = ["job_id", "title", "company_name", "location", "via", "apply_link", "salary", "schedule_type"]


def newest_per_skill(df: DataFrame, skills: SkillCatalog = SKILLS, limit: int = 6) -> DataFrame:
    """(skill, place, posting): the newest postings whose description mentions each skill, ``limit`` a skill at most.

    Spark keeps the first ``limit`` rows of a skill in each task before the shuffle. ``place`` numbers all postings found, newest first.
    """
    lowered = F.lower("description")
    named = F.transform(
        F.array(lowered), lambda text: F.filter(string_array(skills.names), lambda s: text.contains(F.lower(s)))
    )
    found = df.select(*_SHOWN_POSTING, "scraped_at", F.explode(F.coalesce(F.element_at(named, 1), F.array().cast("array<string>"))).alias("skill"))
    newest = Window.partitionBy("skill").orderBy(*newest_first())
    kept = found.withColumn("rn", F.row_number().over(newest)).where(F.col("rn") <= limit)
    # At most the catalog's names times the limit are left.
    place = F.dense_rank().over(Window.partitionBy().orderBy(*newest_first()))
    return kept.withColumn("place", place).select("skill", "place", F.struct(*_SHOWN_POSTING).alias("posting"))


def match_resumes(
    df: DataFrame, resumes: DataFrame, skills: SkillCatalog = SKILLS, limit: int = 6, key: str = "candidate_id"
) -> DataFrame:
    """``resumes`` (``key``, ``text``) with their summary and ``recommended`` postings, newest first.

    The newest postings that mention any of a candidate's skills are among the newest of each single skill. So the postings are
    read once for any number of candidates, and what every task of the candidates gets is the newest few of each
    skill: the catalog's names times ``limit`` at most. Candidates and postings are never joined.
    """
    best = materialize(newest_per_skill(df, skills, limit), "newest")
    places = best.groupBy("skill").agg(F.array_sort(F.collect_list("place")).alias("places"))
    by_skill = places.agg(F.map_from_entries(F.collect_list(F.struct("skill", "places")))).scalar()
    by_place = best.groupBy("place").agg(F.any_value("posting").alias("posting")).agg(
        F.map_from_entries(F.collect_list(F.struct("place", "posting")))
    ).scalar()
    summary = match_summary(resumes.select(key, "text"), skills).drop("text")
    none = F.array().cast("array<int>")
    own = F.flatten(F.transform("matched_skills", lambda s: F.coalesce(F.try_element_at(F.col("_by_skill"), s), none)))
    chosen = F.slice(F.array_sort(F.array_distinct(own)), 1, limit)
    shown = F.transform(chosen, lambda p: F.try_element_at(F.col("_by_place"), p))
    return (
        summary.withColumns({"_by_skill": by_skill, "_by_place": by_place})
        .withColumn("recommended", F.coalesce(shown, F.array()))
        .drop("_by_skill", "_by_place")
    )
