"""The reports a caller asks for, as named DataFrames over one postings table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skillgap.catalog import ROLES, SKILLS, RoleCatalog, SkillCatalog
from skillgap.operators import market, unlock
from skillgap.operators.params import check_bounds
from skillgap.schema import column_or_null
from skillgap.sources.scratch import materialize


@dataclass(frozen=True)
class UnlockReport:
    baseline: DataFrame
    salary_benchmark: DataFrame
    unlocks: DataFrame
    all_unlocks_count: DataFrame
    path: DataFrame
    projected: DataFrame
    corpus: DataFrame


def unlock_report(
    df: DataFrame,
    held: Sequence[str],
    threshold: int = 60,
    min_skills: int = 3,
    location_type: str | None = None,
    role: str | None = None,
    top_n: int = 10,
    max_age_days: int | None = None,
    roles: RoleCatalog = ROLES,
) -> UnlockReport:
    """Everything about one candidate.

    The eligible postings are found once and staged as a narrow table (see
    ``scratch_scope``) that all parts share; ``df`` is read once more for the
    corpus figures.
    """
    check_bounds(threshold=threshold, top_n=top_n)
    found = unlock.eligible(df, held, min_skills, location_type, role, max_age_days, roles)
    pay = [column_or_null(df, c).alias(c) for c in ("salary_min_lpa", "salary_max_lpa")]
    elig = materialize(found.select("job_id", "title", "company_name", "skills", "n", "m", *pay), "eligible")
    base = unlock.baseline(elig, threshold)
    # One row per skill; the list, its examples and the count of all read it.
    ranking = materialize(unlock.unlocks(elig, held, threshold), "unlocks")
    top = ranking.orderBy(*unlock.ranking()).limit(top_n)
    path = materialize(unlock.unlock_path(elig, held, threshold), "path")
    return UnlockReport(
        baseline=base,
        salary_benchmark=unlock.salary_benchmark(elig, threshold),
        unlocks=unlock.attach_examples(top, unlock.unlock_examples(elig, top, threshold)).orderBy(*unlock.ranking()),
        all_unlocks_count=ranking.agg(F.count("*").alias("all_unlocks_count")),
        path=path,
        projected=unlock.projected_matches(base, path),
        corpus=market.corpus_stats(df),
    )


@dataclass(frozen=True)
class MarketReport:
    counters: DataFrame
    top_skills: DataFrame
    top_companies: DataFrame
    top_platforms: DataFrame


def market_report(df: DataFrame, skills: SkillCatalog = SKILLS) -> MarketReport:
    """Analytics over the table; skills are counted in the texts if none are stored.

    The stored ranking, twelve rows at most, is found here; the rest is lazy.
    """
    stored = market.top_skills(df)
    rows = stored.collect()
    return MarketReport(
        counters=market.corpus_counters(df),
        top_skills=df.sparkSession.createDataFrame(rows, stored.schema) if rows else market.mention_counts(df, skills).limit(12),
        top_companies=market.top_companies(df),
        top_platforms=market.top_platforms(df),
    )


def _shown(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def as_rows(parts: dict[str, tuple[DataFrame, Column | str | None, dict[str, Column]]]) -> DataFrame:
    """(part, key, value) rows of several small tables.

    Each part is a table, what names its rows, and its values by name; the
    rows' keys are ``name`` or ``row/name``.
    """
    out = None
    for part, (df, row, values) in parts.items():
        lead = F.lit("") if row is None else F.concat(_shown(F.col(row) if isinstance(row, str) else row), F.lit("/"))
        pairs = [F.struct(F.concat(lead, F.lit(n)).alias("key"), _shown(c).alias("value")) for n, c in values.items()]
        rows = df.select(F.inline(F.array(*pairs))).select(F.lit(part).alias("part"), "key", "value")
        out = rows if out is None else out.unionByName(rows)
    return out
