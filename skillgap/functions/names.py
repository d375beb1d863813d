"""Skills found in text for catalogs of any length: all plain names in one pass.

A plain name is matched word by word with any white space between and no letter, digit or
one of ``_ # +`` beside it. One automaton over all plain names goes through a text once, in Arrow
batches, however many names there are; names with patterns of their own stay with the
expressions of ``functions.text``. The results are those of ``extract_skills`` and
``count_mentions``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skillgap.catalog import SkillCatalog
from skillgap.functions.text import combined_text, count_mentions, extract_skills, fold_case

_SPACES = re.compile(r"\s+")
_INSIDE = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_#+")
_UPPER = {c: c + 32 for c in range(65, 91)}


def plain_names(skills: SkillCatalog) -> list[str]:
    """Names that are matched as they are written."""
    return [n for n in skills.names if n not in skills.aliases and not skills.is_acronym(n)]


def special_names(skills: SkillCatalog) -> SkillCatalog:
    """The catalog of the names that have patterns of their own."""
    names = [n for n in skills.names if n in skills.aliases or skills.is_acronym(n)]
    return SkillCatalog.of(names, skills.aliases, skills.long_forms, skills.hints)


class NameFinder:
    """An automaton over plain names."""

    def __init__(self, names: tuple[str, ...]):
        import ahocorasick

        self._automaton = ahocorasick.Automaton()
        by_form: dict[str, list[int]] = {}
        for i, name in enumerate(names):
            by_form.setdefault(_SPACES.sub(" ", name.translate(_UPPER)), []).append(i)
        for form, numbers in by_form.items():
            if form:
                self._automaton.add_word(form, (len(form), numbers))
        self._empty = not len(self._automaton)
        if not self._empty:
            self._automaton.make_automaton()

    def counts(self, folded: str | None) -> dict[int, int]:
        """Occurrences of each name found, none of which overlaps the one before it of the same name."""
        if not folded or self._empty:
            return {}
        text = _SPACES.sub(" ", folded)
        n = len(text)
        found: dict[int, int] = {}
        ends: dict[int, int] = {}
        for last, (length, numbers) in self._automaton.iter(text):
            first, after = last - length + 1, last + 1
            if (first and text[first - 1] in _INSIDE) or (after < n and text[after] in _INSIDE):
                continue
            if ends.get(numbers[0], 0) > first:
                continue
            ends[numbers[0]] = after
            for i in numbers:
                found[i] = found.get(i, 0) + 1
        return found


_finders: dict[tuple[str, ...], NameFinder] = {}


def _finder(names: tuple[str, ...]) -> NameFinder:
    """The finder of this worker."""
    if names not in _finders:
        _finders.clear()
        _finders[names] = NameFinder(names)
    return _finders[names]


def _found(names: tuple[str, ...]):
    @F.pandas_udf("array<string>")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        finder = _finder(names)
        for texts in batches:
            yield pd.Series([[names[i] for i in finder.counts(t)] for t in texts])

    return find


def _counted(names: tuple[str, ...]):
    @F.pandas_udf("array<struct<skill: string, n: bigint>>")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        finder = _finder(names)
        for texts in batches:
            yield pd.Series([[{"skill": names[i], "n": n} for i, n in finder.counts(t).items()] for t in texts])

    return count


def extract_names(text: Column, skills: SkillCatalog) -> Column:
    """Sorted canonical skills found in a text, as ``extract_skills``; for catalogs of thousands of names."""
    own = _found(tuple(plain_names(skills)))(fold_case(text))
    special = special_names(skills)
    if not special.names:
        return F.array_sort(F.coalesce(own, F.array().cast("array<string>")))
    return F.array_sort(F.concat(F.coalesce(own, F.array().cast("array<string>")), extract_skills(text, special)))


def mention_totals(df: DataFrame, skills: SkillCatalog) -> DataFrame:
    """(skill, count) as ``mention_counts``; only what a text mentions leaves its row."""
    text = combined_text(F.col("title"), F.col("description"), F.lit(None).cast("string"))
    special = special_names(skills)
    items = [_counted(tuple(plain_names(skills)))(fold_case(F.col("_text")))]
    if special.names:
        counts = count_mentions(F.col("_text"), special)
        names = F.array(*[F.lit(n) for n in special.names])
        items.append(F.zip_with(names, counts, lambda s, n: F.struct(s.alias("skill"), n.cast("bigint").alias("n"))))
    found = df.select(text.alias("_text")).select(F.concat(*items).alias("_items")).select(F.inline("_items")).where("n > 0")
    totals = found.groupBy("skill").agg(F.sum("n").alias("count"))
    order = df.sparkSession.createDataFrame([(n, i) for i, n in enumerate(skills.names)], "skill string, place int")
    return totals.join(order, "skill").orderBy(F.desc("count"), "place").drop("place")
