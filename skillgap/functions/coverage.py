"""Set coverage of a posting's skills by a candidate's, in integers only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def string_array(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def distinct_list(c: Column) -> Column:
    """Distinct values without nulls; a null list stays null."""
    return F.array_distinct(F.array_compact(c))


def intersect_list(a: Column, b: Column) -> Column:
    return F.array_intersect(F.array_compact(a), F.array_compact(b))


def except_list(a: Column, b: Column) -> Column:
    return F.array_except(F.array_compact(a), F.array_compact(b))


def ordered_union(a: Column, b: Column) -> Column:
    """Values of both lists in the order first seen."""
    return F.array_distinct(F.concat(F.array_compact(a), F.array_compact(b)))


def sorted_union(a: Column, b: Column) -> Column:
    empty = F.array().cast("array<string>")
    return F.array_sort(F.array_union(F.array_compact(F.coalesce(a, empty)), F.array_compact(F.coalesce(b, empty))))


def matched_missing(skills: Column, held: Sequence[str]) -> tuple[Column, Column]:
    r = string_array(held)
    return F.array_sort(F.array_intersect(skills, r)), F.array_sort(F.array_except(skills, r))


def is_matched(m: Column, n: Column, threshold: int) -> Column:
    return m * 100 >= n * threshold


def one_away(m: Column, n: Column, threshold: int) -> Column:
    """Not covered yet, but covered with one more skill."""
    return (m * 100 < n * threshold) & ((m + 1) * 100 >= n * threshold)


def percent(part: Column, whole: Column) -> Column:
    """Whole percent, rounded down."""
    return F.call_function("div", part * 100, whole)


def fit_status(m: Column, n: Column, threshold: int) -> Column:
    return (
        F.when(is_matched(m, n, threshold), "matched")
        .when(is_matched(m + 1, n, threshold), "one_skill_away")
        .otherwise("further")
    )
