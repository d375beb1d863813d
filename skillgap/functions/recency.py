"""How old a posting is, and how that is shown."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from skillgap import catalog
from skillgap.functions.numbers import ascii_digits
from skillgap.functions.text import empty_to_null, strip


def moment(when: dt.datetime) -> Column:
    """A naive UTC instant as a literal, whatever the zone of this process."""
    return F.lit(when.isoformat(sep=" ")).cast("timestamp_ntz")


def _any_contains(c: Column, words: list[str]) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | c.contains(w)
    return hit


def pick_posted_at(detected: Column, extensions: Column) -> Column:
    """The detected posting time, else the first extension that is one, else empty."""
    def is_time(e: Column) -> Column:
        lowered = F.lower(e)
        hit = lowered.isin(*catalog.RELATIVE_TIME_WORDS)
        for p in catalog.POSTED_AT_PATTERNS:
            hit = hit | lowered.rlike("(?U)" + p)
        return e.isNotNull() & hit

    times = F.filter(F.transform(extensions, strip), is_time)
    return F.coalesce(empty_to_null(strip(detected)), F.try_element_at(times, F.lit(1)), F.lit(""))


# Days per unit, in the order in which units are looked for.
_UNIT_DAYS = [("day", 1), ("week", 7), ("month", 30), ("year", 365)]


def age_days(posted_at: Column) -> Column:
    """Days since posting from a relative time, or null."""
    lowered = ascii_digits(F.lower(strip(posted_at)))
    days = F.when(_any_contains(lowered, ["hour", "minute", "today", "just now"]), F.lit(0).cast("long")).when(
        lowered.contains("yesterday"), F.lit(1).cast("long")
    )
    for unit, per_unit in _UNIT_DAYS:
        pattern = rf"(?U)(\d+)\s+{unit}"
        count = F.regexp_extract(lowered, pattern, 1).try_cast("long")
        days = days.when(lowered.rlike(pattern), count * per_unit)
    return days.try_cast("int")


def parse_instant(c: Column) -> Column:
    """ISO-8601 text as naive UTC; null if it cannot be read. Naive text is UTC."""
    text = strip(c)
    with_offset = text.rlike(r"(Z|[T ].*[+-]\d{2}:?\d{2})$")
    zoned = text.try_cast("timestamp").cast("timestamp_ntz")
    return F.when(with_offset, F.convert_timezone(F.current_timezone(), F.lit("UTC"), zoned)).otherwise(
        text.try_cast("timestamp_ntz")
    )


def age_fallback(captured_at: Column, now: dt.datetime) -> Column:
    """Whole 24-hour periods since capture, at least 0; 0 if the capture time is unreadable."""
    elapsed = F.timestamp_diff("SECOND", parse_instant(captured_at), moment(now))
    periods = F.greatest(F.lit(0), F.floor(elapsed / 86400))
    return F.when(empty_to_null(captured_at).isNotNull(), F.coalesce(periods, F.lit(0))).cast("int")


def fresh_label(days: Column, raw: Column) -> Column:
    return (
        F.when(days == 0, "Today")
        .when(days <= 1, "1d ago")
        .when(days <= 7, F.concat(days.cast("string"), F.lit("d ago")))
        .when(days <= 30, F.concat(F.round(days / 7).cast("int").cast("string"), F.lit("w ago")))
        .when(days.isNotNull(), F.concat(F.round(days / 30).cast("int").cast("string"), F.lit("mo ago")))
        .otherwise(empty_to_null(raw))
    )


def fresh_class(days: Column, raw: Column) -> Column:
    return (
        F.when(days <= 7, "fresh")
        .when(days <= 30, "recent")
        .when(days.isNotNull(), "stale")
        .when(empty_to_null(raw).isNotNull(), "recent")
    )
