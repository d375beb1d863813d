"""Columns of one posting: arrangement, portals, phrases, role, platform."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skillgap import catalog
from skillgap.catalog import RoleCatalog
from skillgap.functions.text import canonical_id, empty_to_null, strip


def with_defaults() -> dict[str, Column]:
    """Posting fields with the value they take when the source lacks them."""
    return {
        "title": F.coalesce("title", F.lit(catalog.DEFAULT_TITLE)),
        "company_name": F.coalesce("company_name", F.lit(catalog.DEFAULT_COMPANY)),
        "location": F.coalesce("location", F.lit("")),
        "description": F.coalesce("description", F.lit("")),
        "via": F.coalesce("via", F.lit(catalog.DEFAULT_VIA)),
        "schedule_type": F.coalesce("schedule_type", F.lit(catalog.DEFAULT_SCHEDULE)),
        "posted_at": F.coalesce("posted_at", F.lit("")),
    }


def choose_id(token: Column, given: Column) -> Column:
    """Key of an incoming posting: content hash under a source token, else its own id."""
    content = canonical_id(F.col("title"), F.col("company_name"), F.col("location"), F.col("description"))
    return F.when(empty_to_null(token).isNotNull(), content).otherwise(F.coalesce(empty_to_null(given), content))


def remote_flag(detected: Column, extensions: Column, location: Column) -> Column:
    lowered = F.lower(location)
    tagged = F.exists(extensions, lambda e: F.lower(e).contains("work from home"))
    return (
        F.coalesce(detected, F.lit(False))
        | F.coalesce(tagged, F.lit(False))
        | F.coalesce(lowered.contains("remote") | lowered.contains("anywhere"), F.lit(False))
    )


def highlights_text(highlights: Column) -> Column:
    items = F.transform(highlights, lambda h: F.coalesce(h["items"], F.array().cast("array<string>")))
    return F.coalesce(F.array_join(F.flatten(items), " "), F.lit(""))


def first_link(options: Column) -> Column:
    return F.try_element_at(options, F.lit(1))["link"]


def apply_link(own: Column, options: Column) -> Column:
    """Own link, else the first option's; empty when there are no options."""
    return F.coalesce(
        empty_to_null(own), F.when(F.coalesce(F.size(options), F.lit(0)) > 0, first_link(options)).otherwise(F.lit(""))
    )


def portal_count(options: Column) -> Column:
    """Distinct portals among the options, 1 when there are none."""
    targets = F.transform(options, lambda o: F.coalesce(empty_to_null(o["link"]), o["title"]))
    return F.when(F.size(options) > 0, F.size(F.array_distinct(targets))).otherwise(F.lit(1))


def source_list(phrases: Column, own: Column) -> Column:
    """Non-empty phrases, trimmed, with the current one appended if new."""
    kept = F.filter(F.transform(phrases, strip), lambda p: p.isNotNull() & (p != ""))
    kept = F.coalesce(kept, F.array().cast("array<string>"))
    is_new = empty_to_null(own).isNotNull() & ~F.array_contains(kept, F.coalesce(own, F.lit("")))
    return F.when(is_new, F.array_append(kept, own)).otherwise(kept)


def role_flags(title: Column, roles: RoleCatalog) -> dict[str, Column]:
    """One boolean per role; a title can have several."""
    return {role: title.rlike(roles.regex(role)) for role in roles.patterns}


def role_class(title: Column, roles: RoleCatalog) -> Column:
    """The first role, by priority, that a title matches; else "other"."""
    flags = role_flags(title, roles)
    chain = F
    for role in roles.priority:
        chain = chain.when(flags[role], F.lit(role))
    return chain.otherwise(F.lit("other"))


def platform_name(via: Column, platforms=tuple(catalog.PLATFORM_NAMES), fallback=catalog.PLATFORM_FALLBACK) -> Column:
    chain = F
    for name in platforms:
        chain = chain.when(via.contains(name), F.lit(name))
    return chain.otherwise(F.coalesce(empty_to_null(F.replace(via, F.lit("via "), F.lit(""))), F.lit(fallback)))


def _portal_rank(option: Column) -> Column:
    link = F.lower(F.coalesce(option["link"], F.lit("")))
    title = F.lower(F.coalesce(option["title"], F.lit("")))
    chain = F
    for rank, link_words, title_words in catalog.PORTAL_CLASSES:
        hit = F.lit(False)
        for w in link_words:
            hit = hit | link.contains(w)
        for w in title_words:
            hit = hit | title.contains(w)
        chain = chain.when(hit, F.lit(rank))
    return chain.otherwise(F.lit(catalog.PORTAL_DEFAULT_RANK))


def rank_portals(options: Column) -> Column:
    """Apply options with employers' own pages first and aggregators last, stable within a class."""
    ranked = F.transform(
        options, lambda o, i: F.struct(_portal_rank(o).alias("rank"), i.alias("position"), o.alias("option"))
    )
    return F.transform(F.array_sort(ranked), lambda r: r["option"])


def portal_label(count: Column) -> Column:
    n = F.when(count != 0, count).otherwise(F.lit(1))
    return F.when(n >= 8, "8+ portals").otherwise(F.concat(n.cast("string"), F.lit(" portals")))


def publisher(option: Column) -> Column:
    """What makes two apply options the same portal: title, else link, trimmed and lowered."""
    return F.lower(strip(F.coalesce(empty_to_null(option["title"]), option["link"], F.lit(""))))


def union_by_publisher(options: Column) -> Column:
    """First option per publisher, in order; options without a publisher are dropped."""
    keys = F.transform(options, publisher)
    return F.filter(options, lambda o, i: (publisher(o) != "") & (F.array_position(keys, publisher(o)) == i + 1))
