"""Text derivations: normalisation, identity, skills found in text, typed skill names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from skillgap.catalog import DEFAULT_LANGUAGE, DEFAULT_REGION, Form, SkillCatalog
from skillgap.functions.numbers import any_of, let, literal

# Unicode white space plus the four separators that count as space in text input.
_SPACE = r"[\s\x1c-\x1f]"


def strip(c: Column) -> Column:
    """Remove any white space, not only blanks, from both ends."""
    return F.regexp_replace(c, rf"(?U)^{_SPACE}+|{_SPACE}+$", "")


def empty_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def normalize_text(c: Column) -> Column:
    """Lower case, white space collapsed and trimmed; null becomes empty."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), rf"(?U){_SPACE}+", " "))


_IDENTITY = 300
#: Characters of a description that its prefix is taken from first.
_LEADING = 1000


def identity_prefix(description: Column) -> Column:
    """The part of a description that takes part in a posting's identity.

    Mostly the first characters give it; where they are white space for the most part, the whole text is gone through.
    A capital sigma in them too asks for the whole text: its lower case depends on what follows.
    """
    lead = F.substring(description, 1, _LEADING)
    short = F.substring(normalize_text(lead), 1, _IDENTITY + 1)
    enough = (F.length(short) > _IDENTITY) & ~lead.contains("\u03a3")
    return F.substring(F.when(enough, short).otherwise(normalize_text(description)), 1, _IDENTITY)


def canonical_id(title: Column, company: Column, location: Column, description: Column) -> Column:
    return F.md5(
        F.concat_ws(
            "|", normalize_text(title), normalize_text(company), normalize_text(location), identity_prefix(description)
        )
    )


def combined_text(title: Column, description: Column, highlights: Column) -> Column:
    return F.concat_ws(
        " ", F.coalesce(title, F.lit("")), F.coalesce(description, F.lit("")), F.coalesce(highlights, F.lit(""))
    )


# Letters beyond ASCII that ignoring case makes equal to an ASCII letter: long s, kelvin, dotless and dotted i.
_FOLD_FROM, _FOLD_TO = "\u017f\u212a\u0131\u0130", "skii"


def fold_case(c: Column) -> Column:
    """Lower case such that an ASCII pattern in lower case matches what it would match ignoring case."""
    special = F.lit(False)
    for letter in _FOLD_FROM:
        special = special | c.contains(letter)
    return F.lower(F.when(special, F.translate(c, _FOLD_FROM, _FOLD_TO)).otherwise(c))


def hinted(pattern: str, subject: str, hints: Sequence[str], folded: str) -> str:
    """SQL for a match: a cheap substring test first, the pattern only where that succeeds."""
    match = f"{subject} RLIKE {literal(pattern)}"
    if not hints:
        return f"({match})"
    return "(" + any_of([f"contains({folded}, {literal(h)})" for h in hints]) + f" AND {match})"


def _present(form: Form, text: str, folded: str) -> str:
    """SQL for whether a form of a skill occurs."""
    return hinted(form.pattern, folded if form.any_case else text, form.hints, folded)


def _with_folded(text: Column, folded: Column | None = None) -> Column:
    return F.struct(text.alias("text"), (fold_case(text) if folded is None else folded).alias("folded"))


def extract_skills(text: Column, skills: SkillCatalog, folded: Column | None = None) -> Column:
    """Sorted canonical skills found in a text; empty for a null or empty text.

    ``folded`` is the text's ``fold_case`` where the caller has it already.
    """
    found = [
        f"CASE WHEN {any_of([_present(f, 'd.text', 'd.folded') for f in skills.forms(n)])} THEN {literal(n)} END"
        for n in sorted(skills.names)
    ]
    return let(_with_folded(text, folded), "d", f"array_compact(array({', '.join(found)}))")


def count_mentions(text: Column, skills: SkillCatalog) -> Column:
    """Occurrences of each skill in a text, as an array in catalog order."""
    def occurrences(form: Form) -> str:
        where = "d.folded" if form.any_case else "d.text"
        counted = f"regexp_count({where}, {literal(form.pattern)})"
        return f"CASE WHEN {_present(form, 'd.text', 'd.folded')} THEN {counted} ELSE 0 END"

    totals = [" + ".join(occurrences(f) for f in skills.forms(n)) for n in skills.names]
    return let(_with_folded(text), "d", f"array({', '.join(totals)})")


def resolve_skill(name: Column, skills: SkillCatalog) -> Column:
    """Canonical skill for one typed name, or null.

    An exact name wins (case-insensitively, acronyms by exact case); then the
    first pattern of the catalog that the name contains, special ones first.
    """
    cases = ["WHEN d.text = '' THEN NULL"]
    for n in skills.names:
        if skills.is_acronym(n):
            cases.append(f"WHEN lower(d.text) = {literal(n.lower())} THEN CASE WHEN d.text = {literal(n)} THEN d.text END")
    for n in skills.names:
        if not skills.is_acronym(n):
            cases.append(f"WHEN lower(d.text) = {literal(n.lower())} THEN {literal(n)}")
    for n in skills.resolution_order():
        if skills.is_acronym(n):
            whole = literal(rf"(?iU)^(?:{skills.long_forms[n]})\z")
            cases.append(f"WHEN d.text RLIKE {whole} THEN {literal(n)}")
        else:
            cases.append(f"WHEN {_present(skills.forms(n)[0], 'd.text', 'd.folded')} THEN {literal(n)}")
    return let(_with_folded(strip(name)), "d", f"CASE {' '.join(cases)} END")


def cache_key(query: Column, location: Column, gl: Column, hl: Column, date_posted: Column) -> Column:
    """Key of a search request: its normalised parameters hashed."""
    def part(c: Column, default: str = "") -> Column:
        return F.lower(strip(F.coalesce(empty_to_null(c), F.lit(default))))

    joined = F.concat_ws(
        "|",
        part(query),
        part(location),
        part(gl, DEFAULT_REGION),
        part(hl, DEFAULT_LANGUAGE),
        F.coalesce(date_posted, F.lit("")),
    )
    return F.sha2(joined, 256)


def snippet(c: Column, length: int = 260) -> Column:
    return F.substring(c, 1, length)
