"""Salary text: cleaning, picking, and conversion to lakh rupees per annum."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skillgap import catalog
from skillgap.functions.numbers import any_of, ascii_digits, let, literal
from skillgap.functions.text import empty_to_null, strip

# The pieces salary forms are written with.
_CURRENCY = r"(?:₹|INR|Rs\.?)"
_AMOUNT = r"(\d+(?:\.\d+)?)"
_LAKH = r"(?:LPA|lakhs?|lacs?|lac|L)"
_MONTH = r"(?:a\s+month|/\s*month|per\s+month|\bmonthly\b)"
_YEAR = r"(?:a\s+year|/\s*year|per\s+annum|per\s+year|\bannually\b)"
_NOT_YEARLY_WORK = r"(?iU)\b(hour|hr|day|daily)\b"
_BOUNDS = (1.0, 200.0)


def _form(first_unit: str, second_unit: str, ending: str, currency_needed: bool = False) -> str:
    """An amount or a range of two, each with its unit, then an ending."""
    lead = _CURRENCY if currency_needed else _CURRENCY + "?"
    return (
        rf"(?iU){lead}\s*{_AMOUNT}\s*{first_unit}\s*"
        rf"(?:-\s*{_CURRENCY}?\s*{_AMOUNT}\s*{second_unit})?\s*{ending}"
    )


def clean_salary(c: Column) -> Column:
    """Salary text, or null if it is blank, a relative time or a working arrangement."""
    trimmed = strip(c)
    lowered = F.lower(trimmed)
    bad = (
        (trimmed == "")
        | lowered.isin(*catalog.RELATIVE_TIME_WORDS, *catalog.NON_SALARY_WORDS)
        | lowered.rlike("(?U)" + catalog.RELATIVE_TIME_PATTERN)
    )
    return F.when(~bad, trimmed)


def pick_salary(detected: Column, own: Column, extensions: Column) -> Column:
    """The detected or own salary; else the first extension that reads like pay."""
    pay_like = F.filter(
        F.transform(extensions, clean_salary),
        lambda e: e.isNotNull() & e.rlike("(?iU)" + catalog.PAY_MARKER_PATTERN),
    )
    return F.coalesce(clean_salary(F.coalesce(empty_to_null(detected), own)), F.try_element_at(pay_like, F.lit(1)))


def _figures(pattern: str, factor: str = "{v}", judged_rounded: bool = True) -> str:
    """SQL for the two amounts of a form, scaled; one amount stands for both."""
    low, high = (f"try_cast(nullif(regexp_extract(t, {literal(pattern)}, {g}), '') AS DOUBLE)" for g in (1, 2))
    both = factor.format(v=low), factor.format(v=f"coalesce({high}, {low})")
    return f"named_struct('low', {both[0]}, 'high', {both[1]}, 'judged_rounded', {str(judged_rounded).lower()})"


def _parse_sql() -> str:
    """Unrounded figures by the first form that the cleaned text ``t`` has; null if it has none."""
    def has(pattern: str) -> str:
        return f"t RLIKE {literal(pattern)}"

    thousands_yearly = _form("k", "k", _YEAR)
    thousands_monthly = _form("k", "k", _MONTH)
    lakh_monthly = _form(_LAKH, _LAKH + "?", _MONTH)
    lakh_yearly = _form(_LAKH + "?", "", _LAKH + r"\b")
    rupees_monthly = _form("", "", _MONTH, currency_needed=True)
    rupees_yearly = _form("", "", _YEAR, currency_needed=True)
    says_month = has(r"(?U)\b" + _MONTH)
    full_rupees = f"try_cast(regexp_extract(t, {literal(rupees_yearly)}, 1) AS DOUBLE) >= 100000"
    return f"""CASE
        WHEN {has(thousands_yearly)} THEN {_figures(thousands_yearly, "{v} * 1000 / 100000D")}
        WHEN {has(thousands_monthly)} THEN {_figures(thousands_monthly, "{v} * 1000 * 12 / 100000D")}
        WHEN {has(lakh_monthly)} THEN {_figures(lakh_monthly, "{v} * 12D")}
        WHEN NOT {says_month} AND {has(lakh_yearly)} THEN {_figures(lakh_yearly, judged_rounded=False)}
        WHEN {has(rupees_monthly)} THEN {_figures(rupees_monthly, "{v} * 12 / 100000D")}
        WHEN {has(rupees_yearly)} AND {full_rupees} THEN {_figures(rupees_yearly, "{v} / 100000D")}
    END"""


def _usable_sql() -> str:
    """The text ``t`` if it can be a yearly rupee figure, else null."""
    foreign = any_of([f"contains(t, {literal(m)})" for m in catalog.FOREIGN_CURRENCY_MARKS])
    rupee = any_of([f"contains(lower(t), {literal(m)})" for m in catalog.RUPEE_MARKS])
    return f"CASE WHEN NOT t RLIKE {literal(_NOT_YEARLY_WORK)} AND NOT {foreign} AND {rupee} THEN t END"


def _finish_sql() -> str:
    """Both figures of ``v`` rounded, if both are within bounds."""
    low, high = _BOUNDS
    rounded = {c: f"round(v.{c}, 2)" for c in ("low", "high")}
    raw_ok = f"v.low BETWEEN {low} AND {high} AND v.high BETWEEN {low} AND {high}"
    rounded_ok = " AND ".join(f"({r}) BETWEEN {low} AND {high}" for r in rounded.values())
    ok = f"CASE WHEN v.judged_rounded THEN {rounded_ok} ELSE {raw_ok} END"
    return f"named_struct('min', CASE WHEN {ok} THEN {rounded['low']} END, 'max', CASE WHEN {ok} THEN {rounded['high']} END)"


def salary_lpa(c: Column) -> Column:
    """struct<min,max> in lakh per annum; both null where the text gives no sure figure.

    The first form found decides, also when its figure is then out of range.
    """
    # Dashes become hyphens, hard spaces blanks, and commas go.
    cleaned = strip(F.translate(ascii_digits(let(strip(c), "t", _usable_sql())), "\u2013\u2014\u00a0,", "-- "))
    return let(let(cleaned, "t", _parse_sql()), "v", _finish_sql())
