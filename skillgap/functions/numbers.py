"""Naming an intermediate value, and digits of any script."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, name: str, body: str) -> Column:
    """SQL text ``body`` with ``name`` standing for ``value``, which is computed once however often it is named.

    Long expressions are written as SQL text: it is parsed in one call, while
    each step of a Column expression is a call of its own.
    """
    return F.element_at(F.call_function("transform", F.array(value), F.expr(f"{name} -> {body}")), 1)


def literal(text: str) -> str:
    """A string literal in which a backslash is a backslash."""
    quote = "'" if "'" not in text else '"'
    return f"r{quote}{text}{quote}"


def any_of(conditions: list[str]) -> str:
    return "(" + " OR ".join(conditions) + ")"


#: Every decimal digit beyond ASCII, and the ASCII digit of the same value.
_OTHER_DIGITS = [chr(c) for c in range(128, sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Nd"]
DIGITS_FROM = "".join(_OTHER_DIGITS)
DIGITS_TO = "".join(str(unicodedata.decimal(c)) for c in _OTHER_DIGITS)


def ascii_digits(c: Column) -> Column:
    """Decimal digits of any script as ASCII digits; texts without such are not gone through."""
    return F.when(c.rlike(r"[\p{Nd}&&[^0-9]]"), F.translate(c, DIGITS_FROM, DIGITS_TO)).otherwise(c)
