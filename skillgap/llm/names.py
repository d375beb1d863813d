"""Names for helper columns."""

from __future__ import annotations

from collections.abc import Sequence


def fresh(columns: Sequence[str], *wanted: str) -> list[str]:
    """The wanted names, with underscores in front until none is the name of a column, in any case."""
    taken = {c.lower() for c in columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out
