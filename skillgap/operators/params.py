"""Bounds of parameters, checked before a plan is built. What a caller asks for has no ceiling."""

from __future__ import annotations

# Inclusive bounds; None is open.
BOUNDS: dict[str, tuple[int, int | None]] = {
    "threshold": (1, 100),
    "min_skills": (1, None),
    "top_n": (1, None),
    "limit": (1, None),
    "max_age_days": (0, None),
}


def check_bounds(**values: int | None) -> None:
    for name, value in values.items():
        low, high = BOUNDS[name]
        if value is not None and (value < low or (high is not None and value > high)):
            raise ValueError(f"{name} is {value}; it starts at {low}" + ("" if high is None else f" and ends at {high}"))


def check_dates(from_date: str | None, to_date: str | None) -> None:
    if from_date and to_date and from_date > to_date:
        raise ValueError(f"the range from {from_date} to {to_date} is empty")
