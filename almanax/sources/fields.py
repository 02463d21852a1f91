"""Numbers and times of fixed columns."""

from __future__ import annotations

from calendar import timegm


def millis_of(year: str, *rest: str) -> int | None:
    """Unix milliseconds of the fields of an epoch, the seconds last; None if one isn't a number or a date's."""
    try:
        y, month, day, hour, minute = int(year), *map(int, rest[:4])
        return timegm((y, month, day, hour, minute, 0)) * 1000 + round(float(rest[4]) * 1000)
    except ValueError:
        return None


def number_of(cell: str) -> float | None:
    try:
        return float(cell) if cell.strip() else None
    except ValueError:
        return None
