"""Durations and numbers of the query languages."""

from __future__ import annotations

import re

SECOND, MINUTE, HOUR, DAY = 1000, 60_000, 3_600_000, 86_400_000
#: Units of M3QL and of PromQL in milliseconds.
M3_UNITS = {"s": SECOND, "sec": SECOND, "second": SECOND, "seconds": SECOND, "m": MINUTE, "min": MINUTE, "minute": MINUTE, "minutes": MINUTE, "h": HOUR, "hr": HOUR, "hour": HOUR, "hours": HOUR, "d": DAY, "day": DAY, "days": DAY, "w": 7 * DAY, "week": 7 * DAY, "weeks": 7 * DAY, "mon": 30 * DAY, "month": 30 * DAY, "months": 30 * DAY, "y": 365 * DAY, "year": 365 * DAY, "years": 365 * DAY}
PROM_UNITS = {"ms": 1, "s": SECOND, "m": MINUTE, "h": HOUR, "d": DAY, "w": 7 * DAY, "y": 365 * DAY}


def duration_ms(text: str, units: dict[str, int] = M3_UNITS) -> int:
    """Milliseconds of `90s`, `-1h` and the like, also of several parts in a row such as `1h30m`."""
    m = re.fullmatch(r"(-?)((?:\d+[a-z]+)+)", text.strip())
    if not m:
        raise ValueError(f"Invalid duration: {text}")
    total = 0
    for n, unit in re.findall(r"(\d+)([a-z]+)", m[2]):
        if unit not in units:
            raise ValueError(f"Invalid duration: {text}")
        total += int(n) * units[unit]
    return -total if m[1] else total


def is_number(text: str) -> bool:
    return re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", text.strip()) is not None


def number(text: str) -> float:
    if text.strip().lower() == "nan":
        return float("nan")
    if not is_number(text):
        raise ValueError(f"Invalid number: {text}")
    return float(text)
