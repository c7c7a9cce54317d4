"""Schedules of five fields (minute, hour, day, month, weekday; 0 is Sunday) and comma lists of scopes."""

from __future__ import annotations

from datetime import datetime, timedelta

RANGES = ((0, 59), (0, 23), (1, 31), (1, 12), (0, 6))


def _field(text: str, low: int, high: int) -> set[int]:
    out: set[int] = set()
    for part in text.split(","):
        span, _, step = part.partition("/")
        every = int(step) if step else 1
        if every < 1:
            raise ValueError(f"bad step in {text!r}")
        if span == "*":
            a, z = low, high
        elif "-" in span:
            a, z = map(int, span.split("-"))
        else:
            a = int(span)
            z = high if step else a
        if not low <= a <= z <= high:
            raise ValueError(f"{part!r} is outside {low}-{high}")
        out.update(range(a, z + 1, every))
    return out


def parse(text: str) -> list[set[int]]:
    parts = text.split()
    if len(parts) != 5:
        raise ValueError("a schedule has five fields")
    return [_field(p, *r) for p, r in zip(parts, RANGES, strict=True)]


def next_run(text: str, after: datetime) -> datetime:
    """The first matching minute within 366 days; a day later if there is none."""
    minutes, hours, days, months, weekdays = parse(text)
    day = after.replace(second=0, microsecond=0) + timedelta(minutes=1)
    end = day + timedelta(days=366)
    while day < end:
        if day.month in months and day.day in days and (day.weekday() + 1) % 7 in weekdays:
            for h in sorted(hours):
                for m in sorted(minutes):
                    at = day.replace(hour=h, minute=m)
                    if at >= day:
                        return at
        day = (day + timedelta(days=1)).replace(hour=0, minute=0)
    return after + timedelta(hours=24)


SCOPES = ("integrity", "coverage", "rule_health", "performance", "access")


def scopes(text: str, known: tuple = SCOPES) -> list[str]:
    out: list[str] = []
    for name in (x.strip().lower() for x in text.split(",") if x.strip()):
        if name == "all":
            return list(known)
        if name not in known:
            raise ValueError(f"unknown scope {name!r}")
        if name not in out:
            out.append(name)
    return out
