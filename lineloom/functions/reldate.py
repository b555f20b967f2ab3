"""Relative dates: `now`, `3 weeks ago`, `2024-05-01 - 2 weeks - 1 day`."""

from __future__ import annotations

import calendar
import re
from datetime import UTC, datetime, timedelta

STEP = re.compile(r"(\d+)\s*(second|minute|hour|day|week|month|year)s?")
SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86_400, "week": 604_800}


def back(at: datetime, count: int, unit: str) -> datetime:
    """`at` less so many units; months keep the day where the month has it."""
    if unit in SECONDS:
        return at - timedelta(seconds=count * SECONDS[unit])
    months = at.year * 12 + at.month - 1 - count * (12 if unit == "year" else 1)
    year, month = divmod(months, 12)
    return at.replace(year=year, month=month + 1, day=min(at.day, calendar.monthrange(year, month + 1)[1]))


def resolve(text: str, now: datetime | None = None) -> datetime:
    """The moment that `text` names, in UTC; all subtractions add up."""
    now = now or datetime.now(UTC)
    rest = text.strip().lower()
    at = now
    if m := re.match(r"\d{4}-\d{2}-\d{2}(?:[t ]\d{2}:\d{2}(?::\d{2})?)?(?:z|[+-]\d{2}:\d{2})?", rest):
        at = datetime.fromisoformat(m[0].upper())
        at = at if at.tzinfo else at.replace(tzinfo=UTC)
        rest = rest[m.end() :]
    elif rest.startswith("now"):
        rest = rest[3:]
    elif rest.startswith("yesterday"):
        at, rest = now - timedelta(days=1), rest[9:]
    left = STEP.sub("", rest).replace("ago", "").replace("-", "").replace(",", "").strip()
    if left:
        raise ValueError(f"{text!r} is no date: {left!r} is not understood")
    for count, unit in STEP.findall(rest):
        at = back(at, int(count), unit)
    return at.astimezone(UTC)


def less(at: datetime, period: str) -> datetime:
    """`at` less a period such as `2 weeks` or `30 days ago`."""
    steps = STEP.findall(period.lower())
    if not steps or not any(int(count) for count, _ in steps):
        raise ValueError(f"{period!r} is no period")
    for count, unit in steps:
        at = back(at, int(count), unit)
    return at


def ticks(since: str, until: str, period: str, now: datetime | None = None) -> list[datetime]:
    """until, until - period, ... down to since; newest first."""
    now = now or datetime.now(UTC)
    low, at = resolve(since, now), resolve(until, now)
    out = []
    while at >= low:
        out.append(at)
        at = less(at, period)
    return out
