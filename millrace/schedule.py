"""When the next scheduled scan is due."""

from __future__ import annotations

from datetime import datetime, timedelta

_DAYS = ("mon", "tue", "wed", "thu", "fri", "sat", "sun")
GRACE = timedelta(hours=1)


def next_fire(now: datetime, schedule: dict) -> datetime | None:
    """The first time after `now` at the set hour and minute, on the set day; None if scans are off."""
    if not schedule.get("enabled"):
        return None
    at = now.replace(hour=int(schedule.get("hour", 7)), minute=int(schedule.get("minute", 30)), second=0, microsecond=0)
    if at <= now:
        at += timedelta(days=1)
    day = schedule.get("day_of_week", "daily")
    while day != "daily" and _DAYS[at.weekday()] != day:
        at += timedelta(days=1)
    return at


def still_due(due: datetime, now: datetime) -> bool:
    """A missed time may be made up for within an hour."""
    return due <= now <= due + GRACE
