"""Half-open time windows: bounds on the driver, membership as Column expressions."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_DAYS = 365


@dataclass(frozen=True)
class Window:
    start: dt.datetime
    end: dt.datetime

    def contains(self, ts: Column) -> Column:
        """start <= ts < end; false for null. Both bounds are literals, so they reach the scan."""
        return F.coalesce((ts >= F.lit(self.start)) & (ts < F.lit(self.end)), F.lit(False))

    def label(self, tz: str) -> str:
        zone = ZoneInfo(tz)
        return f"{self.start.astimezone(zone):%Y-%m-%d %H:%M} → {self.end.astimezone(zone):%Y-%m-%d %H:%M}"


def daily_window(now: dt.datetime, tz: str, end_hour: int = 12, hours: int = 24) -> Window:
    """The latest window that has closed: it ends at `end_hour` local time and spans `hours` of wall clock."""
    local = now.astimezone(ZoneInfo(tz))
    end = local.replace(hour=end_hour, minute=0, second=0, microsecond=0)
    if end > local:
        end -= dt.timedelta(days=1)
    return Window(end - dt.timedelta(hours=hours), end)


def range_window(now: dt.datetime, tz: str, days: int | None = None, since: dt.datetime | None = None) -> Window:
    """From `since` (which wins) or `days` back, to now."""
    end = now.astimezone(ZoneInfo(tz))
    if since is not None:
        return Window(since if since.tzinfo else since.replace(tzinfo=ZoneInfo(tz)), end)
    if days is None:
        raise ValueError("give days or since")
    return Window(end - dt.timedelta(days=days), end)


def scan_window(now: dt.datetime, tz: str, days: int | None = None, since: dt.datetime | None = None) -> Window:
    """Like `range_window`, with the zone of `since` replaced and no or zero days meaning a year."""
    end = now.astimezone(ZoneInfo(tz))
    start = since.replace(tzinfo=ZoneInfo(tz)) if since else end - dt.timedelta(days=days or DEFAULT_DAYS)
    return Window(start, end)


def scan_label(window: Window, tz: str, last: int | None = None, days: int | None = None, since: dt.datetime | None = None) -> str:
    zone = ZoneInfo(tz)
    span = f"since{window.start.astimezone(zone):%Y%m%d}" if since else f"last{days or DEFAULT_DAYS}d"
    return f"{window.end.astimezone(zone):%Y-%m-%d}-{span}" + (f"-top{last}" if last else "")


def window_day(ts: Column, tz: str = "Asia/Seoul", end_hour: int = 12) -> Column:
    """Local date on which the daily window of an instant closes: the name of its daily file."""
    local = F.from_utc_timestamp(ts, tz)
    return F.date_add(F.to_date(local - F.make_dt_interval(hours=F.lit(end_hour))), 1)


def local_label(ts: Column, tz: str, pattern: str = "MM-dd HH:mm") -> Column:
    return F.date_format(F.from_utc_timestamp(ts, tz), pattern)


def date_label(ts: Column, tz: str) -> Column:
    """Date with the Korean name of its weekday."""
    day = F.to_date(F.from_utc_timestamp(ts, tz))
    names = F.array(*[F.lit(n) for n in "월화수목금토일"])
    return F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit(" ("), F.element_at(names, F.weekday(day) + 1), F.lit(")"))
