"""Digest windows: half-open, 24 elapsed hours, bounds in UTC."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, time, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
DIGEST_HOUR = 8
DIGEST_LENGTH = timedelta(hours=24)
DEFAULT_ZONE = "Europe/Moscow"


def utc_naive(t: datetime) -> datetime:
    """Wall clock in UTC; a naive value is taken as UTC already."""
    return t.astimezone(timezone.utc).replace(tzinfo=None) if t.tzinfo else t


@dataclass(frozen=True)
class Window:
    """``[start, end)``"""

    start: datetime
    end: datetime

    def __post_init__(self):
        if self.start is None or self.end is None:
            raise ValueError("both bounds of a window are needed")
        object.__setattr__(self, "start", utc_naive(self.start))
        object.__setattr__(self, "end", utc_naive(self.end))
        if not self.start < self.end:
            raise ValueError(f"window start {self.start} must be before its end {self.end}")

    @property
    def bounds(self) -> tuple[Column, Column]:
        return timestamp(self.start), timestamp(self.end)


def timestamp(t: datetime) -> Column:
    """Literal of the wall-clock type, so that comparisons with a bare column
    need no cast and reach the Parquet scan."""
    return F.lit(utc_naive(t).isoformat(sep=" ")).cast("timestamp_ntz")


def digest_window_at(now: datetime, tz: str = DEFAULT_ZONE) -> Window:
    """Window of a scheduled digest: up to the start of the current hour."""
    local = now.astimezone(ZoneInfo(tz)) if now.tzinfo else now.replace(tzinfo=timezone.utc).astimezone(ZoneInfo(tz))
    end = utc_naive(local.replace(minute=0, second=0, microsecond=0))
    return Window(end - DIGEST_LENGTH, end)


def digest_window_for(day: date | str, tz: str = DEFAULT_ZONE) -> Window:
    """Window of a given day: up to 08:00 in the zone."""
    day = date.fromisoformat(day) if isinstance(day, str) else day
    end = utc_naive(datetime.combine(day, time(DIGEST_HOUR), ZoneInfo(tz)))
    return Window(end - DIGEST_LENGTH, end)


def digest_bucket(event_time: Column | str, tz: str = DEFAULT_ZONE) -> Column:
    """Start of the daily digest window of a record, for many days at once.

    Holds for zones with a fixed offset, where every window starts at the same
    UTC hour; other zones need ``digest_day``.
    """
    offsets = {datetime(2024, m, 1, tzinfo=ZoneInfo(tz)).utcoffset() for m in range(1, 13)}
    if len(offsets) > 1:
        raise ValueError(f"{tz} changes its offset within the year; use digest_day")
    shift = (timedelta(hours=DIGEST_HOUR) - offsets.pop()) % DIGEST_LENGTH
    return F.window(event_time, "24 hours", startTime=f"{int(shift.total_seconds())} seconds")["start"]


def digest_day(event_time: Column | str, tz: str = DEFAULT_ZONE) -> Column:
    """Local date on which the record's digest ends, in any zone."""
    t = F.col(event_time) if isinstance(event_time, str) else event_time
    local = F.convert_timezone(F.lit("UTC"), F.lit(tz), t)
    return F.date_add(F.to_date(local - F.make_dt_interval(hours=F.lit(DIGEST_HOUR))), 1)
