"""Time helpers: boundary differences, buckets, windows and adaptive grains.

Timestamps are local wall-clock readings held as ``TIMESTAMP`` in a UTC
session, so no conversion ever happens.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ColumnOrName = Column | str


def as_col(value: ColumnOrName) -> Column:
    return F.col(value) if isinstance(value, str) else value


# --------------------------------------------------------------------------
# differences: count the unit boundaries crossed between two readings
# --------------------------------------------------------------------------

def seconds_between(start: ColumnOrName, end: ColumnOrName) -> Column:
    return F.unix_seconds(as_col(end)) - F.unix_seconds(as_col(start))


def millis_between(start: ColumnOrName, end: ColumnOrName) -> Column:
    return F.unix_millis(as_col(end)) - F.unix_millis(as_col(start))


def _minute_index(value: ColumnOrName) -> Column:
    return F.floor(F.unix_seconds(as_col(value)) / 60)


def minutes_between(start: ColumnOrName, end: ColumnOrName) -> Column:
    """Minute boundaries crossed: 00:00:59 to 00:01:00 is one minute."""
    return _minute_index(end) - _minute_index(start)


def age_minutes(earlier: ColumnOrName, later: ColumnOrName) -> Column:
    """Fractional, never negative age; an absent reading is infinitely old."""
    micros = F.unix_micros(as_col(later)) - F.unix_micros(as_col(earlier))
    # greatest() skips NULLs, so absence is settled first.
    return F.when(micros.isNull(), F.lit(float("inf"))).otherwise(F.greatest(F.lit(0.0), micros / F.lit(6.0e7)))


# --------------------------------------------------------------------------
# buckets
# --------------------------------------------------------------------------

def bucket_start(ts: ColumnOrName, minutes: int) -> Column:
    """Start of the ``minutes`` bucket holding ``ts``; grains divide a day."""
    seconds = F.unix_seconds(as_col(ts))
    return F.timestamp_seconds(seconds - F.pmod(seconds, F.lit(int(minutes) * 60).cast("long")))


def hour_start(ts: ColumnOrName) -> Column:
    return bucket_start(ts, 60)


def hours_before(anchor: ColumnOrName, hours: int) -> Column:
    return as_col(anchor) - F.expr(f"INTERVAL {int(hours)} HOURS")


def days_before(anchor: ColumnOrName, days: int) -> Column:
    return as_col(anchor) - F.expr(f"INTERVAL {int(days)} DAYS")



def lit_ts(value: datetime) -> Column:
    """Wall-clock literal; independent of the Python process time zone."""
    return F.lit(value.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp")


def trailing(ts: ColumnOrName, anchor: Column, amount: int, unit: str, closed: str) -> Column:
    """Predicate for a trailing window ending at ``anchor``.

    ``closed`` is ``"buckets"`` for ``amount`` buckets including the anchor's,
    ``"right"`` for an open start, ``"both"`` for a closed start.
    """
    column = as_col(ts)
    if closed == "buckets":
        amount, lower_closed = amount - 1, True
    elif closed in ("right", "both"):
        lower_closed = closed == "both"
    else:
        raise ValueError(f"unknown window closure: {closed}")
    lower = anchor - F.expr(f"INTERVAL {int(amount)} {unit}")
    return (column >= lower if lower_closed else column > lower) & (column <= anchor)


# Tables stored by day carry their folder's date in this column.
DAY_COLUMN = "day"


def prune_days(df: DataFrame, lower: Column, upper: Column) -> DataFrame:
    """Read only the day folders between two times; no effect on tables not stored by day."""
    if DAY_COLUMN not in df.columns:
        return df
    return df.filter((F.col(DAY_COLUMN) >= F.to_date(lower)) & (F.col(DAY_COLUMN) <= F.to_date(upper)))


def in_trailing(df: DataFrame, ts: str, anchor: Column, amount: int, unit: str, closed: str) -> DataFrame:
    """Rows of a trailing window, see ``trailing``."""
    lower = anchor - F.expr(f"INTERVAL {int(amount)} {unit}")
    return prune_days(df.filter(trailing(ts, anchor, amount, unit, closed)), lower, anchor)


# --------------------------------------------------------------------------
# adaptive grain
# --------------------------------------------------------------------------

# Longest window in minutes for each bucket size.
GRAIN_LIMITS = ((6 * 60, 5), (24 * 60, 15), (7 * 24 * 60, 60))
COARSEST_GRAIN = 1440
FALLBACK_GRAIN = 15
GRAIN_NAMES = {
    5: ("5 Minutes", "5-minute buckets"),
    15: ("15 Minutes", "15-minute buckets"),
    60: ("Hour", "hourly buckets"),
    1440: ("Day", "daily buckets"),
}


def grain_minutes(duration_minutes: float | None) -> int:
    try:
        duration = float(duration_minutes)
    except (TypeError, ValueError):
        return FALLBACK_GRAIN
    if not math.isfinite(duration) or duration <= 0:
        return FALLBACK_GRAIN
    return next((grain for limit, grain in GRAIN_LIMITS if duration <= limit), COARSEST_GRAIN)


def grain_for(start: datetime, end: datetime) -> int:
    """Grain for a window, measured in whole-second boundaries."""
    whole = (end.replace(microsecond=0) - start.replace(microsecond=0)).total_seconds()
    return grain_minutes(whole / 60)


def describe_grain(minutes: int) -> dict[str, object]:
    label, buckets = GRAIN_NAMES.get(minutes, (f"{minutes} Minutes", f"{minutes}-minute buckets"))
    return {"bucket_minutes": minutes, "label": label, "bucket_label": buckets}


# --------------------------------------------------------------------------
# windows
# --------------------------------------------------------------------------

class WindowError(ValueError):
    """A rejected analysis window; ``code`` names the reason."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


@dataclass(frozen=True)
class WindowSpec:
    """Half-open analysis window ``[start, end)``."""

    start: datetime | None
    end: datetime | None
    is_custom: bool = False
    hours: int | None = None

    @property
    def grain(self) -> int:
        return grain_for(self.start, self.end)

    def contains(self, ts: ColumnOrName) -> Column:
        column = as_col(ts)
        return (column >= lit_ts(self.start)) & (column < lit_ts(self.end))


def in_window(df: DataFrame, ts: str, window: WindowSpec) -> DataFrame:
    """Rows whose time lies in the window."""
    return prune_days(df.filter(window.contains(ts)), lit_ts(window.start), lit_ts(window.end))


_LOCAL_TIME = re.compile(r"(\d{4}-\d{2}-\d{2})[T ](\d{2}:\d{2})(?::(\d{2})(?:\.(\d{1,6}))?)?")


def parse_local(text: object, strict_t: bool = False) -> datetime | None:
    """Read ``2026-07-31T08:15[:30[.250]]``; blank gives None, nonsense raises ValueError."""
    if text is None or isinstance(text, datetime):
        return text
    cleaned = str(text).strip()
    if not cleaned:
        return None
    found = _LOCAL_TIME.fullmatch(cleaned)
    if not found or (strict_t and "T" not in cleaned):
        raise ValueError(f"not a local date and time: {cleaned!r}")
    day, minute, second, fraction = found.groups()
    stamp = f"{day} {minute}:{second or '00'}.{(fraction or '0').ljust(6, '0')}"
    return datetime.strptime(stamp, "%Y-%m-%d %H:%M:%S.%f")


def clamp_int(value: object, default: int, low: int, high: int) -> int:
    """Leading integer of ``value`` forced into ``[low, high]``; default if there is none."""
    found = re.match(r"\s*([+-]?\d+)", str(value)) if value is not None else None
    return min(high, max(low, int(found.group(1)))) if found else default


def clamp_hours(value: object = None) -> int:
    return clamp_int(value, 24, 1, 720)


def clamp_days(value: object = None) -> int:
    return clamp_int(value, 7, 1, 90)


WIFI_WINDOW_CODE = "INVALID_WIFI_ANALYSIS_WINDOW"
WIFI_MAX_HOURS = 720


def parse_wifi_window(start: object, end: object, fallback_hours: int) -> WindowSpec:
    """Custom signal-analysis window, or the trailing ``fallback_hours``."""
    try:
        first, last = parse_local(start, strict_t=True), parse_local(end, strict_t=True)
    except ValueError as error:
        raise WindowError(WIFI_WINDOW_CODE, str(error)) from error
    if first is None and last is None:
        return WindowSpec(None, None, False, fallback_hours)
    if first is None or last is None:
        raise WindowError(WIFI_WINDOW_CODE, "start and end must be given together")
    length = last - first
    if length <= timedelta(0):
        raise WindowError(WIFI_WINDOW_CODE, "end must be later than start")
    if length > timedelta(hours=WIFI_MAX_HOURS):
        raise WindowError(WIFI_WINDOW_CODE, "the window may span at most 30 days")
    return WindowSpec(first, last, True, max(1, math.ceil(length.total_seconds() / 3600)))


@dataclass(frozen=True)
class WindowRule:
    """Codes and limits one report applies to its requested window."""

    invalid_code: str
    too_long_code: str
    max_hours: int
    no_full_hour_code: str | None = None


TASK_WINDOW = WindowRule("51001", "51002", 720, "51003")
TREND_WINDOW = WindowRule("51201", "51202", 720)
PROJECT_WINDOW = WindowRule("51101", "51102", 2160)


def parse_window(start: object, end: object, anchor: datetime | None, rule: WindowRule) -> WindowSpec:
    """Requested window; both sides absent means the 24 hours before ``anchor``."""
    try:
        first, last = parse_local(start), parse_local(end)
    except ValueError as error:
        raise WindowError(rule.invalid_code, str(error)) from error
    custom = first is not None or last is not None
    if not custom and anchor is not None:
        first, last = anchor - timedelta(hours=24), anchor
    if first is None or last is None or last <= first:
        raise WindowError(rule.invalid_code, "a start and a later end are required")
    crossed = _floor_hour(last) - _floor_hour(first)
    if crossed > timedelta(hours=rule.max_hours):
        raise WindowError(rule.too_long_code, f"the window may span at most {rule.max_hours // 24} days")
    return WindowSpec(first, last, custom, math.ceil((last - first).total_seconds() / 3600))


def _floor_hour(value: datetime) -> datetime:
    return value.replace(minute=0, second=0, microsecond=0)


def snap_to_hours(window: WindowSpec, rule: WindowRule | None = None) -> WindowSpec:
    """Full calendar hours inside the window."""
    first, last = _floor_hour(window.start), _floor_hour(window.end)
    if first < window.start:
        first += timedelta(hours=1)
    if last <= first and rule is not None and rule.no_full_hour_code:
        raise WindowError(rule.no_full_hour_code, "the window holds no full calendar hour")
    return WindowSpec(first, last, window.is_custom, window.hours)
