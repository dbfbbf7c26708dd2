"""Time expressions. Timestamps are read as UTC (session time zone UTC)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Seconds per cycle and minutes per cycle.
DAY_SECONDS = 24 * 60 * 60
WEEK_SECONDS = 7 * DAY_SECONDS
DAY_MINUTES = 24 * 60
WEEK_MINUTES = 7 * DAY_MINUTES
MICROS_PER_MINUTE = 6e7
MICROS_PER_DAY = 8.64e10


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _micros(ts: Column | str) -> Column:
    return F.unix_micros(_col(ts).cast("timestamp"))


def parse_ts(text: Column | str, strict: bool = True) -> Column:
    """Text to timestamp; unreadable text raises if strict, else gives null."""
    return F.to_timestamp(_col(text)) if strict else _col(text).try_cast("timestamp")


def strip_zone(ts: Column | str) -> Column:
    """Wall-clock time without a zone; for text with an offset the offset is dropped."""
    return _col(ts).try_cast("timestamp_ntz")


def to_zone(ts: Column | str, tz: str) -> Column:
    """Local wall-clock time of a UTC timestamp."""
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), _col(ts).cast("timestamp_ntz"))


def from_zone(ts: Column | str, tz: str) -> Column:
    """UTC timestamp of a local wall-clock time."""
    moved = F.convert_timezone(F.lit(tz), F.lit("UTC"), _col(ts).cast("timestamp_ntz"))
    return moved.cast("timestamp")


def round_hour(ts: Column | str) -> Column:
    """Nearest full hour; an exact half goes to the even hour."""
    hours = F.bround(_micros(ts) / F.lit(3.6e9)).cast("long")
    return F.timestamp_seconds(hours * 3600)


def minutes_between(start: Column | str, end: Column | str) -> Column:
    return (_micros(end) - _micros(start)) / F.lit(MICROS_PER_MINUTE)


def days_between(start: Column | str, end: Column | str) -> Column:
    return (_micros(end) - _micros(start)) / F.lit(MICROS_PER_DAY)


def add_minutes(ts: Column | str, minutes: Column | str) -> Column:
    """Timestamp plus fractional minutes, to the nearest microsecond (half to even)."""
    return F.timestamp_micros(_micros(ts) + F.bround(_col(minutes) * F.lit(MICROS_PER_MINUTE)).cast("long"))


def weekend_flag(ts: Column | str) -> Column:
    """1 on Saturday and Sunday, else 0."""
    return (F.weekday(_col(ts)) >= 5).cast("int")


def calendar_parts(ts: Column | str, tz: str | None = None) -> dict[str, Column]:
    local = to_zone(ts, tz) if tz else _col(ts)
    return {
        "hour": F.hour(local),
        "day_name": F.date_format(local, "EEEE"),
        "year": F.year(local),
        "month": month_key(local),
    }


def month_key(ts: Column | str) -> Column:
    return F.date_format(_col(ts), "yyyy-MM")


def cyclical(ts: Column | str, form: str = "epoch") -> dict[str, Column]:
    """day_sin, day_cos, week_sin, week_cos.

    ``epoch`` turns epoch seconds; ``calendar`` turns the minute of the day, and for
    the week the weekday alone.
    """
    if form == "epoch":
        seconds = _micros(ts) / F.lit(1e6)
        day = seconds * F.lit(2 * math.pi / DAY_SECONDS)
        week = seconds * F.lit(2 * math.pi / WEEK_SECONDS)
    elif form == "calendar":
        minute = F.hour(_col(ts)) * 60 + F.minute(_col(ts))
        day = F.lit(2 * math.pi) * minute / DAY_MINUTES
        week = F.lit(2 * math.pi) * F.weekday(_col(ts)) * DAY_MINUTES / WEEK_MINUTES
    else:
        raise ValueError(f"unknown form {form!r}: use 'epoch' or 'calendar'")
    return {
        "day_sin": F.sin(day),
        "day_cos": F.cos(day),
        "week_sin": F.sin(week),
        "week_cos": F.cos(week),
    }


def iso(ts: Column | str) -> Column:
    """ISO-8601 text; the fraction is written, with six digits, only if it is not zero."""
    whole = F.date_format(_col(ts), "yyyy-MM-dd'T'HH:mm:ss")
    exact = F.date_format(_col(ts), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.when(F.endswith(exact, F.lit(".000000")), whole).otherwise(exact)


def minute_text(ts: Column | str) -> Column:
    return F.date_format(_col(ts), "yyyy-MM-dd HH:mm")
