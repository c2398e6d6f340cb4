"""Instants, civil days and lenient timestamp parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def instant(text: str) -> Column:
    """A literal instant in UTC; every operator gets its clock as such an argument."""
    return F.to_timestamp(F.lit(text))


def as_instant(as_of: str | Column) -> Column:
    return instant(as_of) if isinstance(as_of, str) else as_of


def local_day(ts: str | Column, tz: str | Column = "UTC") -> Column:
    """Civil date of an instant in a zone."""
    if tz == "UTC":
        return F.to_date(_col(ts))
    return F.to_date(F.from_utc_timestamp(_col(ts), tz))


def day_key(ts: str | Column, tz: str = "UTC") -> Column:
    return F.date_format(local_day(ts, tz), "yyyy-MM-dd")


def day_start(day: str | Column, tz: str = "UTC") -> Column:
    """First instant of a civil date; days of 23 or 25 hours come out right."""
    start = _col(day).cast("timestamp")
    return start if tz == "UTC" else F.to_utc_timestamp(start, tz)


def start_of_day(ts: str | Column, tz: str = "UTC") -> Column:
    return day_start(local_day(ts, tz), tz)


def window_starts(as_of: str | Column, tz: str = "UTC") -> dict[str, Column]:
    """First instants of the four reporting windows that end at ``as_of``."""
    today = local_day(as_instant(as_of), tz)
    return {
        "today": day_start(today, tz),
        "seven_day": day_start(F.date_sub(today, 6), tz),
        "month": day_start(F.trunc(today, "month"), tz),
        "lifetime": F.lit(None).cast("timestamp"),
    }


def from_epoch(value: str | Column) -> Column:
    """Seconds, or milliseconds beyond 1e10, to an instant; not positive is null."""
    number = F.try_cast(_col(value), "double") if hasattr(F, "try_cast") else _col(value).try_cast("double")
    seconds = F.when(number > 10_000_000_000, number / 1000).otherwise(number)
    return F.when(number > 0, F.timestamp_micros(F.round(seconds * 1_000_000).cast("bigint")))


def parse_instant(text: str | Column) -> Column:
    """ISO text with or without a fraction, else an epoch number, else null."""
    raw = _col(text)
    iso = F.when(raw.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:?\d{2})$"),
                 F.try_to_timestamp(raw))
    return F.coalesce(iso, F.when(raw.rlike(r"^\s*[0-9.eE+]+\s*$"), from_epoch(raw)))


def micros_between(start: str | Column, end: str | Column) -> Column:
    return F.unix_micros(_col(end)) - F.unix_micros(_col(start))


def iso_millis(ts: str | Column) -> Column:
    return F.date_format(_col(ts), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
