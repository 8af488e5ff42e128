"""Dates: parsing that never throws, sentinels, offsets and slot labels."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

# The stand-ins for a missing date.
EPOCH_1900 = date(1900, 1, 1)
EPOCH_1970 = date(1970, 1, 1)
FAR_FUTURE = date(2999, 1, 1)
# Fixed value: a run date has to be later than this to count as a run.
EARLIEST_RUN = date(2001, 1, 1)

# Accepted spellings of a date in feeds and file names.
DATE_PATTERNS = ("yyyy-MM-dd", "dd-MMM-yyyy")

# Length in months of each drill-down granularity (day is one day).
GRANULARITY_MONTHS = {"month": 1, "quarter": 3, "year": 12}


def parse_date(text: Column) -> Column:
    """The date a text spells in any accepted pattern, else NULL."""
    return F.coalesce(*[F.try_to_date(F.trim(text), pattern) for pattern in DATE_PATTERNS])


def parse_timestamp(text: Column) -> Column:
    return F.try_to_timestamp(F.trim(text), F.lit("yyyy-MM-dd HH:mm:ss"))


def moment(value: date | datetime) -> Column:
    """A date, or a wall-clock timestamp that no time zone setting shifts, as a literal."""
    if isinstance(value, datetime):
        return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")
    return F.lit(value)


def days_before(as_of: date | datetime, days: int) -> Column:
    """The moment ``days`` before ``as_of`` as a literal."""
    return moment(as_of - timedelta(days=days))


def or_sentinel(value: Column, sentinel: date) -> Column:
    return F.coalesce(value, F.lit(sentinel))


def is_expired(last_run: Column, as_of: date | datetime, expire_days: int = 30) -> Column:
    """True when never run, or last run more than ``expire_days`` before ``as_of``."""
    return last_run.isNull() | (last_run < days_before(as_of, expire_days))


def is_done(last_run: Column, upload: Column, grace_days: int = 1) -> Column:
    """True when run on or after the upload date, less ``grace_days``; NULL counts as not done."""
    return F.coalesce(last_run >= F.date_sub(upload, grace_days), F.lit(False))


def in_period(value: Column, start: date, granularity: str) -> Column:
    """Half-open period starting at ``start`` itself, not at the start of its month or year."""
    if granularity == "day":
        return (value >= F.lit(start)) & (value < F.lit(start + timedelta(days=1)))
    if granularity not in GRANULARITY_MONTHS:
        raise ValueError(f"unknown granularity: {granularity}")
    end = F.add_months(F.lit(start), GRANULARITY_MONTHS[granularity])
    return (value >= F.lit(start)) & (value < end)


def slot_label(hour: Column) -> Column:
    """Hour of day as a two-digit 12-hour label; midnight stays ``00_AM``."""
    half = F.when(hour >= 12, F.lit("PM")).otherwise(F.lit("AM"))
    twelve = F.when(hour == 12, hour).otherwise(hour % 12)
    return F.concat(F.lpad(twelve.cast("string"), 2, "0"), F.lit("_"), half)


def versioned_name(base: Column, as_of: date) -> Column:
    """``base@yyyy-MM-dd.txt``."""
    return F.concat(base, F.lit(f"@{as_of.isoformat()}.txt"))
