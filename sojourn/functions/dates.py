"""Date and time expressions. They take naive timestamps, zoned timestamps and dates alike."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

CLOSED = ("neither", "left", "right", "both")


def bound(value: date | datetime | str) -> Column:
    """A literal that takes the type of the column it is compared with, so that it reaches the scan."""
    if isinstance(value, datetime):
        value = value.isoformat(sep=" ")
    return F.lit(str(value))


def in_period(col: Column, lo=None, hi=None, closed: str = "neither") -> Column:
    """``lo < col < hi`` with either end open or closed, either bound optional.

    On a timestamp a strict lower bound keeps the first day after its midnight, on a date it
    drops that day: pass :func:`as_date` of the column for the latter.
    """
    if closed not in CLOSED:
        raise ValueError(f"closed must be one of {CLOSED}")
    if lo is None and hi is None:
        raise ValueError("give at least one bound")
    tests = []
    if lo is not None:
        tests.append(col >= bound(lo) if closed in ("left", "both") else col > bound(lo))
    if hi is not None:
        tests.append(col <= bound(hi) if closed in ("right", "both") else col < bound(hi))
    return tests[0] if len(tests) == 1 else tests[0] & tests[1]


def as_date(col: Column) -> Column:
    return F.to_date(col)


def parse_ymd(col: Column) -> Column:
    """``yyyy-MM-dd`` text to a date; text that is no date becomes null."""
    return F.try_to_date(col, "yyyy-MM-dd")


def as_datetime(col: Column) -> Column:
    """Text or date to a naive timestamp; text that is none becomes null."""
    return col.try_cast("timestamp_ntz")


def month_key(col: Column) -> Column:
    return F.date_format(col, "yyyy-MM")


def day_label(col: Column) -> Column:
    return F.date_format(col, "MMM dd, yyyy")


def micros_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end)


def hours_between(start: Column, end: Column) -> Column:
    """Fractional hours from ``start`` to ``end``."""
    return micros_between(start, end) / F.lit(3.6e9)


def days_between(start: Column, end: Column) -> Column:
    """Fractional days: the hours over 24."""
    return hours_between(start, end) / F.lit(24)


def whole_days_between(start: Column, end: Column) -> Column:
    """Whole 24-hour days, rounded down (not the number of midnights passed)."""
    return F.floor(micros_between(start, end) / F.lit(8.64e10))


def overlaps(start: Column, end: Column, lo: Column, hi: Column) -> Column:
    """Whether ``[start, end]`` and ``[lo, hi]`` share a point, all ends closed."""
    return (lo <= end) & (hi >= start)
