"""Time arithmetic on microsecond positions.

Operators place every revision on a long `at` (microseconds since the epoch), so cuts are integer
comparisons: "strictly before p" is "at most p - 1".
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR = 3_600_000_000
DAY = 24 * HOUR
# Fixed value: days in a mean calendar year.
YEAR_DAYS = 365.2425


def micros(ts: Column | str) -> Column:
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def day_number(at: Column) -> Column:
    """Whole days since the epoch, flooring towards minus infinity."""
    return F.floor(at / F.lit(DAY)).cast("long")


def day_end(at: Column) -> Column:
    """Last microsecond of the calendar day holding `at`."""
    return at - F.pmod(at, F.lit(DAY)) + F.lit(DAY - 1)


def elapsed_days(later: Column, earlier: Column) -> Column:
    """Elapsed whole days, floored (a gap of -1 hour is day -1)."""
    return F.floor((later - earlier) / F.lit(DAY)).cast("long")


def elapsed_hours(later: Column, earlier: Column) -> Column:
    """Hours between two positions, rounded half to even; 0 when there is no earlier row."""
    return F.bround(F.abs(F.coalesce(later - earlier, F.lit(0))) / F.lit(float(HOUR)), 0)


def whole_years(later: Column, earlier: Column) -> Column:
    return F.floor((later - earlier) / F.lit(YEAR_DAYS * DAY)).cast("long")
