"""Calendar rules: week starts, week differences, local dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def week_start(d, first_day: str = "SUN") -> Column:
    """First day of the week holding ``d``; weeks start on ``first_day``."""
    # next_day is strictly after d, so stepping back a week lands on d itself
    # when d already is the first day.
    return F.date_sub(F.next_day(_c(d), first_day), 7)


def week_diff_sunday(later, earlier) -> Column:
    """Number of Sunday boundaries crossed going from ``earlier`` to ``later``."""
    days = F.datediff(week_start(later), week_start(earlier))
    return (days / F.lit(7)).cast("int")


def local_date(ts, zone: str = "Australia/Sydney") -> Column:
    """Calendar date of a UTC instant in ``zone``."""
    return F.to_date(F.from_utc_timestamp(_c(ts).cast("timestamp"), zone))


def weekday_name(d) -> Column:
    return F.date_format(_c(d), "EEEE")


def within_dates_inclusive(ts, start, end) -> Column:
    """``start 00:00 <= ts <= midnight after end`` -- the closing midnight counts."""
    kind = "timestamp_ntz"
    return (_c(ts) >= _c(start).cast(kind)) & (_c(ts) <= F.date_add(_c(end), 1).cast(kind))
