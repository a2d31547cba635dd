"""Date windows, signup horizons and time slices."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# Width of the time slices that cut one user's or session's rows into pieces.
# A slice is the largest unit one task has to sort, so a user that holds a
# large share of all events is spread over (observed time / width) tasks.
SLICE_SECONDS = 900
# Visits are far fewer than events, so their slices are wider.
VISIT_SLICE_SECONDS = 4 * 3600

AsOf = dt.date | str | None


def as_of_date(as_of: AsOf) -> Column:
    """The report date: a literal, or today when not given."""
    if as_of is None:
        return F.current_date()
    return F.lit(str(as_of)).cast("date")


def since(ts: str | Column, as_of: AsOf, days: int) -> Column:
    """Calendar-date lookback: keeps ``days + 1`` dates and has no upper bound."""
    return F.to_date(ts) >= F.date_sub(as_of_date(as_of), days)


def within_horizon(ts: str | Column, signed_up: str | Column, hours: int) -> Column:
    """At most ``hours`` after signup, to the microsecond, end included."""
    return _col(ts) <= _col(signed_up) + hours_interval(hours)


def within_signup_days(ts: str | Column, signed_up: str | Column, days: int = 1) -> Column:
    """Signup horizon by calendar date: the whole last day counts."""
    return F.to_date(ts) <= F.date_add(F.to_date(signed_up), days)


def hours_interval(hours: int) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(hours))


def seconds_interval(seconds: int) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds))


def interval_seconds(interval: str | Column) -> Column:
    """A day-time interval as seconds; exact up to the last cast."""
    whole = (
        F.extract(F.lit("DAY"), interval).cast("bigint") * 86400
        + F.extract(F.lit("HOUR"), interval) * 3600
        + F.extract(F.lit("MINUTE"), interval) * 60
    )
    return (whole.cast("decimal(18,6)") + F.extract(F.lit("SECOND"), interval)).cast("double")


def slice_of(ts: str | Column, seconds: int = SLICE_SECONDS) -> Column:
    """Number of the time slice a zone-less timestamp falls in; NULL goes last."""
    return F.coalesce(F.floor((_epoch_minutes(ts) * 60 + F.second(ts)) / F.lit(seconds)), F.lit(2**62))


def epoch_millis(ts: str | Column) -> Column:
    """Milliseconds of a zone-less timestamp since 1970, rounded down."""
    return _epoch_minutes(ts) * 60000 + F.floor(F.extract(F.lit("SECOND"), ts) * 1000)


def _epoch_minutes(ts: str | Column) -> Column:
    days = F.date_diff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("bigint")
    return days * 1440 + F.hour(ts) * 60 + F.minute(ts)


def _col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value
