"""Time literals, truncation and windows without a session time zone.

All chat timestamps are TIMESTAMP_NTZ (wall-clock, no zone). Literals are
built from text so they stay NTZ and constant-fold into the scan's pushed
filters; truncation uses field arithmetic, which does not depend on
``spark.sql.session.timeZone`` (``date_trunc`` would go through a zoned
timestamp).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR = dt.timedelta(hours=1)
DAY = dt.timedelta(days=1)


def utc_now() -> dt.datetime:
    """Default ``as_of``: the wall clock in UTC, without zone."""
    return dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)


def resolve_as_of(as_of: dt.datetime | None) -> dt.datetime:
    if as_of is None:
        return utc_now()
    if as_of.tzinfo is not None:
        as_of = as_of.astimezone(dt.timezone.utc).replace(tzinfo=None)
    return as_of


def ntz(value: dt.datetime | dt.date | str) -> Column:
    """A TIMESTAMP_NTZ literal (dates become midnight)."""
    if isinstance(value, dt.datetime):
        text = value.isoformat(sep=" ")
    elif isinstance(value, dt.date):
        text = value.isoformat() + " 00:00:00"
    else:
        text = value
    return F.lit(text).cast("timestamp_ntz")


def truncate_hour(value: dt.datetime) -> dt.datetime:
    return value.replace(minute=0, second=0, microsecond=0)


def truncate_day(value: dt.datetime) -> dt.datetime:
    return value.replace(hour=0, minute=0, second=0, microsecond=0)


def hour_bucket(ts: Column | str) -> Column:
    """Start of the hour of an NTZ timestamp, as NTZ."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.make_timestamp_ntz(F.year(c), F.month(c), F.dayofmonth(c),
                                F.hour(c), F.lit(0), F.lit(0))


def day_bucket(ts: Column | str) -> Column:
    """Midnight of the day of an NTZ timestamp, as NTZ."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.to_date(c).cast("timestamp_ntz")


def epoch_micros(ts: Column | str) -> Column:
    """Microseconds from 1970-01-01 00:00 to an NTZ wall clock.

    Built from the calendar fields, which NTZ keeps as written, so no session
    time zone (and no DST gap) is involved.
    """
    c = F.col(ts) if isinstance(ts, str) else ts
    days = F.datediff(F.to_date(c), F.lit("1970-01-01").cast("date")).cast("long")
    secs = F.extract(F.lit("SECOND"), c)  # decimal(8,6), seconds with fraction
    return (days * F.lit(86_400_000_000) + F.hour(c).cast("long") * F.lit(3_600_000_000)
            + F.minute(c).cast("long") * F.lit(60_000_000)
            + (secs * F.lit(1_000_000)).cast("long"))


def micros_between(start: Column | str, end: Column | str) -> Column:
    """``end - start`` in microseconds for NTZ timestamps (zone-free)."""
    return epoch_micros(end) - epoch_micros(start)


def floor_minutes_between(start: Column | str, end: Column | str) -> Column:
    """Whole minutes from ``start`` to ``end``, rounded down (negative stays
    negative), as the UI computes ``Math.floor(ms / 60000)``."""
    micros = micros_between(start, end)
    return F.floor(micros / F.lit(60_000_000))


_EPOCH = "1970-01-01 00:00:00"


def ntz_to_instant(ts: Column | str) -> Column:
    """NTZ wall clock -> TIMESTAMP instant with the same UTC wall clock.

    Streaming watermarks and windows need a zoned TIMESTAMP; a plain cast
    would read the wall clock in the session time zone (shifting day windows
    and breaking at DST changes). This mapping ignores the session zone.
    """
    return F.timestamp_micros(epoch_micros(ts))


def instant_to_ntz(ts: Column | str) -> Column:
    """Inverse of ``ntz_to_instant`` (exact to the microsecond)."""
    c = F.col(ts) if isinstance(ts, str) else ts
    secs = (F.unix_micros(c).cast("decimal(24,6)") / F.lit(1_000_000)).cast("decimal(18,6)")
    return ntz(_EPOCH) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), secs)
