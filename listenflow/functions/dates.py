"""Date helpers.  All timestamps are interpreted in UTC (session setting)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_DAY = 86_400_000_000


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def week_start(x) -> Column:
    """Monday of the ISO week containing ``x``, as a DATE."""
    return F.date_trunc("week", _c(x).cast("timestamp")).cast("date")


def elapsed_micros(start, end) -> Column:
    """``end - start`` in microseconds; DATEs count as midnight UTC."""
    return F.unix_micros(_c(end).cast("timestamp")) - F.unix_micros(_c(start).cast("timestamp"))


def elapsed_days(start, end) -> Column:
    """Floor of the elapsed time in days (pandas ``Timedelta.days``)."""
    return F.floor(elapsed_micros(start, end) / F.lit(float(MICROS_PER_DAY))).cast("long")
