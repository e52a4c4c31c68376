"""Day and month keys of epoch seconds and timestamps, in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def moment(epoch: Column) -> Column:
    """Epoch seconds as a timestamp; 0 counts as missing."""
    return F.when(epoch != 0, F.timestamp_seconds(epoch))


def day_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def month_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def age_days(ts: Column, as_of: Column) -> Column:
    """Whole days, rounded down; negative for the future."""
    return F.floor((F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))) / 86_400_000_000).cast("long")


def relative(days: Column) -> Column:
    """today, yesterday, n days ago, n months ago."""
    months = F.floor(days / 30)
    return F.when(days <= 0, "today").when(days == 1, "yesterday").when(days < 60, F.format_string("%d days ago", days.cast("long"))).otherwise(F.format_string("%d months ago", months.cast("long")))
