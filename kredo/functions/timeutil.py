"""Time helpers.  ``as_of`` is always a parameter so runs repeat."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOCAL_ZONE = "Europe/Paris"


def as_of_col(as_of: str | None = None) -> Column:
    """Fixed instant (naive, local wall clock) or the current timestamp."""
    if as_of is None:
        return F.localtimestamp()
    return F.lit(as_of).cast("timestamp_ntz")


def to_local_naive(ts: Column, zone: str = LOCAL_ZONE, source_zone: str = "UTC") -> Column:
    """Wall clock of ``source_zone`` (UTC by default) becomes local
    wall-clock time of ``zone`` (DST handled by the zone rules)."""
    return F.convert_timezone(F.lit(source_zone), F.lit(zone), ts.cast("timestamp_ntz"))


def within_last(ts: Column, as_of: Column, hours: int) -> Column:
    """``ts > as_of - hours`` (strict, like ``NOW() - INTERVAL``)."""
    return ts > as_of - F.expr(f"INTERVAL {int(hours)} HOURS")


def older_than_days(ts: Column, as_of: Column, days: int) -> Column:
    return ts < as_of - F.expr(f"INTERVAL {int(days)} DAYS")


def local_day_start(as_of: Column) -> Column:
    """Local midnight of ``as_of``."""
    return F.to_date(as_of).cast("timestamp_ntz")


def date_to_days(date_str: Column, as_of: Column, default: int) -> Column:
    """T4/T5: 'yyyy-MM-dd' -> signed days from ``as_of`` (negative = past);
    empty or bad strings give ``default`` (-15000 birth, -500 employment)."""
    d = F.try_to_date(date_str, "yyyy-MM-dd")
    return F.coalesce(F.datediff(d, F.to_date(as_of)), F.lit(default))


def days_to_date(days: Column, as_of: Column) -> Column:
    """Signed day count -> calendar date."""
    return F.date_add(F.to_date(as_of), days)


def seconds_to_ms(c: Column) -> Column:
    """T8."""
    return c * F.lit(1000)
