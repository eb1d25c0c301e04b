"""Time functions. Zone-less timestamps are read as UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Assumed hours of a contest by its length, and for any other length.
HOURS = {1: 1.5, 3: 3.0, 5: 5.0}
DEFAULT_HOURS = 3.0
DAY = 86_400_000_000


def micros(ts: Column | str) -> Column:
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(ts.cast("timestamp"))


def estimated_end(start: Column | str, best_of: Column | str) -> Column:
    """Start plus the assumed duration; any length without one gets the default."""
    n = F.col(best_of) if isinstance(best_of, str) else best_of
    start = F.col(start) if isinstance(start, str) else start
    minutes = F.lit(int(DEFAULT_HOURS * 60))
    for games, hours in HOURS.items():
        minutes = F.when(n == games, F.lit(int(hours * 60))).otherwise(minutes)
    return start + F.make_dt_interval(mins=minutes)


def days_between(later: Column | str, earlier: Column | str) -> Column:
    return (micros(later) - micros(earlier)) / F.lit(float(DAY))


def half_year(ts: Column | str) -> Column:
    return F.concat(F.year(ts).cast("string"), F.when(F.month(ts) <= 6, "H1").otherwise("H2"))


def zone_to_utc(wall: Column | str, zone: str = "America/New_York") -> Column:
    """The UTC moment of a wall-clock time in ``zone``; the earlier one where clocks go back."""
    return F.to_utc_timestamp(wall, zone)


def parse_moment(text: Column | str) -> Column:
    """ISO text, with or without Z or an offset, as a UTC timestamp; null if it isn't one."""
    return F.try_to_timestamp(text)


def scope_bound(text: Column | str, end: bool = False) -> Column:
    """A date parameter as a moment: null if malformed, the last second of the day for an upper bound."""
    day = F.try_to_timestamp(text, F.lit("yyyy-MM-dd"))
    return day + F.make_dt_interval(hours=F.lit(23), mins=F.lit(59), secs=F.lit(59)) if end else day


def local_day(ts: Column | str, zone: str) -> Column:
    return F.to_date(F.from_utc_timestamp(ts, zone))
