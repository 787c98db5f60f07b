"""Columns over times: prediction windows, stamps, grids, shifts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Months that a provider's prediction window spans.
WINDOW_MONTHS = {"noaa_tides": 13, "noaa_currents": 12, "chs_tides": 12, "harmonics": 13, "default": 12}


def window_begin(around: Column) -> Column:
    """First day of the month before."""
    return F.add_months(F.trunc(around.cast("date"), "MM"), -1)


def window_end(around: Column, months: int) -> Column:
    """The month's last day moved on by ``months`` and back by two, each step held at the month's end."""
    return F.add_months(F.add_months(F.last_day(around.cast("date")), months), -2)


def month_stamp(day: Column) -> Column:
    return F.date_format(day, "yyyyMM")


def quarter_stamp(day: Column) -> Column:
    return F.concat(F.year(day).cast("string"), F.lit("Q"), F.quarter(day).cast("string"))


def seconds_between(start: Column, end: Column) -> Column:
    """Whole seconds from start to end, towards zero."""
    return F.timestamp_diff("SECOND", start, end)


def micros_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end)


def shift(ts: Column, seconds: Column) -> Column:
    """A time moved by a number of seconds, to the microsecond."""
    return F.timestamp_add("MICROSECOND", F.round(seconds * 1e6).cast("long"), ts)


def grid(start: Column, end: Column, step_seconds: int) -> Column:
    """All times from start to end, both included, as an array."""
    return F.sequence(start, end, F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(step_seconds)))


def clock_text(ts: Column, zone: Column | None = None) -> Column:
    """Hours and minutes of a UTC time, ``05:48 UTC``; with a zone in its local time, and its distance from GMT after it, ``21:48 GMT-8``."""
    if zone is None:
        return F.concat(F.date_format(ts, "HH:mm"), F.lit(" UTC"))
    local = F.convert_timezone(F.lit("UTC"), zone, ts)
    minutes = F.timestamp_diff("MINUTE", ts, local)
    rest = F.when(minutes % 60 != 0, F.format_string(":%02d", F.abs(minutes) % 60)).otherwise("")
    sign = F.when(minutes < 0, "-").otherwise("+")
    apart = F.when(minutes == 0, "").otherwise(F.concat(sign, F.floor(F.abs(minutes) / 60).cast("string"), rest))
    return F.concat(F.date_format(local, "HH:mm"), F.lit(" GMT"), apart)
