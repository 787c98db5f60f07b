"""Rows of calendars: tides, currents, sun and moon; and their text form."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import astro, text, timefn

COLUMNS = ("station_id", "summary", "description", "dtstart", "dtend", "url", "location")

#: Summary and share of light of the main phases.
MOON = {"new_moon": ("New Moon", 0), "first_quarter": ("First Quarter Moon", 50), "full_moon": ("Full Moon", 100), "last_quarter": ("Last Quarter Moon", 50)}


def tide_rows(events: DataFrame, stations: DataFrame, units: str = "imperial") -> DataFrame:
    """One row per high or low water (station_id, type, units, prediction, time, url) with the station's location."""
    want = F.lit("ft" if units == "imperial" else "m")
    title = text.tide_title(F.col("type"), text.convert_depth(F.col("prediction"), F.col("units"), want), want)
    met = events.join(stations.select("station_id", "location"), "station_id")
    return met.select("station_id", title.alias("summary"), F.lit(None).cast("string").alias("description"), F.col("time").alias("dtstart"), F.col("time").alias("dtend"), "url", "location")


def current_rows(events: DataFrame, stations: DataFrame) -> DataFrame:
    """One row per flood, ebb or slack (station_id, type, velocity, flood_dir, ebb_dir, depth, time); stations have name, bid and url."""
    met = events.join(stations.select("station_id", "name", "bid", F.col("url").alias("page")), "station_id")
    title = text.current_title(F.col("type"), F.col("velocity"), F.col("flood_dir"), F.col("ebb_dir"), F.col("depth"))
    url = F.concat("page", F.lit("?id="), "bid", F.lit("&d="), F.date_format("time", "yyyy-MM-dd"))
    location = F.concat("name", F.lit(" ("), "bid", F.lit(")"))
    return met.select("station_id", title.alias("summary"), F.lit(None).cast("string").alias("description"), F.col("time").alias("dtstart"), F.col("time").alias("dtend"), url.alias("url"), location.alias("location"))


def solar_rows(stations: DataFrame, begin, end) -> DataFrame:
    """Sunrise and sunset of each station (station_id, lat, lon, location) on each day, both ends included; none on days without one."""
    days = stations.select("station_id", "lat", "lon", "location", F.explode(F.sequence(F.lit(begin).cast("date"), F.lit(end).cast("date"))).alias("day"))
    hour = lambda rising: astro.sun_event_hours(F.col("day"), F.col("lat"), F.col("lon"), rising)
    both = days.select("*", F.explode(F.array(F.struct(F.lit("Sunrise").alias("summary"), hour(True).alias("h")), F.struct(F.lit("Sunset").alias("summary"), hour(False).alias("h")))).alias("e"))
    at = timefn.shift(F.col("day").cast("timestamp_ntz"), F.round(F.col("e.h") * 3600))
    rows = both.where("e.h is not null").select("station_id", "e.summary", at.alias("dtstart"), "location")
    return rows.select("station_id", "summary", F.lit(None).cast("string").alias("description"), "dtstart", F.col("dtstart").alias("dtend"), F.lit(None).cast("string").alias("url"), "location")


def lunar_phases(spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    """``ts, type`` of the main phases: the hours at which the elongation passes 0, 90, 180 or 270 degrees.

    Each year is scanned by itself from its second hour on.
    """
    years = spark.range(first_year, last_year + 1).select(F.col("id").cast("int").alias("year"))
    start = F.make_timestamp_ntz("year", F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    until = F.make_timestamp_ntz("year", F.lit(12), F.lit(31), F.lit(23), F.lit(0), F.lit(0))
    hours = years.select("year", F.explode(timefn.grid(start, until, 3600)).alias("ts")).withColumn("a", astro.phase_angle(F.col("ts")))
    w = Window.partitionBy("year").orderBy("ts")
    h = hours.withColumn("b", F.lag("a").over(w))
    passed = lambda t: (F.col("b") < t) & (F.col("a") >= t)
    kind = F.when((F.col("b") > 270) & (F.col("a") < 90), "new_moon").when(passed(90), "first_quarter").when(passed(180), "full_moon").when(passed(270), "last_quarter")
    return h.select("ts", kind.alias("type")).where("type is not null")


def lunar_rows(phases: DataFrame, stations: DataFrame, begin, end) -> DataFrame:
    """A row per phase and station (station_id, location) from ``begin`` to the midnight that begins ``end``; each lasts a second."""
    name = F.create_map(*[F.lit(x) for k, (n, _) in MOON.items() for x in (k, n)])
    share = F.create_map(*[F.lit(x) for k, (_, p) in MOON.items() for x in (k, f"Moon is {p}% illuminated")])
    inside = phases.where(F.col("ts").between(F.lit(begin).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))
    rows = inside.select(F.try_element_at(name, "type").alias("summary"), F.try_element_at(share, "type").alias("description"), F.col("ts").alias("dtstart"), timefn.shift(F.col("ts"), F.lit(1.0)).alias("dtend"))
    met = stations.select("station_id", "location").crossJoin(F.broadcast(rows))  # some fifty phases a year
    return met.select("station_id", "summary", "description", "dtstart", "dtend", F.lit(None).cast("string").alias("url"), "location")


def _escape(value: str) -> str:
    return value.replace("\\", "\\\\").replace(";", "\\;").replace(",", "\\,").replace("\n", "\\n")


def _fold(line: str) -> str:
    """Lines of at most 75 octets; those that follow begin with a space."""
    out, size = [], 0
    for ch in line:
        n = len(ch.encode())
        if size + n > 75:
            out.append("\r\n ")
            size = 1
        out.append(ch)
        size += n
    return "".join(out)


def to_ics(rows, name: str, description: str | None = None) -> str:
    """The text of a calendar from an iterable of rows with the columns of this module, in order of time."""
    stamp = lambda t: t.strftime("%Y%m%dT%H%M%SZ") if isinstance(t, datetime) else str(t)
    lines = ["BEGIN:VCALENDAR", "VERSION:2.0", "PRODID:-//marigraph//EN", "CALSCALE:GREGORIAN", "METHOD:PUBLISH", f"X-WR-CALNAME:{_escape(name)}"]
    if description:
        lines.append(f"DESCRIPTION:{_escape(description)}")
    for r in sorted(rows, key=lambda r: (r["dtstart"], r["summary"])):
        lines += ["BEGIN:VEVENT", f"DTSTART:{stamp(r['dtstart'])}", f"DTEND:{stamp(r['dtend'])}", f"SUMMARY:{_escape(r['summary'])}"]
        lines += [f"{key}:{_escape(r[c])}" for key, c in (("DESCRIPTION", "description"), ("LOCATION", "location")) if r[c]]
        lines += [f"URL:{r['url']}"] if r["url"] else []
        lines.append("END:VEVENT")
    return "\r\n".join(map(_fold, [*lines, "END:VCALENDAR"])) + "\r\n"
