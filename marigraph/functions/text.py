"""Columns over names, ids, units and texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FEET_PER_METRE = 3.28084

#: Names of states and territories by abbreviation.
STATES = {
    "AL": "Alabama", "AK": "Alaska", "AZ": "Arizona", "AR": "Arkansas", "CA": "California", "CO": "Colorado", "CT": "Connecticut",
    "DE": "Delaware", "FL": "Florida", "GA": "Georgia", "HI": "Hawaii", "ID": "Idaho", "IL": "Illinois", "IN": "Indiana", "IA": "Iowa",
    "KS": "Kansas", "KY": "Kentucky", "LA": "Louisiana", "ME": "Maine", "MD": "Maryland", "MA": "Massachusetts", "MI": "Michigan",
    "MN": "Minnesota", "MS": "Mississippi", "MO": "Missouri", "MT": "Montana", "NE": "Nebraska", "NV": "Nevada", "NH": "New Hampshire",
    "NJ": "New Jersey", "NM": "New Mexico", "NY": "New York", "NC": "North Carolina", "ND": "North Dakota", "OH": "Ohio", "OK": "Oklahoma",
    "OR": "Oregon", "PA": "Pennsylvania", "RI": "Rhode Island", "SC": "South Carolina", "SD": "South Dakota", "TN": "Tennessee",
    "TX": "Texas", "UT": "Utah", "VT": "Vermont", "VA": "Virginia", "WA": "Washington", "WV": "West Virginia", "WI": "Wisconsin",
    "WY": "Wyoming", "DC": "District of Columbia", "PR": "Puerto Rico", "VI": "Virgin Islands", "GU": "Guam", "AS": "American Samoa",
    "MP": "Northern Mariana Islands",
}


def convert_depth(value: Column, units: Column, wanted: Column) -> Column:
    """Unchanged where the units agree, else to feet or, for any other wish, to metres, to 3 places."""
    return F.when(units == wanted, value).when(wanted == "ft", F.round(value * FEET_PER_METRE, 3)).otherwise(F.round(value / FEET_PER_METRE, 3))


def time_delta(seconds: Column) -> Column:
    """``0min``, ``+59min``, ``-2hr30min``: hours round down, so negative ones go to the next lower hour."""
    minutes = F.round(seconds / 60.0).cast("long")
    sign = F.when(seconds >= 0, "+").otherwise("")
    rest = F.abs(minutes) % 60
    long = F.concat(sign, F.floor(minutes / 60).cast("string"), F.lit("hr"), F.when(rest > 0, F.concat(rest.cast("string"), F.lit("min"))).otherwise(""))
    return F.when(F.abs(seconds) < 30, "0min").when(F.abs(minutes) >= 60, long).otherwise(F.concat(sign, minutes.cast("string"), F.lit("min")))


def height_delta(diff: Column, units: Column) -> Column:
    sign = F.when(diff >= 0, "+").otherwise("")
    return F.when(F.abs(diff) < 0.05, F.concat(F.lit("0"), units)).otherwise(F.concat(sign, diff.cast("string"), units))


def coordinate_id(prefix: str, lat: Column, lon: Column) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.format_string("%.8f_%.8f", lat, lon), 256), 1, 7))


def depth_in_name(name: Column) -> Column:
    """The number in ``(depth 30 ft)`` or ``(depth 9 m)``, else null; its unit isn't heeded."""
    return F.regexp_extract(name, r"(?i)\(depth (\d+)\s*(ft|m)\)", 1).try_cast("double")


def state_of(name: Column) -> Column:
    """Abbreviation of the first state, in the table's order, whose name or abbreviation ends the name after a comma."""
    found = F.lit(None).cast("string")
    for short, full in reversed(STATES.items()):
        found = F.when(name.rlike(rf"(?i),\s*({full}|{short})$"), short).otherwise(found)
    return found


def clean_name(name: Column, kind: Column, state: Column) -> Column:
    """The name without a current station's last word and without the state's full name at its end."""
    bare = F.when(kind == "current", F.regexp_replace(name, "(?i) Current$", "")).otherwise(name)
    table = F.create_map(*[F.lit(x) for kv in STATES.items() for x in kv])
    full = F.try_element_at(table, F.upper(F.coalesce(state, F.lit(""))))
    cut = F.regexp_replace(bare, F.concat(F.lit(r"(?i),\s*"), full, F.lit("$")), F.lit(""))
    return F.trim(F.coalesce(cut, bare))


def region_label(state: Column, country: Column) -> Column:
    """``State, Country``, else the country, else ``Unknown``."""
    return F.when(state.isNotNull() & country.isNotNull(), F.concat(state, F.lit(", "), country)).otherwise(F.coalesce(country, F.lit("Unknown")))


def zone_offset(hhmm: Column) -> Column:
    """An integer such as -530 as ``-05:30:00``; null and 0 as ``00:00:00``."""
    a = F.abs(hhmm)
    text = F.format_string("%s%02d:%02d:00", F.when(hhmm < 0, "-").otherwise("+"), F.floor(a / 100).cast("int"), (a % 100).cast("int"))
    return F.when(F.coalesce(hhmm, F.lit(0)) == 0, "00:00:00").otherwise(text)


def minutes_offset(minutes: Column) -> Column:
    a = F.abs(minutes)
    return F.when(minutes.isNotNull(), F.format_string("%s%02d:%02d:00", F.when(minutes < 0, "-").otherwise("+"), F.floor(a / 60).cast("int"), (a % 60).cast("int")))


def offset_seconds(text: Column) -> Column:
    """Seconds of ``[+-]HH:MM:SS``; 0 for null, blank and ``\\N``."""
    parts = F.split(F.regexp_replace(F.trim(text), "^[+-]", ""), ":")
    at = lambda k: F.coalesce(F.get(parts, k).try_cast("double"), F.lit(0.0))
    sign = F.when(F.trim(text).startswith("-"), -1).otherwise(1)
    return F.coalesce(sign * (at(0) * 3600 + at(1) * 60 + at(2)), F.lit(0.0))


def meridian_hours(text: Column) -> Column:
    return offset_seconds(text) / 3600


def name_key(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def titleize(name: Column) -> Column:
    """Words with a capital first letter; hyphens and underscores part words."""
    return F.initcap(F.translate(name, "-_", "  "))


def search_terms(query: str) -> list[str]:
    """Lower-cased terms of a search: quoted phrases first, then what commas, spaces and degree signs part."""
    import re

    text = query.lower()
    for mark in "“”„«»":
        text = text.replace(mark, '"')
    quoted = [x for x in re.findall(r'"([^"]*)"', text) if x.strip()]
    rest = re.sub(r'"[^"]*"', " ", text)
    return quoted + [x for x in re.split(r"[, °′'″\"]+", rest) if x]


def tide_title(kind: Column, height: Column, units: Column) -> Column:
    return F.concat(kind, F.lit(" Tide "), height.cast("string"), F.lit(" "), units)


def current_title(kind: Column, velocity: Column, flood_dir: Column, ebb_dir: Column, depth: Column) -> Column:
    """``Ebb 1.2kts 250T 15ft``, ``Flood …``, ``Slack``; missing parts are left empty."""
    some = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    ebb = F.concat(F.lit("Ebb "), F.abs(F.coalesce(velocity, F.lit(0.0))).cast("string"), F.lit("kts "), some(ebb_dir), F.lit("T "), some(depth), F.lit("ft"))
    flood = F.concat(F.lit("Flood "), some(velocity), F.lit("kts "), some(flood_dir), F.lit("T "), some(depth), F.lit("ft"))
    return F.when(kind == "ebb", ebb).when(kind == "flood", flood).when(kind == "slack", "Slack")


#: Our own wording of the note that goes with predictions from harmonic sources.
DISCLAIMER = "Not for navigation. Predicted from harmonic constants without any warranty; weather, seismic events and changes of the sea level are not considered."


def disclaimer(provider: Column) -> Column:
    return F.when(provider.isin("xtide", "ticon"), DISCLAIMER)


def event_url(url: Column, provider: Column, bid: Column, time: Column) -> Column:
    """The station's page at an event's day, as each provider's pages take it."""
    day = F.date_format(time, "yyyy-MM-dd")
    noaa = F.concat(url, F.lit("&bdate="), F.date_format(time, "yyyyMMdd"))
    current = F.concat(url, F.lit("?id="), bid, F.lit("&d="), day)
    return F.when(bid.isNotNull(), current).when(provider == "noaa", noaa).when(provider == "chs", F.concat(url, F.lit("/"), day)).otherwise(url)


def card_value(value: Column, units: Column, metric: Column) -> Column:
    """A value as a search card shows it: to one place, lengths in the wished units (0.3048 m a foot), knots as they are."""
    metres = F.lower(units).startswith("m")
    knots = F.lower(units).startswith("kn")
    shown = F.when(knots, value).when(metric & ~metres, value * 0.3048).when(~metric & metres, value / 0.3048).otherwise(value)
    unit = F.when(knots, "kn").when(metric, "m").otherwise("ft")
    return F.concat(F.round(shown, 1).cast("string"), F.lit(" "), unit)


def subscribe_url(base: Column, id_: Column, units: Column, solar: Column, lunar: Column) -> Column:
    return F.concat(base, id_, F.lit(".ics?units="), units, F.when(~solar, "&solar=0").otherwise(""), F.when(lunar, "&lunar=1").otherwise(""))


def signed_seconds(seconds: Column) -> Column:
    """``+1.5min`` from a minute on, else ``-20s``."""
    sign = F.when(seconds >= 0, "+").otherwise("-")
    a = F.abs(seconds)
    return F.when(a >= 60, F.concat(sign, F.round(a / 60, 1).cast("string"), F.lit("min"))).otherwise(F.concat(sign, F.round(a).cast("long").cast("string"), F.lit("s")))


def cache_stale(name: Column, month: Column, quarter: Column, year: Column) -> Column:
    """Whether a cache file is older than the given month (yyyyMM), quarter (yyyyQn) or year, by what its name holds; the month's rule first."""
    # fixed values: patterns of cache files' names
    m = F.regexp_extract(name, r"_(20\d{4})[_.]", 1)
    q = F.regexp_extract(name, r"_(20\d{2}Q\d)[_.]", 1)
    y = F.regexp_extract(name, r"lunar_phases_(\d{4})\.json", 1)
    return F.when(m != "", m < month).when(q != "", q < quarter).when(y != "", y < year).otherwise(False)
