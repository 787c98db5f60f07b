"""Search, lookup and projection of stations. ``ord`` is a station's place in its catalog; ties go to the lowest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo


def _has(text: Column, term: str) -> Column:
    return F.coalesce(F.contains(F.lower(text), F.lit(term)), F.lit(False))


def tide_matches(terms: list[str]) -> Column:
    """Every term is a station's id or lies in one of its other names, region, name or public id.

    A station without other names is found by its id alone.
    """
    out = F.lit(True)
    for term in terms:
        t = term.lower()
        others = F.exists("alternate_names", lambda n: F.coalesce(F.contains(F.lower(n), F.lit(t)), F.lit(False)))
        some = F.col("alternate_names").isNotNull() & (others | _has(F.col("region"), t) | _has(F.col("name"), t) | _has(F.col("public_id"), t))
        out = out & (F.coalesce(F.lower("id") == t, F.lit(False)) | F.coalesce(some, F.lit(False)))
    return out


def current_matches(terms: list[str]) -> Column:
    """Every term begins a station's bid or lies in its id, name or region."""
    out = F.lit(True)
    for term in terms:
        t = term.lower()
        out = out & (F.coalesce(F.startswith(F.lower("bid"), F.lit(t)), F.lit(False)) | _has(F.col("id"), t) | _has(F.col("name"), t) | _has(F.col("region"), t))
    return out


def within(stations: DataFrame, lat: float, lon: float, radius: float, units: str = "mi") -> DataFrame:
    """Stations within a whole number of ``units`` of a place; a band of latitudes is cut out first, which a scan can push down."""
    reach = int(radius)
    degrees = reach / (geo.MILES_PER_KM if units == "mi" else 1.0) / 111.0 + 0.01
    near = stations.where(F.col("lat").between(lat - degrees, lat + degrees))
    return near.where(geo.haversine(F.lit(lat), F.lit(lon), F.col("lat"), F.col("lon"), units) <= reach)


def dedupe_by_depth(stations: DataFrame, key: str = "id") -> DataFrame:
    """Of each id the row of the least depth, a missing depth counting as 0."""
    best = stations.groupBy(key).agg(F.min_by(F.struct("*"), F.struct(F.coalesce("depth", F.lit(0.0)), F.col("ord"))).alias("_b"))
    return best.select("_b.*")


def find_tides(stations: DataFrame, terms: list[str], radius: float | None = None, units: str = "mi") -> DataFrame:
    """Stations that match all terms; with a radius and a single hit, all stations around it (a hit without a place has none)."""
    hits = stations.where(tide_matches(terms)) if terms else stations
    return hits if radius is None else _around_single(stations, hits, radius, units)


def find_currents(stations: DataFrame, terms: list[str], radius: float | None = None, units: str = "mi") -> DataFrame:
    hits = dedupe_by_depth(stations.where(current_matches(terms)) if terms else stations)
    return hits if radius is None else _around_single(stations, hits, radius, units)


def _around_single(stations: DataFrame, hits: DataFrame, radius: float, units: str) -> DataFrame:
    found = hits.select("lat", "lon").limit(2).collect()  # two rows at most
    if len(found) != 1:
        return hits
    lat, lon = found[0]
    return hits.where(F.lit(False)) if lat is None or lon is None else within(stations, lat, lon, radius, units)


def lookup(stations: DataFrame, id_: str, aliases: DataFrame | None = None, by: tuple[str, ...] = ("id",)) -> DataFrame:
    """The first station with an id (or bid); else the one that an alias (alias, id) stands for; a blank id finds none."""
    if not id_ or not id_.strip():
        return stations.where(F.lit(False))
    match = F.lit(False)
    for c in by:
        match = match | F.coalesce(F.col(c) == id_, F.lit(False))
    found = stations.where(match).withColumn("_rank", F.lit(0))
    if aliases is not None:
        other = stations.join(F.broadcast(aliases.where(F.col("alias") == id_).select("id").limit(1)), "id", "left_semi")
        found = found.unionByName(other.withColumn("_rank", F.lit(1)))
    return found.orderBy("_rank", "ord").limit(1).drop("_rank")


def autocomplete(stations: DataFrame, query: str, most: int = 10) -> DataFrame:
    """Up to ``most`` stations whose name or region holds the query, one of each name and region; a query below 2 characters finds none."""
    q = query.strip().lower()
    if len(q) < 2:
        return stations.where(F.lit(False))
    hits = stations.where(_has(F.col("name"), q) | _has(F.col("region"), q))
    first = Window.partitionBy("name", "region").orderBy("ord")
    return hits.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n").orderBy("ord").limit(most)


def station_ids(tides: DataFrame, currents: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """All ids that a calendar can be asked by: tide ids, current bids, aliases."""
    parts = tides.select(F.col("id").alias("id")).unionAll(currents.select(F.col("bid")))
    if aliases is not None:
        parts = parts.unionAll(aliases.select("alias"))
    return parts.where("id is not null").distinct()


def without(stations: DataFrame, removed: DataFrame, key: str = "id") -> DataFrame:
    """Stations whose id isn't among the removed ones."""
    return stations.join(removed.select(key).distinct(), key, "left_anti")


def route(query: str) -> tuple[str, object]:
    """("gps", (lat, lon)) for what looks like coordinates, else ("text", terms)."""
    import re

    from ..functions.coords import parse_gps
    from ..functions.text import search_terms

    if re.search(r"\d[°'.]\s*[\d\-nsew]", query, re.IGNORECASE) and (found := parse_gps(query)):
        return "gps", (float(found[0]), float(found[1]))
    return "text", search_terms(query)


#: Kinds of stations that a request may name, and its units.
KINDS, UNITS, MOST_COMPARED = ("tides", "currents"), ("imperial", "metric"), 5


class BadRequest(ValueError):
    """A request that can't be answered; ``status`` is the number that a web service would give."""

    def __init__(self, status: int, message: str):
        super().__init__(message)
        self.status = status


def calendar_request(known: DataFrame, kind: str, id_: str, date=None, units: str = "imperial", solar: str | None = None, lunar: str | None = None) -> dict:
    """A calendar's parameters, checked: ``known`` (id) holds all ids. Sun rows are on unless ``solar`` is 0 or false, moon rows off unless ``lunar`` is 1 or true; a date that isn't one is today."""
    import datetime as dt

    if kind not in KINDS:
        raise BadRequest(404, f"no such kind: {kind}")
    if known.where(F.col("id") == id_).isEmpty():
        raise BadRequest(404, f"no such station: {id_}")
    if units not in UNITS:
        raise BadRequest(422, f"no such units: {units}")
    try:
        day = dt.date.fromisoformat(str(date))
    except ValueError:
        day = dt.datetime.now(dt.UTC).date()
    return {"kind": kind, "id": id_, "day": day, "units": units, "solar": solar not in ("0", "false"), "lunar": lunar in ("1", "true")}


def compare_request(kind: str, ids: list[str]) -> list[str]:
    """The ids of a comparison, checked: one to five of them."""
    if kind not in KINDS:
        raise BadRequest(400, "Invalid type")
    if not ids:
        raise BadRequest(400, "No station IDs provided")
    if len(ids) > MOST_COMPARED:
        raise BadRequest(400, f"Maximum {MOST_COMPARED} stations allowed")
    return list(ids)


def of_types(events: DataFrame, *types: str) -> DataFrame:
    """Events of the types, whatever their case."""
    return events.where(F.lower("type").isin(*(t.lower() for t in types)))


def between(events: DataFrame, begin, until, time: str = "ts") -> DataFrame:
    """Events from begin to until, both included."""
    at = lambda t: F.lit(t).cast("timestamp_ntz")
    return events.where((F.col(time) >= at(begin)) & (F.col(time) <= at(until)))


def only_constituents(stations: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Stations with those of their constituents alone that ``names`` has."""
    return stations.withColumn("constituents", F.filter("constituents", lambda c: c["name"].isin(*names)))
