"""All registered queries over the driver's tables, and the same results as SQL for DuckDB.

The driver's tables hold no tides, so operators get stand-ins that both sides make by
the same rule: stations from suppliers and customers, series from events, constituents
of a station from its number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import astro, coords, geo, text, timefn
from ..operators import calendar, cluster, events, harmonics, peaks, proximity, search
from . import sql

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(oracle: str | None = None):
    """Registers a query by its name, with SQL for the same result."""

    def add(f):
        _QUERIES[f.__name__] = f
        if oracle:
            _SQL[f.__name__] = oracle
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# -- stand-ins ------------------------------------------------------------------------------


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _place(key) -> dict:
    return {"lat": (key * 7919) % 16000 / 100.0 - 80.0, "lon": (key * 104729) % 36000 / 100.0 - 180.0}


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    where = _place(k)
    provider = F.get(F.array(*[F.lit(p) for p in ("noaa", "chs", "xtide", "ticon", "other")]), (k % 5).cast("int"))
    return s.select(
        k.alias("id"), k.alias("ord"), F.col("s_name").alias("name"), where["lat"].alias("lat"), where["lon"].alias("lon"), provider.alias("provider"),
        F.when(k % 7 != 0, (k % 3).cast("double") * 10).alias("depth"), F.concat(F.lit("Region "), (k % 11).cast("string")).alias("region"),
    )


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    where = _place(F.col("c_custkey"))
    return c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), where["lat"].alias("lat"), where["lon"].alias("lon"), "c_mktsegment", "c_nationkey")


def series(spark: SparkSession, sf_dir: str, shift: float = 0.0) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("key"), "ts", (F.col("value") - shift).alias("value"), F.col("event_type").alias("type"), "event_id")


def harmonic_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as stations with five constituents each."""
    k = F.col("n_nationkey")
    parts = [F.struct(F.lit(name).alias("name"), ((k * 37 + i * 11) % 40 / 10.0 + 0.1).alias("amp"), ((k * 53 + i * 71) % 360).cast("double").alias("phase")) for i, name in enumerate(sql.STATION_CONSTITUENTS)]
    return read(spark, sf_dir, "nation").select(k.cast("long").alias("station_id"), F.lit(0.0).alias("datum"), F.array(*parts).alias("constituents"))


def _windows(stations: DataFrame, begin: str, until: str) -> DataFrame:
    at = lambda t: F.lit(t).cast("timestamp_ntz")
    return stations.select("station_id", at(begin).alias("begin"), at(until).alias("until"))


def _seconds(ts) -> object:
    """A time as whole seconds since 1970, rounded."""
    return F.round(timefn.micros_between(F.lit("1970-01-01").cast("timestamp_ntz"), ts) / 1e6).cast("long")


# -- synthesis ------------------------------------------------------------------------------


def _order_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("day")).distinct()


def _factors(spark: SparkSession, days: DataFrame) -> DataFrame:
    out = harmonics.nodal_factors(days, harmonics.constituents(spark))
    turn = lambda c: F.round(F.pmod(F.round(F.pmod(F.col(c), F.lit(360.0)), 5), F.lit(360.0)), 5)
    return out.select("day", "name", F.round("f", 6).alias("f"), turn("u").alias("u"), turn("v0").alias("v0"))


@query(sql.nodal_factors())
def nodal_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Node factors of all constituents on every day that has orders."""
    return _factors(spark, _order_days(spark, sf_dir))


@query(sql.predictions(900, "2026-02-03 00:00:00", "2026-02-05 00:00:00", "SELECT station_id, ts, round(height, 4) AS height FROM p"))
def harmonic_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = harmonic_stations(spark, sf_dir)
    out = harmonics.predict(s, _windows(s, "2026-02-03 00:00:00", "2026-02-05 00:00:00"), harmonics.constituents(spark), 900)
    return out.select("station_id", "ts", F.round("height", 4).alias("height"))


@query(sql.predictions(60, "2026-02-03 00:00:00", "2026-02-05 00:00:00", sql.NEXT_PEAKS))
def tide_next_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Next high and low water of each station after a moment."""
    s = harmonic_stations(spark, sf_dir)
    points = harmonics.predict(s, _windows(s, "2026-02-03 00:00:00", "2026-02-05 00:00:00"), harmonics.constituents(spark), 60)
    found = peaks.next_events(peaks.extrema(points, "station_id", "ts", "height"), "station_id", "type", "ts", "2026-02-03 06:00:00", ["High", "Low"], ("height",))
    return found.select("station_id", "type", _seconds(F.col("ts")).alias("second"), F.round("height", 3).alias("height"))


def _optimized(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = harmonic_stations(spark, sf_dir)
    return harmonics.peaks_coarse_to_fine(s, _windows(s, "2026-02-03 00:00:00", "2026-02-04 00:00:00"), harmonics.constituents(spark))


def _rounded(found: DataFrame) -> DataFrame:
    return found.select("station_id", "type", _seconds(F.col("ts")).alias("second"), F.round("height", 3).alias("height"))


@query(sql.predictions(60, "2026-02-03 00:00:00", "2026-02-04 00:00:00", sql.DENSE_PEAKS))
def tide_peaks_optimized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coarse-to-fine peaks of a day; the SQL makes the dense grid."""
    return _rounded(_optimized(spark, sf_dir))


@query(sql.predictions(900, "2026-02-03 00:00:00", "2026-02-05 00:00:00", sql.CURRENTS))
def current_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = harmonic_stations(spark, sf_dir)
    points = harmonics.predict(s, _windows(s, "2026-02-03 00:00:00", "2026-02-05 00:00:00"), harmonics.constituents(spark), 900)
    out = harmonics.current_events(points)
    return out.select("station_id", "type", _seconds(F.col("ts")).alias("second"), F.round("velocity", 3).alias("velocity"))


@query(sql.predictions(900, "2026-01-31 18:00:00", "2026-02-01 12:00:00", "SELECT station_id, ts, round(height, 4) AS height FROM p", ("M4", 57.9682084)))
def harmonic_predict_missing_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A constituent without factors counts with f 1, u 0 and v0 0, one without a speed not at all; over a month's end."""
    s = harmonic_stations(spark, sf_dir)
    k = F.col("station_id")
    more = [F.struct(F.lit("M4").alias("name"), (k % 7 / 10.0 + 0.2).alias("amp"), (k * 19 % 360).cast("double").alias("phase")), F.struct(F.lit("NONE").alias("name"), F.lit(5.0).alias("amp"), F.lit(0.0).alias("phase"))]
    s = s.withColumn("constituents", F.concat("constituents", F.array(*more)))
    out = harmonics.predict(s, _windows(s, "2026-01-31 18:00:00", "2026-02-01 12:00:00"), harmonics.constituents(spark), 900)
    return out.select("station_id", "ts", F.round("height", 4).alias("height"))


@query(sql.SUBORDINATE)
def subordinate_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref = peaks.extrema(series(spark, sf_dir), "key", "ts", "value", refine=False).select(F.col("key").alias("station_id"), "type", "ts", "height")
    s = read(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    subs = s.select(
        (k + 1000).alias("station_id"), ((k % 40) + 1).alias("ref_key"), ((k % 90) * 60.0).alias("high_seconds"), (-(k % 60) * 60.0).alias("low_seconds"),
        (0.5 + (k % 10) / 10.0).alias("high_mult"), (1.0 - (k % 5) / 10.0).alias("low_mult"),
        F.lit("2024-01-02 00:00:00").cast("timestamp_ntz").alias("begin"), F.lit("2024-01-25 00:00:00").cast("timestamp_ntz").alias("until"),
    )
    return harmonics.subordinate(ref, subs)


# -- series ---------------------------------------------------------------------------------


@query(sql.extrema(True))
def peaks_parabolic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return peaks.extrema(series(spark, sf_dir), "key", "ts", "value")


@query(sql.extrema(False))
def peaks_coarse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return peaks.extrema(series(spark, sf_dir), "key", "ts", "value", refine=False)


@query(sql.CROSSINGS)
def zero_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return peaks.zero_crossings(series(spark, sf_dir, 50.0), "key", "ts", "value")


@query(sql.LAG_TYPES)
def lag_type_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return peaks.infer_types(series(spark, sf_dir).select("key", "ts", "value", "event_id"), "key", "ts", "value")


@query(sql.next_events())
def next_event_per_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return peaks.next_events(series(spark, sf_dir), "key", "type", "ts", sql.NOW, None, ("value",))


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = series(spark, sf_dir)
    kind = F.when(F.col("value") >= 50, "High").otherwise("Low")
    part = lambda m: e.where(F.col("event_id") % 2 == m).select((F.col("key") % 20).alias("key"), kind.alias("type"), "ts", "value")
    return part(0), part(1)


@query(sql.matches("SELECT key, type, l_ts, l_value, r_ts, r_value, seconds FROM m"))
def asof_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.match_first(*_halves(spark, sf_dir))


@query(sql.matches(sql.ERROR_STATS))
def error_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.error_stats(events.match_first(*_halves(spark, sf_dir)))


@query(sql.matches(sql.MACRO))
def macro_rms(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = events.error_stats(events.match_first(*_halves(spark, sf_dir)))
    return events.macro_average(stats.withColumn("provider", F.concat(F.lit("p"), (F.col("key") % 4).cast("string"))))


@query()
def greedy_match_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.match_greedy(*_halves(spark, sf_dir))


def _upcoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = peaks.next_events(series(spark, sf_dir), "key", "type", "ts", sql.NOW, None, ("value",))
    return e.withColumn("idx", F.row_number().over(Window.partitionBy("key").orderBy("ts", "type")))


def _compared(e: DataFrame) -> DataFrame:
    return events.compare(e.where("key = 1"), e.where("key <> 1"))


@query(sql.COMPARE)
def compare_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compared(_upcoming(spark, sf_dir))


@query(sql.FIRST_DELTA)
def summary_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.first_delta(compare_events(spark, sf_dir))


@query(sql.VARIANCE)
def variance_to_primary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.variance(_upcoming(spark, sf_dir), 1)


# -- stations -------------------------------------------------------------------------------


@query(sql.RADIUS)
def radius_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.within(customers(spark, sf_dir), 42.36, -71.06, 900.7, "mi")
    return found.select("id", "name", F.round(geo.haversine(F.lit(42.36), F.lit(-71.06), F.col("lat"), F.col("lon"), "mi"), 4).alias("miles"))


@query(sql.PROXIMITY)
def proximity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = lambda d, p: d.select(*[F.col(c).alias(f"{p}_{c}") for c in ("id", "lat", "lon")])
    out = proximity.join_within(side(customers(spark, sf_dir), "l"), side(suppliers(spark, sf_dir), "r"), 350.0)
    return out.select("l_id", "r_id", F.round("km", 4).alias("km"))


@query(sql.NEAREST_GRID)
def nearest_region_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = proximity.nearest_grid(customers(spark, sf_dir), suppliers(spark, sf_dir), 10.0)
    return found.select("id", "region", F.round("km", 4).alias("km"))


@query(sql.NEAREST_EXACT)
def nearest_region_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = proximity.nearest_exact(customers(spark, sf_dir), suppliers(spark, sf_dir))
    return found.select("id", "region", F.round("km", 4).alias("km"))


@query(sql.APPLY_REGIONS)
def apply_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = customers(spark, sf_dir).select("id", F.lit("United States").alias("region"))
    told = suppliers(spark, sf_dir).select("id", F.when(F.col("id") % 4 == 0, "United States").when(F.col("id") % 9 != 0, F.col("region")).alias("region"))
    return proximity.apply_regions(c, told)


@query(sql.FIRST_BOX)
def first_match_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proximity.first_in_box(customers(spark, sf_dir), suppliers(spark, sf_dir), 6.0)


@query(sql.LEADERS)
def leader_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.proximity_groups(suppliers(spark, sf_dir), 2_500_000.0)


@query(sql.GROUPS)
def primary_and_alternatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = suppliers(spark, sf_dir)
    groups = s.select("id", (F.col("id") % 17).alias("leader"))
    out = cluster.station_groups(s, groups)
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return out.select("leader", "primary", joined("alternatives").alias("alternatives"), F.col("n").cast("long").alias("n"), joined("depths").alias("depths"), "has_multiple_depths")


@query(sql.DEDUPE_DEPTH)
def dedupe_min_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    rows = li.select(F.col("l_partkey").alias("id"), F.when(F.col("l_linenumber") != 3, F.col("l_quantity")).alias("depth"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))
    return search.dedupe_by_depth(rows)


@query(sql.TEXT_SEARCH)
def text_search_all_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    k = F.col("p_partkey")
    stations = p.select(k.cast("string").alias("id"), F.when(k % 5 != 0, F.array("p_brand", F.lit(None).cast("string"))).alias("alternate_names"), F.col("p_name").alias("name"), F.col("p_type").alias("region"), F.concat(F.lit("pub"), k.cast("string")).alias("public_id"))
    return search.find_tides(stations, sql.SEARCH_TERMS).select("id", "name")


@query(sql.CURRENT_SEARCH)
def current_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    k = F.col("p_partkey")
    stations = p.select(F.concat(F.lit("ACT"), (k % 300).cast("string")).alias("id"), F.concat(F.lit("ACT"), (k % 300).cast("string"), F.lit("_"), (k % 7).cast("string")).alias("bid"), F.col("p_name").alias("name"), F.col("p_type").alias("region"), F.when(k % 4 != 0, (k % 50).cast("double")).alias("depth"), k.alias("ord"))
    return search.find_currents(stations, ["act1"]).select("id", "bid", "depth", "ord")


@query(sql.AUTOCOMPLETE)
def autocomplete(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.col("p_brand").alias("region"), F.col("p_partkey").alias("ord"))
    return search.autocomplete(p, sql.AUTOCOMPLETE_TERM).select("name", "region", "ord")


@query(sql.LOOKUP)
def station_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = suppliers(spark, sf_dir).withColumn("id", F.concat(F.lit("S"), F.col("ord").cast("string")))
    aliases = s.select(F.concat(F.lit("old-"), F.col("id")).alias("alias"), "id")
    one = search.lookup(s, "S7", aliases).unionByName(search.lookup(s, "old-S9", aliases)).unionByName(search.lookup(s, " ", aliases))
    return one.select("id", "name")


def _named_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    k = F.col("p_partkey")
    return p.select(
        k.alias("id"), k.alias("ord"), F.col("p_type").alias("name"), ((k % 9) * 0.04).alias("lat"), ((k % 4) * 0.03).alias("lon"), F.when(k % 2 == 0, "ticon").otherwise("xtide").alias("provider"),
        F.when(k % 2 == 0, "m").otherwise("ft").alias("units"), F.array(F.struct(F.lit("M2").alias("name"), F.when(k % 2 == 0, 0.3048 * (k % 3)).otherwise((k % 3).cast("double")).alias("amp"), F.lit(10.0).alias("phase"))).alias("constituents"),
    )


@query()
def name_key_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.deduplicate(_named_parts(spark, sf_dir))


@query(sql.COORD_IDS)
def coord_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suppliers(spark, sf_dir).select("id", text.coordinate_id("X", F.col("lat"), F.col("lon")).alias("coord_id"))


@query(sql.ROLLUP)
def constituent_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    names = F.array(*[F.lit(x) for x in sql.STATION_CONSTITUENTS])
    rows = li.select(F.col("l_suppkey").alias("id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), F.concat(F.lit("Station "), F.col("l_suppkey").cast("string")).alias("name"), F.lit(1.5).alias("lat"), F.lit(2.5).alias("lon"), F.get(names, (F.col("l_partkey") % 5).cast("int")).alias("constituent"), F.col("l_quantity").alias("amp"), F.col("l_extendedprice").alias("phase"))
    out = cluster.roll_up_constituents(rows)
    told = F.array_join(F.transform("constituents", lambda c: F.concat(c["name"], F.lit("="), F.round(c["amp"], 1).cast("int").cast("string"))), ",")
    return out.select("id", "name", told.alias("constituents"), "datum")


@query(sql.STATION_IDS)
def provider_union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = suppliers(spark, sf_dir).select((F.col("id") % 60).cast("string").alias("id"))
    c = customers(spark, sf_dir).select((F.col("id") % 90).cast("string").alias("bid"))
    a = read(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("alias"))
    return search.station_ids(t, c, a)


@query(sql.WITHOUT)
def removed_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = suppliers(spark, sf_dir)
    return search.without(s, s.where("id % 3 = 0")).select("id", "name")


@query(sql.SEARCH_COUNTS)
def search_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = suppliers(spark, sf_dir)
    return s.groupBy("provider").agg(F.count(F.lit(1)).alias("n"), F.count("depth").alias("n_with_depth"), F.round(F.sum("depth"), 2).alias("sum_depth"))


# -- scalars --------------------------------------------------------------------------------


@query(sql.UNITS)
def unit_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("v"), F.when(F.col("l_linenumber") % 2 == 0, "ft").otherwise("m").alias("u"))
    return li.select("l_orderkey", "l_linenumber", text.convert_depth(F.col("v"), F.col("u"), F.lit("ft")).alias("in_ft"), text.convert_depth(F.col("v"), F.col("u"), F.lit("m")).alias("in_m"))


@query(sql.TIME_TEXT)
def time_delta_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("event_id", ((F.col("event_id") * 97) % 20011 - 10000).alias("s"))
    return e.select("event_id", text.time_delta(F.col("s")).alias("delta"), text.signed_seconds(F.col("s").cast("double")).alias("signed"))


@query(sql.HEIGHT_TEXT)
def height_delta_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("event_id", (((F.col("event_id") * 7) % 201 - 100) / 10.0).alias("d"))
    return e.select("event_id", text.height_delta(F.col("d"), F.lit("ft")).alias("delta"), text.card_value(F.col("d"), F.lit("ft"), F.col("event_id") % 2 == 0).alias("card"))


@query(sql.NAME_PARTS)
def name_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth, state, clean name and region of names made from parts."""
    p = read(spark, sf_dir, "part")
    k = F.col("p_partkey")
    tail = F.get(F.array(F.lit(", Maine"), F.lit(", MA"), F.lit(""), F.lit(", Washington Current")), (k % 4).cast("int"))
    name = F.concat(F.col("p_name"), F.when(k % 3 == 0, F.concat(F.lit(" (depth "), (k % 80).cast("string"), F.lit(" ft)"))).otherwise(""), tail)
    rows = p.select(k.alias("id"), name.alias("name"), F.when(k % 4 == 3, "current").otherwise("tide").alias("kind"))
    bare = F.regexp_replace("name", " Current$", "")
    state = text.state_of(bare)
    return rows.select("id", text.depth_in_name(F.col("name")).alias("depth"), state.alias("state"), text.clean_name(F.col("name"), F.col("kind"), state).alias("clean"), text.region_label(state, F.when(F.col("id") % 5 != 0, F.lit("USA"))).alias("region"), text.name_key(F.col("name")).alias("key"), text.titleize(F.lower("name")).alias("title"))


@query(sql.OFFSETS)
def offset_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey").cast("int")
    rows = read(spark, sf_dir, "supplier").select("s_suppkey", F.when(k % 11 != 0, (k * 37) % 2400 - 1200).alias("m"))
    minutes = text.minutes_offset(F.col("m"))
    return rows.select("s_suppkey", minutes.alias("minutes"), text.zone_offset(F.col("m")).alias("zone"), text.offset_seconds(minutes).alias("seconds"), F.round(text.meridian_hours(minutes), 6).alias("hours"))


@query(sql.CHS)
def chs_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customers(spark, sf_dir).select("id", geo.chs_region(F.col("lat"), F.col("lon")).alias("region"))


@query(sql.ZONES)
def tz_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = customers(spark, sf_dir).withColumn("region", F.get(F.array(F.lit("Pacific Canada"), F.lit("Alaska coast"), F.lit("Nowhere"), F.lit("Japan")), (F.col("id") % 4).cast("int")))
    c = c.withColumn("location", F.when(F.col("id") % 5 == 0, "Tampa Bay, FL").when(F.col("id") % 7 == 0, "Somewhere, ZZ"))
    return c.select("id", geo.timezone_fallback(F.col("region"), F.col("location"), F.col("lon")).alias("tz"), F.round(geo.normalize_lon(F.col("lon") + 540), 2).alias("lon"))


@query(sql.WINDOWS)
def window_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("d"))
    return o.select("o_orderkey", timefn.window_begin(F.col("d")).alias("begin"), timefn.window_end(F.col("d"), 13).alias("end13"), timefn.window_end(F.col("d"), 12).alias("end12"), timefn.month_stamp(F.col("d")).alias("month"), timefn.quarter_stamp(F.col("d")).alias("quarter"))


@query(sql.CACHE)
def cache_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey").cast("int")
    month = F.concat((F.lit(2020) + k % 8).cast("string"), F.lpad((k % 12 + 1).cast("string"), 2, "0"))
    name = F.when(k % 3 == 0, F.concat(F.lit("tides_v2_"), k.cast("string"), F.lit("_"), month, F.lit(".json"))).when(k % 3 == 1, F.concat(F.lit("stations_v1_"), F.substring(month, 1, 4), F.lit("Q"), (k % 4 + 1).cast("string"), F.lit(".json"))).otherwise(F.concat(F.lit("lunar_phases_"), F.substring(month, 1, 4), F.lit(".json")))
    return read(spark, sf_dir, "supplier").select("s_suppkey", name.alias("name")).withColumn("stale", text.cache_stale(F.col("name"), F.lit("202501"), F.lit("2025Q1"), F.lit("2025")))


@query(sql.GPS)
def gps_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(sql.GPS_CASES)], "i int, txt string")
    found = rows.select("i", coords.gps(F.col("txt")).alias("g"))
    return found.select("i", F.round("g.lat", 5).alias("lat"), F.round("g.lon", 5).alias("lon"))


# -- sky and calendars ----------------------------------------------------------------------


@query(sql.lunar(2024, 2025, "SELECT ts, type FROM ph"))
def lunar_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendar.lunar_phases(spark, 2024, 2025)


@query(sql.MOON_LIGHT)
def moon_illumination(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = read(spark, sf_dir, "orders").select(F.date_trunc("DAY", "o_orderdate").cast("timestamp_ntz").alias("ts")).distinct()
    a = astro.phase_angle(F.col("ts"))
    return days.select("ts", F.round(a, 4).alias("angle"), F.round(astro.illuminated(a), 6).alias("light"), astro.phase_name(a).alias("phase"))


@query(sql.SOLAR)
def solar_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = suppliers(spark, sf_dir).select(F.col("id").alias("station_id"), "lat", "lon", F.col("name").alias("location"))
    out = calendar.solar_rows(s, "2025-06-01", "2025-06-10")
    return out.select("station_id", "summary", "dtstart", "location")


@query(sql.TIDE_CALENDAR)
def calendar_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tide and lunar rows of all stations' calendars."""
    e = peaks.extrema(series(spark, sf_dir), "key", "ts", "value", refine=False)
    ev = e.select(F.col("key").alias("station_id"), "type", F.lit("m").alias("units"), F.round("height", 1).alias("prediction"), F.col("ts").alias("time"), F.concat(F.lit("https://example.org/"), F.col("key").cast("string")).alias("url"))
    s = suppliers(spark, sf_dir).select(F.col("id").alias("station_id"), F.col("name").alias("location"))
    tides = calendar.tide_rows(ev, s)
    moons = calendar.lunar_rows(calendar.lunar_phases(spark, 2024, 2025), s, "2024-12-01", "2025-12-28")
    return tides.unionByName(moons).select("station_id", "summary", "description", "dtstart", "dtend", "url", "location")


@query(sql.CURRENT_CALENDAR)
def current_calendar_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = series(spark, sf_dir)
    kind = F.get(F.array(F.lit("flood"), F.lit("slack"), F.lit("ebb")), (F.col("event_id") % 3).cast("int"))
    # tenths are rounded as whole numbers: F.round(x, 1) goes by the shortest decimals of x, and 13.149999999999999 (18.15 - 5) would give 13.1
    velocity = F.round((F.col("value") / 10 - 5) * 10) / 10
    ev = e.select(F.col("key").alias("station_id"), kind.alias("type"), velocity.alias("velocity"), F.lit(90).alias("flood_dir"), F.lit(270).alias("ebb_dir"), F.when(F.col("event_id") % 2 == 0, 15).alias("depth"), F.col("ts").alias("time"))
    s = suppliers(spark, sf_dir).select(F.col("id").alias("station_id"), "name", F.concat(F.lit("B"), F.col("id").cast("string")).alias("bid"), F.lit("https://example.org/c").alias("url"))
    return calendar.current_rows(ev, s).select("station_id", "summary", "dtstart", "url", "location")
