"""Water levels and currents by harmonic synthesis.

Node factors depend on the day alone, so they are worked out once for each day and
constituent, met with a station's constituents in an equi-join, and folded into one
array a station and day. Heights are then a fold over that array for each time of the
day's grid: no join or shuffle at the grid's resolution.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import astro, timefn
from ..storage import durable
from . import peaks

#: Constituents with the coefficients of V (T, s, h, p, p1, constant) and u (xi, nu, nu', 2nu'', Q, R, Qu), the node factor's formula and the speed in degrees an hour.
CONSTITUENTS = (
    ("O1", (1, -2, 1, 0, 0, 90), (2, -1, 0, 0, 0, 0, 0), 75, 13.943036),
    ("K1", (1, 0, 1, 0, 0, -90), (0, 0, -1, 0, 0, 0, 0), 227, 15.041069),
    ("P1", (1, 0, -1, 0, 0, 90), (0, 0, 0, 0, 0, 0, 0), 1, 14.958931),
    ("M2", (2, -2, 2, 0, 0, 0), (2, -2, 0, 0, 0, 0, 0), 78, 28.984104),
    ("S2", (2, 0, 0, 0, 0, 0), (0, 0, 0, 0, 0, 0, 0), 1, 30.0),
    ("N2", (2, -3, 2, 1, 0, 0), (2, -2, 0, 0, 0, 0, 0), 78, 28.43973),
    ("L2", (2, -1, 2, -1, 0, 180), (2, -2, 0, 0, 0, -1, 0), 215, 29.528479),
    ("K2", (2, 0, 2, 0, 0, 0), (0, 0, 0, -1, 0, 0, 0), 235, 30.082138),
    ("Q1", (1, -3, 1, 1, 0, 90), (2, -1, 0, 0, 0, 0, 0), 75, 13.398661),
    ("NU2", (2, -3, 4, -1, 0, 0), (2, -2, 0, 0, 0, 0, 0), 78, 28.512583),
    ("S1", (1, 0, 0, 0, 0, 0), (0, 0, 0, 0, 0, 0, 0), 1, 15.0),
    ("M1", (1, -1, 1, 1, 0, -90), (0, -1, 0, 0, 0, 0, -1), 206, 14.496694),
    ("LDA2", (2, -1, 0, 1, 0, 180), (2, -2, 0, 0, 0, 0, 0), 78, 29.455625),
)


#: Speeds in degrees an hour of further constituents, as tide agencies publish them.
SPEEDS = {
    "SA": 0.0410686, "SSA": 0.0821373, "MSM": 0.4715211, "MM": 0.5443747, "MSF": 1.0158958, "MF": 1.0980331,
    "2Q1": 12.8542862, "SIGMA1": 12.9271398, "RHO1": 13.4715145, "RHO": 13.4715145, "CHI1": 14.5695476, "PI1": 14.9178647,
    "PSI1": 15.0821353, "PHI1": 15.1232059, "THETA1": 15.5125897, "J1": 15.5854433, "SO1": 16.0569644, "OO1": 16.1391017,
    "EPS2": 27.4238337, "2N2": 27.8953548, "MU2": 27.9682084, "LAMBDA2": 29.4556253, "T2": 29.9589333, "R2": 30.0410667,
    "MSN2": 30.5443747, "2SM2": 31.0158958, "2MK3": 42.9271398, "MO3": 42.9271398, "M3": 43.4761563, "SO3": 43.9430356,
    "MK3": 44.0251729, "SK3": 45.0410686, "MN4": 57.4238337, "M4": 57.9682084, "SN4": 58.4397295, "MS4": 58.9841042,
    "MK4": 59.0662415, "S4": 60.0, "SK4": 60.0821373, "2MN6": 86.4079380, "M6": 86.9523127, "2MS6": 87.9682084,
    "2MK6": 88.0503457, "2SM6": 88.9841042, "MSK6": 89.0662415, "S6": 90.0, "M8": 115.9364166,
}

#: Node factor formulas of constituents that have no coefficients above; 1 for any other name.
FORMULAS = {
    "SA": 1, "2SM": 78, "MSF": 78, "MF": 74, "MM": 73, "2Q1": 75, "SIGMA1": 75, "RHO1": 75, "M11": 76, "M12": 78, "CHI1": 75, "PI1": 1, "PHI1": 75,
    "THETA1": 75, "J1": 76, "OO1": 77, "2MK3": 149, "M3": 149, "MK3": 149, "MN4": 78, "MS4": 78, "MK4": 78, "SN4": 78, "S4": 1, "SK4": 78,
    "2MN6": 78, "M6": 78, "2MS6": 78, "2MK6": 78, "2SM6": 78, "MSK6": 78,
}


def formula_of(name: Column) -> Column:
    """Number of a constituent's node factor formula. Without coefficients for V and u it isn't put to use: the factor is 1."""
    known = FORMULAS | {n: f for n, _, _, f, _ in CONSTITUENTS}
    table = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    return F.coalesce(F.try_element_at(table, name), F.lit(1))


def speeds(spark: SparkSession, definitions: DataFrame | None = None) -> DataFrame:
    """``name, speed`` of all known constituents; ``definitions`` (name, speed), where given, go before the table."""
    table = {n: s for n, _, _, _, s in CONSTITUENTS}
    rows = spark.createDataFrame(list((SPEEDS | table).items()), "name string, speed double")
    if definitions is None:
        return rows
    own = definitions.select("name", "speed")
    return own.unionByName(rows.join(own, "name", "left_anti"))


def constituents(spark: SparkSession) -> DataFrame:
    rows = [(n, [float(x) for x in v], [float(x) for x in u], f, s) for n, v, u, f, s in CONSTITUENTS]
    return spark.createDataFrame(rows, "name string, v array<double>, u array<double>, f_formula int, speed double")


def nodal_factors(days: DataFrame, definitions: DataFrame, meridian: float = 0.0, hour: int = 12) -> DataFrame:
    """``day, name, speed, f, u, v0`` of each day and constituent; u and v0 in degrees, not reduced.

    v0 holds at the start of the day's year, f and u at ``hour`` of the day, both
    moved by the meridian's hours.
    """
    move = lambda ts: timefn.shift(ts, F.lit(meridian * 3600.0))
    day = F.col("day").cast("timestamp_ntz")
    start = astro.arguments(move(F.trunc(F.col("day"), "YEAR").cast("timestamp_ntz")))
    mid = astro.arguments(move(timefn.shift(day, F.lit(hour * 3600.0))))
    d = days.select("day", *[c.alias(f"a_{k}") for k, c in start.items()], mid["n"].alias("n"), mid["p"].alias("p"))
    w, i0 = F.lit(astro.OBLIQUITY), F.lit(astro.INCLINATION)
    sind, cosd, atan2d = astro.sind, astro.cosd, astro.atan2d
    n = F.col("n")
    d = d.withColumn("i", F.degrees(F.acos(cosd(w) * cosd(i0) - sind(w) * sind(i0) * cosd(n))))
    i = F.col("i")
    d = d.withColumn("nu", F.degrees(F.asin(sind(i0) * sind(n) / sind(i))))
    nu = F.col("nu")
    d = d.withColumn("xi", n - atan2d(sind(w) * sind(n) / sind(i), cosd(n) * cosd(nu) + sind(n) * sind(nu) * cosd(w)))
    d = d.withColumn("nu1", atan2d(sind(2 * i) * sind(nu), sind(2 * i) * cosd(nu) + 0.3347))
    d = d.withColumn("nu2", atan2d(sind(i) ** 2 * sind(2 * nu), sind(i) ** 2 * cosd(2 * nu) + 0.0727))
    d = d.withColumn("pp", F.col("p") - F.col("xi"))
    pp, tan = F.col("pp"), F.tan(F.radians(i / 2))
    d = d.withColumn("q", atan2d(0.483 * sind(pp), cosd(pp)))
    d = d.withColumn("qu", pp - F.col("q")).withColumn("qa", 1 / F.sqrt(2.31 + 1.435 * cosd(2 * pp)))
    d = d.withColumn("r", atan2d(sind(2 * pp), 1 / (6 * tan * tan) - cosd(2 * pp)))
    d = d.withColumn("ra", 1 / F.sqrt(1 - 12 * tan * tan * cosd(2 * pp) + 36 * tan**4))
    dot = lambda coefficients, names: sum((F.col(coefficients)[k] * F.col(c) for k, c in enumerate(names[1:], 1)), F.col(coefficients)[0] * F.col(names[0]))
    out = d.crossJoin(F.broadcast(definitions))  # a fixed number of constituents
    return out.select(
        "day", "name", "speed",
        astro.node_factor(F.col("f_formula"), i, nu, F.col("qa"), F.col("ra")).alias("f"),
        dot("u", ["xi", "nu", "nu1", "nu2", "q", "r", "qu"]).alias("u"),
        (dot("v", ["a_tau", "a_s", "a_h", "a_p", "a_p1"]) + F.col("v")[5]).alias("v0"),
    )


def compound_factors(nodal: DataFrame, compounds: DataFrame) -> DataFrame:
    """``day, name, f, u, v0`` of compounds (name, bases: array of structs name and c): f is the product of f^|c|, u and v0 the sums of c times the base's.

    Bases that are missing don't count.
    """
    parts = compounds.select("name", F.explode("bases").alias("b")).select("name", F.col("b.name").alias("base"), F.col("b.c").alias("c"))
    met = parts.join(nodal.select("day", F.col("name").alias("base"), "f", "u", "v0"), "base")
    product = F.exp(F.sum(F.abs("c") * F.log("f")))
    return met.groupBy("day", "name").agg(product.alias("f"), F.sum(F.col("c") * F.col("u")).alias("u"), F.sum(F.col("c") * F.col("v0")).alias("v0"))


def daily_terms(stations: DataFrame, days: DataFrame, nodal: DataFrame, speed: DataFrame) -> DataFrame:
    """``station_id, day, datum, terms``: a station's constituents with the factors of each of its days, in order of name.

    ``stations`` has station_id, datum and constituents, ``days`` station_id and day,
    ``speed`` name and speed. Constituents without a speed are left out; those without
    factors have f 1 and u and v0 0. A station without any has an empty array.
    """
    parts = stations.select("station_id", "datum", F.explode_outer("constituents").alias("c")).select("station_id", "datum", "c.name", "c.amp", "c.phase")
    timed = parts.join(F.broadcast(speed.select("name", "speed")), "name", "left")  # a fixed table of names
    met = days.select("station_id", "day").distinct().join(timed, "station_id").join(nodal.select("day", "name", "f", "u", "v0"), ["day", "name"], "left")
    phase = F.pmod(F.coalesce("v0", F.lit(0.0)) + F.coalesce("u", F.lit(0.0)) - F.col("phase"), F.lit(360.0))
    term = F.when(F.col("speed").isNotNull(), F.struct("name", (F.coalesce("f", F.lit(1.0)) * F.col("amp")).alias("a"), "speed", phase.alias("p")))
    return met.groupBy("station_id", "day").agg(F.first("datum").alias("datum"), F.sort_array(F.collect_list(term)).alias("terms"))


def height(datum: Column, terms: Column, ts: Column, meridian: float = 0.0) -> Column:
    """Sum of the terms at a time: hours count from the start of the time's year, less the meridian."""
    year = F.date_trunc("YEAR", ts)
    hours = timefn.micros_between(year, ts) / 3600e6 - meridian
    return F.aggregate(terms, datum, lambda acc, c: acc + c["a"] * F.cos(F.radians(c["speed"] * hours + c["p"])))


def predict(
    stations: DataFrame, windows: DataFrame, definitions: DataFrame, step_seconds: int = 900, meridian: float = 0.0, terms: DataFrame | None = None, speed: DataFrame | None = None
) -> DataFrame:
    """``station_id, ts, height`` on a grid from ``begin`` to ``until`` of ``windows`` (station_id, begin, until), both included.

    Further columns of ``windows`` are kept, so a station may have several windows, told
    apart by them. ``terms`` may bring what ``daily_terms`` gives for the windows' days,
    ``speed`` other speeds (name, speed) than those of ``definitions`` and the table.
    """
    extra = [c for c in windows.columns if c not in ("station_id", "begin", "until")]
    w = windows.select("station_id", "begin", "until", *extra, F.explode(F.sequence(F.col("begin").cast("date"), F.col("until").cast("date"))).alias("day"))
    if terms is None:
        nodal = nodal_factors(w.select("day").distinct(), definitions, meridian)
        terms = daily_terms(stations, w, nodal, speeds(stations.sparkSession, definitions) if speed is None else speed)
    first = F.col("begin")
    day = F.col("day").cast("timestamp_ntz")
    late = F.greatest(F.lit(0), F.ceil(timefn.micros_between(first, day) / (step_seconds * 1e6))).cast("long")
    start = timefn.shift(first, late * F.lit(float(step_seconds)))
    stop = F.least(F.col("until"), timefn.shift(day, F.lit(86399.999999)))
    met = w.join(terms, ["station_id", "day"]).withColumn("start", start).withColumn("stop", stop).where("start <= stop")
    points = met.select("station_id", *extra, "datum", "terms", F.explode(timefn.grid(F.col("start"), F.col("stop"), step_seconds)).alias("ts"))
    return points.select("station_id", *extra, "ts", height(F.col("datum"), F.col("terms"), F.col("ts"), meridian).alias("height"))


def peaks_coarse_to_fine(stations: DataFrame, windows: DataFrame, definitions: DataFrame, coarse: int = 900, fine: int = 60, around: int = 1800, meridian: float = 0.0) -> DataFrame:
    """``station_id, type, ts, height``: extrema of a coarse grid, each found again on a fine grid around it, the nearest to the coarse one.

    The coarse grid reaches beyond the windows, so peaks near their edges are found too;
    what falls outside begin to until goes. A station's constituents meet the factors of
    its own days only, once a day for both grids.
    """
    reach = float(coarse * max(2, -(-around // coarse)))
    wide = windows.select("station_id", timefn.shift(F.col("begin"), F.lit(-reach)).alias("begin"), timefn.shift(F.col("until"), F.lit(reach)).alias("until"))
    day = lambda c, shift: F.date_add(F.col(c).cast("date"), shift)
    days = windows.select("station_id", F.explode(F.sequence(day("begin", -1), day("until", 1))).alias("day"))
    nodal = nodal_factors(days.select("day").distinct(), definitions, meridian)
    # written once: both grids use them
    terms = durable(daily_terms(stations, days, nodal, speeds(stations.sparkSession, definitions)))
    rough = peaks.extrema(predict(stations, wide, definitions, coarse, meridian, terms), "station_id", "ts", "height", refine=False)
    key = F.concat_ws("|", "station_id", F.col("ts").cast("string"))
    rough = rough.select(key.alias("_key"), "station_id", F.col("ts").alias("_rough"), F.col("type").alias("_type")).distinct()
    near = rough.select("_key", "_rough", "_type", "station_id", timefn.shift(F.col("_rough"), F.lit(-float(around))).alias("begin"), timefn.shift(F.col("_rough"), F.lit(float(around))).alias("until"))
    points = predict(stations, near, definitions, fine, meridian, terms)
    told = points.select(F.struct("_key", "station_id", "_rough", "_type").alias("_peak"), "ts", "height")
    met = peaks.extrema(told, "_peak", "ts", "height").where("type = _peak._type")
    nearest = F.struct(F.abs(timefn.micros_between(F.col("_peak._rough"), F.col("ts"))), F.col("ts"))
    best = met.groupBy("_peak").agg(F.min_by(F.struct("type", "ts", "height"), nearest).alias("b")).select("_peak.station_id", "b.type", "b.ts", "b.height")
    inside = best.join(windows.select("station_id", "begin", "until"), "station_id").where("ts >= begin and ts <= until")
    return inside.select("station_id", "type", "ts", "height").distinct()


def reference_windows(subordinates: DataFrame, currents: bool = False) -> DataFrame:
    """``station_id, begin, until`` of the reference stations of ``subordinates`` (ref_key, begin, until): one window a reference, over all that its subordinates need.

    Tides reach from a month before the first month to a month after the last one, by
    whole months, currents two hours on either side, so that no peak is lost that the
    offsets move in from outside.
    """
    if currents:
        begin, until = timefn.shift(F.col("begin"), F.lit(-7200.0)), timefn.shift(F.col("until"), F.lit(7200.0))
    else:
        begin = F.add_months(F.trunc(F.col("begin").cast("date"), "MM"), -1).cast("timestamp_ntz")
        # a month after the end of the month, which may be a shorter one
        until = timefn.shift(F.add_months(F.last_day(F.col("until").cast("date")), 1).cast("timestamp_ntz"), F.lit(86399.0))
    each = subordinates.select(F.col("ref_key").alias("station_id"), begin.alias("begin"), until.alias("until"))
    return each.groupBy("station_id").agg(F.min("begin").alias("begin"), F.max("until").alias("until"))


def subordinate_peaks(references: DataFrame, subordinates: DataFrame, definitions: DataFrame, currents: bool = False, coarse: int = 900, fine: int = 60) -> DataFrame:
    """Peaks of subordinate stations in their windows; each reference's peaks are worked out once, over all windows that need them."""
    windows = reference_windows(subordinates, currents)
    if currents:
        found = peaks.extrema(predict(references, windows, definitions, coarse), "station_id", "ts", "height")
    else:
        found = peaks_coarse_to_fine(references, windows, definitions, coarse, fine)
    return subordinate(found, subordinates)


def subordinate(reference_peaks: DataFrame, stations: DataFrame) -> DataFrame:
    """Peaks of subordinate stations: the reference's, moved and scaled.

    ``stations`` has station_id, ref_key, high_seconds, low_seconds, high_mult,
    low_mult, begin and until; ``reference_peaks`` station_id, type, ts, height. Heights
    have 3 places; what falls outside begin to until goes.
    """
    ref = reference_peaks.select(F.col("station_id").alias("ref_key"), "type", "ts", "height")
    met = stations.join(ref, "ref_key")
    high = F.col("type") == "High"
    seconds = F.when(high, F.col("high_seconds")).otherwise(F.col("low_seconds"))
    mult = F.when(high, F.col("high_mult")).otherwise(F.col("low_mult"))
    moved = met.select("station_id", "type", timefn.shift(F.col("ts"), seconds).alias("ts"), F.round(F.col("height") * mult, 3).alias("height"), "begin", "until")
    return moved.where("ts >= begin and ts <= until").select("station_id", "type", "ts", "height")


def current_events(points: DataFrame) -> DataFrame:
    """``station_id, type, ts, velocity``: extrema above 0 are floods, else ebbs, crossings of 0 are slacks."""
    top = peaks.extrema(points, "station_id", "ts", "height")
    moving = top.select("station_id", F.when(F.col("height") > 0, "flood").otherwise("ebb").alias("type"), "ts", F.col("height").alias("velocity"))
    slack = peaks.zero_crossings(points, "station_id", "ts", "height").select("station_id", F.lit("slack").alias("type"), "ts", F.lit(0.0).alias("velocity"))
    return moving.unionByName(slack)
