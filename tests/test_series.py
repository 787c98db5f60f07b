import math
import random
from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from marigraph.operators import calendar, events, harmonics, peaks
from marigraph.plans import catalog

T0 = datetime(2025, 6, 15)
SERIES = "key long, ts timestamp_ntz, value double"


def series(spark, values, minutes=1):
    return spark.createDataFrame([(1, T0 + timedelta(minutes=minutes * i), float(v)) for i, v in enumerate(values)], SERIES)


def test_one_high(spark):
    rows = peaks.extrema(series(spark, [5, 7, 8, 7.5, 6]), "key", "ts", "value").collect()
    assert [r["type"] for r in rows] == ["High"] and rows[0]["height"] > 7.9


@pytest.mark.parametrize("values", [[1, 2, 3], [1], [1, 2], [1, 2, 2, 1], []])
def test_no_peaks(spark, values):
    assert peaks.extrema(series(spark, values), "key", "ts", "value").count() == 0


def test_sine(spark):
    rows = peaks.extrema(series(spark, [5 + 3 * math.sin(i / 10) for i in range(63)], 10), "key", "ts", "value").collect()
    by = {r["type"]: r["height"] for r in rows}
    assert by["High"] == pytest.approx(8, abs=0.01) and by["Low"] == pytest.approx(2, abs=0.01)


def test_crossing(spark):
    rows = spark.createDataFrame([(1, T0 + timedelta(hours=6), 2.0), (1, T0 + timedelta(hours=12), -1.0)], SERIES)
    assert [r["ts"] for r in peaks.zero_crossings(rows, "key", "ts", "value").collect()] == [T0 + timedelta(hours=10)]
    assert peaks.zero_crossings(series(spark, [0, 1, 2]), "key", "ts", "value").count() == 0


def test_types_by_lag(spark):
    rows = peaks.infer_types(series(spark, [3, 1, 4, 2]), "key", "ts", "value").orderBy("ts").collect()
    assert [r["type"] for r in rows] == ["High", "Low", "High", "Low"]


#: A station's constituents (amplitude, phase).
BOSTON = [("M2", 4.25, 112.3), ("S2", 0.72, 145.6), ("N2", 0.89, 85.4), ("K1", 0.35, 201.5), ("O1", 0.28, 198.7)]
STATIONS = "station_id string, datum double, constituents array<struct<name: string, amp: double, phase: double>>"


@pytest.fixture
def boston(spark):
    return spark.createDataFrame([("b", 0.0, BOSTON)], STATIONS)


def window(spark, a, b):
    return spark.createDataFrame([("b", a, b)], "station_id string, begin timestamp_ntz, until timestamp_ntz")


def test_nodal_factors(spark):
    days = spark.createDataFrame([(datetime(2026, 2, 3).date(),)], "day date")
    got = {r["name"]: r for r in harmonics.nodal_factors(days, harmonics.constituents(spark)).collect()}
    #: F, u and V0 to match on that day.
    want = {
        "O1": (1.174649373, 357.089784, 54.695294), "K1": (1.107875596, 2.594962, 10.666004), "P1": (1, 0, 349.333996), "M2": (0.965335147, 0.723628, 65.361298), "S2": (1, 0, 0),
        "N2": (0.965335147, 0.723628, 58.668094), "L2": (1.259599537, 349.095124, 252.054502), "K2": (1.298410005, 5.497538, 201.332007), "M1": (1.322457184, 345.846776, 3.972799),
    }
    apart = lambda a, b: abs((a - b + 180) % 360 - 180)
    for name, (f, u, v) in want.items():
        assert got[name]["f"] == pytest.approx(f, abs=1e-8)
        assert apart(got[name]["u"], u) < 1e-5 and apart(got[name]["v0"], v) < 1e-5


def test_heights_and_peaks(spark, boston):
    day = window(spark, T0, T0 + timedelta(days=1))
    found = harmonics.predict(boston, day, harmonics.constituents(spark), 21600).orderBy("ts").collect()
    assert [r["height"] for r in found[:3]] == pytest.approx([-4.009319, 4.598528, -4.146397], abs=1e-5)
    assert len(found) == 5
    dense = peaks.extrema(harmonics.predict(boston, day, harmonics.constituents(spark), 60), "station_id", "ts", "height").orderBy("ts").collect()
    assert [(r["type"], r["ts"].strftime("%H:%M:%S"), r["height"]) for r in dense] == [("Low", "00:16:03", -4.048), ("High", "06:29:46", 4.737), ("Low", "12:50:09", -4.535), ("High", "18:59:55", 3.898)]
    fine = harmonics.peaks_coarse_to_fine(boston, day, harmonics.constituents(spark)).orderBy("ts").collect()
    assert [(r["type"], r["ts"], r["height"]) for r in fine] == [(r["type"], r["ts"], r["height"]) for r in dense]


def test_peaks_near_the_edges(spark, boston):
    for begin in (T0 + timedelta(minutes=11), T0 + timedelta(hours=6, minutes=25)):  # lows and highs some minutes inside
        span = window(spark, begin, begin + timedelta(hours=13))
        around = window(spark, begin - timedelta(hours=1), begin + timedelta(hours=14))
        dense = peaks.extrema(harmonics.predict(boston, around, harmonics.constituents(spark), 60), "station_id", "ts", "height").orderBy("ts").collect()
        want = [(r["type"], r["ts"], r["height"]) for r in dense if begin <= r["ts"] <= begin + timedelta(hours=13)]
        fine = harmonics.peaks_coarse_to_fine(boston, span, harmonics.constituents(spark)).orderBy("ts").collect()
        assert [(r["type"], r["ts"]) for r in fine] == [(t, ts) for t, ts, _ in want] and len(want) == 3
        assert [r["height"] for r in fine] == pytest.approx([h for *_, h in want])


def test_constituents_without_factors(spark):
    """They count with their speed alone; a name without a speed and an empty station add nothing."""
    s = spark.createDataFrame([("a", 1.0, [("M4", 2.0, 30.0), ("?", 9.0, 0.0)]), ("b", 0.5, [])], "station_id string, datum double, constituents array<struct<name: string, amp: double, phase: double>>")
    w = spark.createDataFrame([("a", T0, T0 + timedelta(hours=2)), ("b", T0, T0 + timedelta(hours=1))], "station_id string, begin timestamp_ntz, until timestamp_ntz")
    got = {(r["station_id"], r["ts"]): r["height"] for r in harmonics.predict(s, w, harmonics.constituents(spark), 3600).collect()}
    hour = (T0 - datetime(T0.year, 1, 1)).total_seconds() / 3600
    want = {("a", T0 + timedelta(hours=k)): 1 + 2 * math.cos(math.radians(harmonics.SPEEDS["M4"] * (hour + k) - 30)) for k in range(3)}
    assert got == pytest.approx(want | {("b", T0 + timedelta(hours=k)): 0.5 for k in range(2)})


def test_formulas(spark):
    rows = spark.createDataFrame([("M2",), ("MM",), ("2MK3",), ("unknown",)], "name string")
    assert [r[0] for r in rows.select(harmonics.formula_of(F.col("name"))).collect()] == [78, 73, 149, 1]


def test_reference_windows(spark):
    at = lambda *x: datetime(*x)
    subs = spark.createDataFrame([("r", at(2025, 3, 10), at(2025, 3, 31, 12)), ("r", at(2025, 5, 2), at(2025, 5, 3))], "ref_key string, begin timestamp_ntz, until timestamp_ntz")
    (r,) = harmonics.reference_windows(subs).collect()
    assert (r["begin"], r["until"]) == (at(2025, 2, 1), at(2025, 6, 30, 23, 59, 59))
    (r,) = harmonics.reference_windows(subs, currents=True).collect()
    assert (r["begin"], r["until"]) == (at(2025, 3, 9, 22), at(2025, 5, 3, 2))


def test_subordinate_peaks_from_outside_the_window(spark):
    """A reference's peak before the window counts where the offset moves it in, over a month's end."""
    ref = spark.createDataFrame([("r", 0.0, [("M2", 1.0, 0.0)])], "station_id string, datum double, constituents array<struct<name: string, amp: double, phase: double>>")
    begin, until = datetime(2025, 1, 31, 20), datetime(2025, 2, 1, 8)
    schema = "station_id string, ref_key string, high_seconds double, low_seconds double, high_mult double, low_mult double, begin timestamp_ntz, until timestamp_ntz"
    sub = spark.createDataFrame([("s", "r", 5 * 3600.0, 5 * 3600.0, 1.0, 2.0, begin, until)], schema)
    got = sorted((r["ts"], r["type"], r["height"]) for r in harmonics.subordinate_peaks(ref, sub, harmonics.constituents(spark)).collect())
    wide = spark.createDataFrame([("r", begin - timedelta(days=1), until + timedelta(days=1))], "station_id string, begin timestamp_ntz, until timestamp_ntz")
    dense = peaks.extrema(harmonics.predict(ref, wide, harmonics.constituents(spark), 60), "station_id", "ts", "height").collect()
    want = sorted((r["ts"] + timedelta(hours=5), r["type"], round(r["height"] * (1 if r["type"] == "High" else 2), 3)) for r in dense if begin <= r["ts"] + timedelta(hours=5) <= until)
    assert [x[1] for x in got] == [x[1] for x in want] and len(got) == 2
    assert all(abs((a[0] - b[0]).total_seconds()) < 1 and a[2] == pytest.approx(b[2], abs=2e-3) for a, b in zip(got, want, strict=True))


def test_subordinate(spark):
    ref = spark.createDataFrame([("r", "High", T0, 2.0), ("r", "Low", T0 + timedelta(hours=6), 0.5)], "station_id string, type string, ts timestamp_ntz, height double")
    sub = spark.createDataFrame([("s", "r", 600.0, -60.0, 1.5, 2.0, T0, T0 + timedelta(hours=3))], "station_id string, ref_key string, high_seconds double, low_seconds double, high_mult double, low_mult double, begin timestamp_ntz, until timestamp_ntz")
    assert [tuple(r) for r in harmonics.subordinate(ref, sub).collect()] == [("s", "High", T0 + timedelta(minutes=10), 3.0)]


def test_compound(spark):
    nodal = spark.createDataFrame([(T0.date(), "M2", 0.96, 1.0, 10.0), (T0.date(), "S2", 1.0, 0.0, 0.0)], "day date, name string, f double, u double, v0 double")
    compounds = spark.createDataFrame([("M4", [("M2", 2.0)]), ("MS4", [("M2", 1.0), ("S2", 1.0)])], "name string, bases array<struct<name: string, c: double>>")
    got = {r["name"]: (round(r["f"], 6), r["u"], r["v0"]) for r in harmonics.compound_factors(nodal, compounds).collect()}
    assert got == {"M4": (0.9216, 2.0, 20.0), "MS4": (0.96, 1.0, 10.0)}


def test_lunar_phases(spark):
    found = calendar.lunar_phases(spark, 2025, 2025).orderBy("ts").collect()
    assert len(found) == 49
    assert [(r["type"], r["ts"].strftime("%m-%d %H")) for r in found[:5]] == [("first_quarter", "01-06 09"), ("full_moon", "01-14 05"), ("last_quarter", "01-21 02"), ("new_moon", "01-28 02"), ("first_quarter", "02-05 03")]


def test_greedy_takes_each_once(spark):
    s = "key long, type string, ts timestamp_ntz, value double"
    left = spark.createDataFrame([(1, "High", T0, 1.0), (1, "High", T0 + timedelta(minutes=10), 2.0)], s)
    right = spark.createDataFrame([(1, "High", T0 + timedelta(minutes=5), 3.0), (1, "Low", T0, 4.0)], s)
    got = {(r["l_value"], r["r_value"]) for r in events.match_greedy(left, right).collect()}
    assert got == {(1.0, 3.0), (2.0, None), (None, 4.0)}


def test_greedy_as_brute_force(spark):
    rng = random.Random(6)
    at = lambda: T0 + timedelta(minutes=rng.randrange(0, 4000, 7))
    rows = [[(rng.randrange(3), rng.choice(["High", "Low"]), at(), float(i)) for i in range(150)] for _ in range(2)]
    s = "key long, type string, ts timestamp_ntz, value double"
    got = sorted((tuple(r) for r in events.match_greedy(spark.createDataFrame(rows[0], s), spark.createDataFrame(rows[1], s)).collect()), key=str)
    free, want = sorted(rows[1], key=lambda r: (r[2], r[3])), []
    for k, kind, ts, value in sorted(rows[0], key=lambda r: (r[2], r[3])):
        near = [r for r in free if r[:2] == (k, kind) and abs((r[2] - ts).total_seconds()) <= 7200]
        best = min(near, key=lambda r: (abs((r[2] - ts).total_seconds()), r[2], r[3]), default=None)
        want.append((k, kind, ts, value, *(best[2:] if best else (None, None))))
        if best:
            free.remove(best)
    want += [(r[0], r[1], None, None, r[2], r[3]) for r in free]
    assert got == sorted(want, key=str)


def test_match_across_buckets(spark):
    s = "key long, type string, ts timestamp_ntz, value double"
    at = datetime(2025, 1, 1, 2, 59)
    left = spark.createDataFrame([(1, "High", at, 1.0)], s)
    right = spark.createDataFrame([(1, "High", at - timedelta(hours=2), 7.0), (1, "High", at + timedelta(minutes=5), 8.0), (1, "High", at + timedelta(hours=3), 9.0)], s)
    assert events.match_first(left, right).first()["r_value"] == 7.0
    assert events.match_first(left, right, nearest=True).first()["r_value"] == 8.0


def test_ics(spark):
    rows = [{"summary": "High Tide 1.0 m, spring", "description": None, "dtstart": T0, "dtend": T0, "url": "u" * 90, "location": "a;b"}]
    out = calendar.to_ics(rows, "Boston")
    assert "SUMMARY:High Tide 1.0 m\\, spring" in out and "LOCATION:a\\;b" in out
    assert all(len(line.encode()) <= 75 for line in out.split("\r\n"))


def test_all_series_are_compared_and_in_calendars(spark):
    sf = "/root/testdata/sf0.001"
    run = lambda name: catalog.queries()[name](spark, sf).collect()
    upcoming = catalog.series(spark, sf).where(F.col("ts") > F.lit("2024-01-10 00:00:00").cast("timestamp_ntz"))
    users = {r[0] for r in upcoming.select("key").distinct().collect()} - {1}
    for name in ("compare_events", "variance_to_primary"):
        assert {r["key"] for r in run(name)} == users
    stations = {r["id"] for r in catalog.suppliers(spark, sf).select("id").collect()}
    active = {r["key"] for r in catalog.series(spark, sf).select("key").distinct().collect()}
    every = run("calendar_rows")
    assert {r["station_id"] for r in every if r["url"] is None} == stations
    assert {r["station_id"] for r in every if r["url"] is not None} == stations & active


def as_sql(spark, sf, name, tables):
    """(the query's rows, those of its SQL) over tables that are written under ``sf``."""
    con = duckdb.connect()
    for table, rows in tables.items():
        rows.write.parquet(f"{sf}/{table}.parquet")
        con.execute(f"create view {table} as select * from '{sf}/{table}.parquet/*.parquet'")
    want = con.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in want.description]
    return sorted(map(tuple, catalog.queries()[name](spark, str(sf)).select(*names).collect()), key=str), sorted(want.fetchall(), key=str)


def test_velocities_halfway_between_tenths(spark, tmp_path):
    """Each half of a value by each kind of event; 181.5 is the first that was cut to a lower tenth."""
    rows = [(3 * i + k, T0 + timedelta(minutes=3 * i + k), 1, "click", i + 0.5) for i in range(600) for k in range(3)]
    e = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double")
    s = spark.createDataFrame([(1, "Supplier#1", 0, 0.0)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double")
    got, want = as_sql(spark, tmp_path, "current_calendar_rows", {"events": e, "supplier": s})
    assert got == want and len(got) == 1800


@pytest.mark.parametrize("nearest", [False, True])
def test_match_as_brute_force(spark, nearest):
    """Equal events, equal times with several values, nulls, distances of exactly the limit, times before 1970."""
    rng = random.Random(3)
    for begin in (T0, datetime(1969, 12, 31, 20)):
        at = lambda: rng.choice([None, *[begin + timedelta(minutes=rng.randrange(0, 1200, 15)) for _ in range(40)]])  # noqa: B023, E731
        rows = [[(rng.choice([1, 2, None]), rng.choice(["High", "Low"]), at(), rng.choice([None, 1.0, 2.0, 3.0])) for _ in range(150)] for _ in range(2)]
        s = "key long, type string, ts timestamp_ntz, value double"
        got = events.match_first(spark.createDataFrame(rows[0], s), spark.createDataFrame(rows[1], s), 3600, nearest).collect()
        want = []
        for key, kind, ts, value in set(rows[0]):
            near = [(r[2], r[3], (r[2] - ts).total_seconds()) for r in rows[1] if key and ts and r[2] and r[:2] == (key, kind) and abs((r[2] - ts).total_seconds()) < 3600]
            best = min(near, key=lambda m: ((abs(m[2]) if nearest else 0), m[0], m[1] is None, m[1] or 0), default=None)
            want += [(key, kind, ts, value, *best)] if best else []
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str) and len(want) > 50


def test_matching_makes_no_pairs(spark):
    """A series of 40,000 events within minutes: by pairs it would take 400 million rows; no join is left in the plan."""
    e = spark.range(40_000).select(F.lit(1).alias("key"), F.lit("High").alias("type"), F.timestamp_add("MILLISECOND", F.col("id"), F.lit(T0)).cast("timestamp_ntz").alias("ts"), F.col("id").cast("double").alias("value"), "id")
    left, right = e.where("id % 2 = 0").drop("id"), e.where("id % 2 = 1").drop("id")
    found = events.match_first(left, right)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in found.agg(F.count("*"), F.min("r_value"), F.max("r_value")).collect()] == [(20_000, 1.0, 1.0)]


@pytest.mark.parametrize("name", ["asof_first_match", "error_stats", "macro_rms"])
def test_matches_of_repeated_series(spark, tmp_path, name):
    """Series that are repeated with shifted keys share keys, so each event has equal ones."""
    e = spark.read.parquet("/root/testdata/sf0.01/events.parquet")
    e = e.crossJoin(spark.range(3).withColumnRenamed("id", "_i")).withColumns({"event_id": F.col("event_id") + F.col("_i") * 10_000, "user_id": F.col("user_id") + F.col("_i") * 160}).drop("_i")
    plan = catalog.queries()[name](spark, "/root/testdata/sf0.01")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" not in plan  # pairs of events, more than rows by far
    got, want = as_sql(spark, tmp_path, name, {"events": e})
    assert got == want and len(got) > 3

