import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from marigraph.functions import geo, timefn
from marigraph.functions.text import name_key
from marigraph.operators import cluster, peaks, proximity, search
from marigraph.plans import catalog
from marigraph.sources import providers

S = "id string, name string, alternate_names array<string>, region string, public_id string, lat double, lon double, ord long, provider string, depth double, bid string"


def rows(spark):
    return spark.createDataFrame(
        [
            ("1", "Boston", ["Boston Harbor", None], "Massachusetts", "844", 42.3601, -71.0589, 1, "xtide", None, "1_1"),
            ("2", "Boston Light", ["x"], "Massachusetts", "845", 42.3602, -71.0590, 2, "noaa", 10.0, "2_1"),
            ("3", "Portland", ["y"], "Maine", "841", 43.6567, -70.2483, 3, "noaa", 50.0, "3_1"),
            ("4", "Boston Null", None, "Massachusetts", "846", None, None, 4, "noaa", None, "4_1"),
        ],
        S,
    )


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


def test_search(spark):
    s = rows(spark)
    assert ids(search.find_tides(s, ["boston"])) == ["1", "2"]
    assert ids(search.find_tides(s, ["boston", "light"])) == ["2"]
    assert ids(search.find_tides(s, ["4"])) == ["1", "2", "3", "4"]  # in public ids; row 4 by its own id
    assert ids(search.find_tides(s, ["portland"], 1)) == ["3"]
    assert ids(search.find_tides(s, ["4"], 0.5)) == ["1", "2", "3", "4"]
    assert ids(search.find_currents(s, ["1_"])) == ["1"]
    assert ids(search.within(s, 42.36, -71.06, 5.9)) == ["1", "2"]


def test_lookup_and_autocomplete(spark):
    s = rows(spark)
    aliases = spark.createDataFrame([("old", "3")], "alias string, id string")
    assert ids(search.lookup(s, "2", aliases)) == ["2"] and ids(search.lookup(s, "old", aliases)) == ["3"] and ids(search.lookup(s, "", aliases)) == []
    assert ids(search.autocomplete(s, "bo")) == ["1", "2", "4"] and ids(search.autocomplete(s, "b")) == []
    assert search.route("42.36, -71.06")[0] == "gps" and search.route("boston, ma") == ("text", ["boston", "ma"])


def test_groups(spark):
    s = rows(spark)
    g = {r["id"]: r["leader"] for r in cluster.proximity_groups(s).collect()}
    assert g == {"1": "1", "2": "1", "3": "3", "4": "4"}
    assert len({r["leader"] for r in cluster.proximity_groups(s, 1.0).collect()}) == 4
    apart = {r["id"]: r["leader"] for r in cluster.proximity_groups(s, match_depth=True).collect()}
    assert apart["2"] == "2"
    made = {r["leader"]: r for r in cluster.station_groups(s, cluster.proximity_groups(s)).collect()}
    assert made["1"]["primary"] == "2" and made["1"]["alternatives"] == ["1"]


def test_leaders_equal_the_greedy_order(spark):
    rng = random.Random(3)
    n = 60
    edges = [(a, b) for a in range(n) for b in range(a) if rng.random() < 0.06]
    near = {a: set() for a in range(n)}
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    want, lead = {}, []
    for x in range(n):
        own = next((y for y in lead if y in near[x]), x)
        want[x] = own
        if own == x:
            lead.append(x)
    r = spark.createDataFrame([(i, i) for i in range(n)], "id long, ord long")
    e = spark.createDataFrame(edges, "id long, other long")
    assert {x["id"]: x["leader"] for x in cluster.leaders(r, e).collect()} == want


def test_join_within_equals_brute_force(spark):
    rng = random.Random(5)
    make = lambda n, p: [(f"{p}{i}", rng.uniform(-90, 90), rng.choice([179.9, -179.9, rng.uniform(-180, 180)])) for i in range(n)]
    left, right = make(150, "l") + [("pole", 89.9, 10.0)], make(150, "r") + [("pole2", 89.9, -170.0)]
    l, r = spark.createDataFrame(left, "l_id string, l_lat double, l_lon double"), spark.createDataFrame(right, "r_id string, r_lat double, r_lon double")  # noqa: E741
    from marigraph.functions.geo import haversine

    km = haversine(F.col("l_lat"), F.col("l_lon"), F.col("r_lat"), F.col("r_lon"))
    for reach in (300.0, 1500.0):
        want = {(x["l_id"], x["r_id"]) for x in l.crossJoin(r).where(km <= reach).collect()}
        got = [(x["l_id"], x["r_id"]) for x in proximity.join_within(l, r, reach).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_nearest(spark):
    rng = random.Random(7)
    p = spark.createDataFrame([(i, rng.uniform(-60, 60), rng.uniform(-170, 170)) for i in range(80)], "id long, lat double, lon double")
    s = spark.createDataFrame([(rng.uniform(-60, 60), rng.uniform(-170, 170), f"r{i}", i) for i in range(50)], "lat double, lon double, region string, ord long")
    a = {r["id"]: r["region"] for r in proximity.nearest_exact(p, s).collect()}
    apart = lambda x, y: math.acos(min(1, math.sin(x[0]) * math.sin(y[0]) + math.cos(x[0]) * math.cos(y[0]) * math.cos(x[1] - y[1])))
    at = lambda r: (math.radians(r["lat"]), math.radians(r["lon"]))
    every = s.collect()
    assert a == {x["id"]: min(every, key=lambda y: apart(at(x), at(y)))["region"] for x in p.collect()} and len(a) == 80


def test_nearest_in_the_grid(spark):
    """As brute force by cells: dense stations, equal places, ids of several points, empty inner rings, no wrap."""
    rng = random.Random(11)
    spots = [(rng.uniform(-80, 80), rng.uniform(-180, 180)) for _ in range(60)] + [(40 + rng.uniform(0, 0.3), 50 + rng.uniform(0, 0.3)) for _ in range(200)]
    stations = [(*rng.choice(spots), f"r{i}", i) for i in range(500)] + [(None, 1.0, "none", 500)]
    points = [(i % 390, *(rng.choice(spots) if i % 3 else (rng.uniform(-80, 80), rng.uniform(-180, 180)))) for i in range(400)] + [(900, 1.0, None), (901, 0.0, 179.9)]
    p, s = spark.createDataFrame(points, "id long, lat double, lon double"), spark.createDataFrame(stations, "lat double, lon double, region string, ord long")
    from marigraph.functions.geo import haversine

    far = haversine(F.col("lat"), F.col("lon"), F.col("b"), F.col("c"))
    want = {}
    for r in p.crossJoin(s.toDF("b", "c", "region", "ord")).where("lat is not null and lon is not null and b is not null").withColumn("km", far).collect():
        ring = max(1, *(abs(math.floor(x / 10) - math.floor(y / 10)) for x, y in ((r["lat"], r["b"]), (r["lon"], r["c"]))))
        if ring <= 2:
            want[r["id"]] = min(want.get(r["id"], (9,)), (ring, r["km"], r["ord"], r["region"])) if ring == 1 or want.get(r["id"], (9,))[0] != 1 else want[r["id"]]
    found = proximity.nearest_grid(p, s, 10.0)
    got = found.collect()
    assert len(got) == len(want) and {r["id"]: r["region"] for r in got} == {k: v[3] for k, v in want.items()}
    assert proximity.nearest_grid(p, s.limit(0), 10.0).count() == 0


def test_nearest_in_the_grid_meets_few_stations(spark):
    """Points meet few of the stations around them: 4,000 by 4,000 in nine cells would be 16 million pairs."""
    where = [((F.col("id") * k % 30_011) / 1000.0).alias(c) for k, c in ((7919, "lat"), (10_473, "lon"))]
    p = spark.range(4000).select("id", *where)
    s = spark.range(4000, 8000).select(*where, F.lit("r").alias("region"), F.col("id").alias("ord"))
    pairs, plain = [], proximity.join_within
    proximity.join_within = lambda *a: pairs.append(plain(*a)) or pairs[-1]
    try:
        assert proximity.nearest_grid(p, s, 10.0).count() == 4000
    finally:
        proximity.join_within = plain
    assert pairs and sum(x.count() for x in pairs) < 100_000


def test_deduplicate(spark):
    con = lambda a: [("M2", a, 10.0)]
    s = spark.createDataFrame(
        [("X1", 1, "Port A", 1.0, 1.0, "xtide", "ft", con(1.0)), ("T1", 2, "port-a", 1.01, 1.0, "ticon", "m", con(0.3048)), ("X2", 3, "Port A", 1.01, 1.0, "xtide", "ft", con(9.0))],
        "id string, ord long, name string, lat double, lon double, provider string, units string, constituents array<struct<name: string, amp: double, phase: double>>",
    )
    assert {r["id"]: r["best"] for r in cluster.deduplicate(s).collect()} == {"X1": "T1", "T1": "T1", "X2": "X2"}


def test_name_keys_of_all_parts(spark):
    rows = catalog.read(spark, "/root/testdata/sf0.01", "part").select("p_partkey", name_key(F.col("p_type")).alias("key"), F.length("p_type").alias("n")).orderBy("p_partkey").collect()
    leaders, members = [], {}
    near = lambda a, b: abs(a % 9 - b % 9) <= 1 and abs(a % 4 - b % 4) <= 1 and a % 3 == b % 3
    for k, key, n in rows:
        first = next((x for x, other in leaders if other == key and near(x, k)), None)
        if first is None:
            leaders.append((first := k, key))
        members.setdefault(first, []).append((k % 2, n, k))
    want = {m[2]: min(group)[2] for group in members.values() for m in group}
    assert len(want) > 600
    assert {r["id"]: r["best"] for r in catalog.queries()["name_key_groups"](spark, "/root/testdata/sf0.01").collect()} == want


def test_the_antipode_is_found(spark):
    at = "id long, lat double, lon double"
    points = spark.createDataFrame([(1, 10.0, 20.0), (2, 0.0, 0.0), (3, -10.0, -159.999), (4, None, 1.0)], at)
    stations = spark.createDataFrame([(1, -10.0, -160.0, "far"), (2, -10.0, -160.0, "later")], "ord long, lat double, lon double, region string")
    got = {r["id"]: r["region"] for r in proximity.nearest_exact(points, stations).collect()}
    assert got == {1: "far", 2: "far", 3: "far"}
    assert proximity.nearest_exact(points, stations.limit(0)).count() == 0


def test_catalogs_one_after_the_other(spark):
    part = lambda *rows: spark.createDataFrame(rows, "id string, ord long")
    out = providers.union_catalog(part(("a", 5 * 10**9)), part(("b", 0)))
    assert [r["id"] for r in out.orderBy("ord").collect()] == ["a", "b"]


def test_requests(spark):
    known = spark.createDataFrame([("a1",)], "id string")
    got = search.calendar_request(known, "tides", "a1", "2025-03-04", "metric", "false", "1")
    assert (str(got["day"]), got["units"], got["solar"], got["lunar"]) == ("2025-03-04", "metric", False, True)
    assert search.calendar_request(known, "currents", "a1", "no day")["solar"]
    for args, status in ((("rivers", "a1"), 404), (("tides", "b"), 404), (("tides", "a1", None, "knots"), 422)):
        with pytest.raises(search.BadRequest) as e:
            search.calendar_request(known, *args)
        assert e.value.status == status
    assert search.compare_request("tides", list("abcde")) == list("abcde")
    for kind, ids in (("tides", []), ("tides", list("abcdef")), ("x", ["a"])):
        with pytest.raises(search.BadRequest):
            search.compare_request(kind, ids)


def test_filters(spark):
    at = lambda d: datetime(2025, 1, d)
    e = spark.createDataFrame([("High", at(1)), ("LOW", at(2)), ("slack", at(3))], "type string, ts timestamp_ntz")
    assert search.of_types(e, "high", "Low").count() == 2 and search.between(e, "2025-01-02", "2025-01-03").count() == 2
    s = spark.createDataFrame([("x", [("M2", 1.0), ("S2", 2.0)])], "id string, constituents array<struct<name: string, amp: double>>")
    assert [c["name"] for c in search.only_constituents(s, ("S2", "K1")).first()["constituents"]] == ["S2"]


def test_search_results_with_differences(spark):
    s = spark.createDataFrame([(1, 1, "A", 10.0, 20.0, "xtide", None), (2, 2, "A", 10.0005, 20.0, "noaa", None), (3, 3, "B", 40.0, 20.0, "chs", None)], "id long, ord long, name string, lat double, lon double, provider string, depth double")
    t = datetime(2025, 1, 1)
    e = spark.createDataFrame([(1, t + timedelta(minutes=10), "Low", 1.0), (1, t + timedelta(minutes=90), "High", 9.0), (2, t, "High", 2.5)], "key long, ts timestamp_ntz, type string, value double")
    got = {r["primary"]: r for r in cluster.search_results(s, next_events=e).collect()}
    assert got[2]["alternatives"] == [1] and [tuple(d) for d in got[2]["deltas"]] == [(1, "+10min", "-1.5ft")] and got[3]["deltas"] is None
    assert "deltas" not in cluster.search_results(s).columns


def test_next_currents(spark):
    t = datetime(2025, 1, 1)
    rows = [("s", k, t + timedelta(hours=h), v) for h, k, v in ((1, "slack", 0.0), (2, "FLOOD", 1.5), (3, "slack", 0.0), (4, "ebb", -1.0), (5, "flood", 2.0))]
    got = {r["type"]: (r["ts"].hour, r["velocity"]) for r in peaks.next_currents(spark.createDataFrame(rows, "station_id string, type string, ts timestamp_ntz, velocity double"), t).collect()}
    assert got == {"Slack": (1, None), "Flood": (2, 1.5), "Ebb": (4, -1.0)}


def test_clock_and_zones(spark):
    rows = spark.createDataFrame([(datetime(2025, 1, 1, 5, 48), "America/Los_Angeles"), (datetime(2025, 7, 1, 5, 48), "Asia/Kolkata"), (datetime(2025, 1, 1, 5, 48), "Europe/London")], "ts timestamp_ntz, tz string")
    assert [r[0] for r in rows.select(timefn.clock_text(F.col("ts"), F.col("tz"))).collect()] == ["21:48 GMT-8", "11:18 GMT+5:30", "05:48 GMT"]
    assert rows.select(timefn.clock_text(F.col("ts"))).first()[0] == "05:48 UTC"
    s = spark.createDataFrame([(1, 1.5, 200.0, None, None), (2, 2.0, -75.0, "x", "y"), (3, None, None, None, None)], "id int, lat double, lon double, region string, location string")
    known = spark.createDataFrame([("1.5 -160.0", "Pacific/Kiritimati")], "key string, value string")
    assert {r["id"]: r["tz"] for r in geo.timezones(s, known).collect()} == {1: "Pacific/Kiritimati", 2: "America/New_York", 3: "UTC"}
