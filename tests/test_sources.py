import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from marigraph.sources import harmonic, providers, storage
from marigraph.streaming import levels


def put(path, value):
    path.write_text(value if isinstance(value, str) else json.dumps(value))
    return str(path)


def test_noaa(spark, tmp_path):
    p = put(tmp_path / "a.json", {"stationList": [{"name": "Boston", "stationId": "844", "etidesStnName": "BOSTON", "commonName": None, "region": "Boston", "state": None, "lat": 42, "lon": -71.5}]})
    r = providers.noaa_tide_stations(spark, p).first()
    assert (r["id"], r["lat"], r["location"], r["alternate_names"][1]) == ("844", 42.0, "BOSTON, Boston, ", None)
    p = put(tmp_path / "b.json", {"predictions": [{"t": "2024-12-01 03:53", "v": "8.711", "type": "H"}, {"t": "2024-12-01 09:53", "v": "x", "type": "L"}]})
    got = providers.noaa_tide_events(spark, p, "844", "u").orderBy("time").collect()
    assert [(r["type"], r["prediction"]) for r in got] == [("High", 8.711), ("Low", 0.0)] and got[0]["url"] == "u&bdate=20241201"
    p = put(tmp_path / "c.json", {"stations": [{"id": "A_1", "name": "x", "type": "S", "currbin": 3, "lat": 1, "lng": 2.5, "depth": None}, {"id": "B", "type": "W"}]})
    assert [(r["bid"], r["lon"], r["region"]) for r in providers.noaa_current_stations(spark, p).collect()] == [("A_1_3", 2.5, "United States")]
    assert providers.split_bid("A_1_3") == ("A_1", "3")
    p = put(tmp_path / "d.json", {"current_predictions": {"units": "knots", "cp": [{"Type": "ebb", "meanFloodDir": 90, "meanEbbDir": 250, "Bin": "3", "Time": "2024-12-01 03:53", "Depth": None, "Velocity_Major": -1}]}})
    r = providers.noaa_current_events(spark, p, "A_1_3").first()
    assert (r["type"], r["mean_ebb_dir"], r["velocity_major"]) == ("ebb", "250", -1.0)
    assert providers.noaa_tide_stations(spark, put(tmp_path / "e.json", "not json")).count() == 0


def test_chs(spark, tmp_path):
    p = put(tmp_path / "a.json", [{"id": "i", "code": "c", "officialName": "Halifax", "latitude": 44.6, "longitude": -63.5}])
    assert providers.chs_stations(spark, p).first()["region"] == "Atlantic Canada"
    p = put(tmp_path / "b.json", [{"eventDate": "2024-12-01T05:44:00Z", "value": 0.6}, {"eventDate": "2024-12-01T11:44:00Z", "value": 1.9}, {"eventDate": "2024-12-01T17:44:00Z", "value": 0.5}])
    assert [r["type"] for r in providers.chs_tide_events(spark, p, "i").orderBy("time").collect()] == ["Low", "High", "Low"]


def test_moon(spark, tmp_path):
    p = put(tmp_path / "a.json", [{"Date": "2025-01-06 23:56:00", "Phase": 1}, {"Date": "bad", "Phase": 0}, {"Date": "2025-01-13 22:27:00", "Phase": 9}])
    assert [r["type"] for r in providers.moon_data(spark, p).collect()] == ["first_quarter"]
    p2 = put(tmp_path / "b.json", {"phasedata": [{"year": 2025, "month": 1, "day": 13, "time": "22:27", "phase": "Full Moon"}, {"year": 2025, "month": 1, "day": 14, "time": "22:27", "phase": "?"}]})
    assert [(r["type"], r["ts"]) for r in providers.usno_phases(spark, p2).collect()] == [("full_moon", datetime(2025, 1, 13, 22, 27))]
    both = [lambda s: providers.moon_data(s, str(tmp_path / "none.json")), lambda s: providers.usno_phases(s, p2)]
    assert providers.phases_for_years(spark, 2025, 2025, both).count() == 1
    assert providers.phases_for_years(spark, 2025, 2025).count() == 49


def test_harmonic(spark, tmp_path):
    con = [{"name": "M2", "amp": 1.0, "phase": 2.0}]
    p = put(tmp_path / "h.json", {"stations": [{"name": "Gate (depth 30 ft)", "lat": 37.8199, "lon": -122.4783, "units": "knots", "constituents": con}, {"name": "B", "lat": 1.0, "lon": 2.0, "units": "m", "constituents": con}]})
    got = {r["type"]: r for r in harmonic.harmonic_json(spark, p).collect()}
    assert got["current"]["bid"] == "Ta18d334_30" and got["current"]["depth"] == 30.0 and got["tide"]["bid"] is None
    sites = harmonic.sites_csv(spark, put(tmp_path / "s.csv", "SITE NAME,SITE CODE,COUNTRY,LATITUDE,LONGITUDE\nCuxhaven,c,DEU,53.867,8.717\nNowhere,n,X,,\n"))
    row = "53.87\t8.72\t{}\t{}\t45.5\t0\t0\t0\tx\n"
    consts = harmonic.constants_tsv(spark, put(tmp_path / "t.tsv", row.format("M2", 130) + row.format("M2", 1) + row.format("ZZ", 5) + "short\tline\n"))
    made = harmonic.build_dataset(consts, sites).collect()
    assert [(r["name"], r["datum"], [(c["name"], c["amp"]) for c in r["constituents"]]) for r in made] == [("Cuxhaven", 1.3, [("M2", 1.3)])]


def test_storage(spark, tmp_path):
    rows = spark.createDataFrame([(1, datetime(2025, 1, 2)), (2, datetime(2025, 2, 2))], "k int, time timestamp_ntz")
    storage.write_events(rows, str(tmp_path / "ev"))
    assert [r["k"] for r in storage.read_events(spark, str(tmp_path / "ev"), "202502").collect()] == [2]
    for v in ("a", "b"):
        storage.append_lookup(spark.createDataFrame([("x", v)], "key string, value string"), str(tmp_path / "lk"))
    assert [r["value"] for r in storage.read_lookup(spark, str(tmp_path / "lk")).collect()] == ["b"]
    assert storage.to_json(spark.createDataFrame([(None,)], "a int")).first()[0] == '{"a":null}'
    f = put(tmp_path / "f.txt", "hello")
    assert storage.source_checksum(spark, [f, str(tmp_path / "no")]) == "5d41402a_00000000"


def test_catalog_and_cache(spark, tmp_path):
    rows = spark.createDataFrame([("a", "tide"), ("b", "current")], "id string, type string")
    speeds = spark.createDataFrame([("M2", 28.98)], "name string, speed double")
    storage.save_catalog(rows, spark.createDataFrame([("old", "a")], "alias string, id string"), speeds, str(tmp_path / "cat"))
    stations, aliases, again = storage.load_catalog(spark, str(tmp_path / "cat"))
    assert sorted(map(tuple, stations.collect())) == [("a", "tide"), ("b", "current")] and aliases.first()["id"] == "a" and again.first()["speed"] == 28.98
    assert [r["id"] for r in harmonic.of_kind(stations, "current").collect()] == ["b"]
    for day, check in (("2025-01-02", "x"), ("2025-04-02", "x"), ("2025-04-02", "y")):
        storage.write_stations(rows, str(tmp_path / "st"), day, check)
    assert storage.drop_stale_stations(spark, str(tmp_path / "st"), "2025Q2", "y") == 2
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "st")).select("quarter", "source_checksum").collect()} == {("2025Q2", "y")}
    (tmp_path / "cache").mkdir()
    for name in ("tides_v1_7_202412.json", "tides_v1_7_202506.json", "stations_v1_2024Q4.json", "lunar_phases_2020.json", "map.json"):
        put(tmp_path / "cache" / name, "12345")
    args = (spark, str(tmp_path / "cache"), "202506", "2025Q2", "2024")
    assert storage.clean_cache(*args, delete=False) == (3, 15) and storage.clean_cache(*args) == (3, 15) and storage.clean_cache(*args) == (0, 0)


def test_streams(spark, tmp_path):
    t0 = datetime(2025, 1, 1)
    for k, heights in enumerate(([1.0, 3.0], [2.0, 5.0, 4.0])):
        n = 2 * k
        spark.createDataFrame([(1, t0 + timedelta(minutes=10 * (n + i)), h) for i, h in enumerate(heights)], "station_id long, ts timestamp, height double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("station_id long, ts timestamp, height double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = levels.streaming_peaks(stream).writeStream.format("memory").queryName("pk").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert {(r["type"], r["height"]) for r in spark.sql("select * from pk").collect()} == {("High", 3.0), ("Low", 2.0), ("High", 5.0)}
    q = levels.windowed_levels(stream).writeStream.format("memory").queryName("wl").outputMode("update").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select max(high) from wl").first()[0] == 5.0
