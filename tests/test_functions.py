import pytest
from pyspark.sql import functions as F

from marigraph.functions import astro, geo, text, timefn
from marigraph.functions.coords import gps, normalize, parse_gps


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "seconds, shown",
    [(11, "0min"), (-24, "0min"), (130, "+2min"), (-180, "-3min"), (2520, "+42min"), (7800, "+2hr10min"), (-7200, "-2hr"), (-4200, "-2hr10min")],
)
def test_time_delta(spark, seconds, shown):
    assert one(spark, text.time_delta(F.lit(seconds))) == shown


@pytest.mark.parametrize("diff, shown", [(-0.03, "0ft"), (1.7, "+1.7ft"), (-0.9, "-0.9ft")])
def test_height_delta(spark, diff, shown):
    assert one(spark, text.height_delta(F.lit(diff), F.lit("ft"))) == shown


def test_depth_units(spark):
    f = lambda v, u, w: one(spark, text.convert_depth(F.lit(v), F.lit(u), F.lit(w)))
    assert f(7.5, "ft", "ft") == 7.5
    assert f(4.0, "m", "ft") == 13.123
    assert f(6.56168, "ft", "m") == 2.0


@pytest.mark.parametrize("raw, hours", [("09:00:00", 9.0), ("-03:30:00", -3.5), ("05:45:00", 5.75), (None, 0.0), ("", 0.0), ("\\N", 0.0)])
def test_meridian(spark, raw, hours):
    assert one(spark, text.meridian_hours(F.lit(raw).cast("string"))) == hours


def test_names(spark):
    assert one(spark, text.depth_in_name(F.lit("Old Mill Narrows (depth 12 ft), Heron Bay"))) == 12.0
    assert one(spark, text.depth_in_name(F.lit("no depth"))) is None
    assert one(spark, text.state_of(F.lit("Blue Rock Landing, Grey Sound, Oregon"))) == "OR"
    assert one(spark, text.clean_name(F.lit("Gull Passage, Alaska Current"), F.lit("current"), F.lit("AK"))) == "Gull Passage"
    assert one(spark, text.titleize(F.lit("old_mill-narrows"))) == "Old Mill Narrows"
    assert one(spark, text.zone_offset(F.lit(-530))) == "-05:30:00"
    assert one(spark, text.minutes_offset(F.lit(None).cast("int"))) is None
    assert text.search_terms('“heron bay” narrows, or') == ["heron bay", "narrows", "or"]


def test_titles(spark):
    assert one(spark, text.tide_title(F.lit("Low"), F.lit(0.4), F.lit("m"))) == "Low Tide 0.4 m"
    assert one(spark, text.current_title(F.lit("ebb"), F.lit(-2.6), F.lit(35), F.lit(215), F.lit(22))) == "Ebb 2.6kts 215T 22ft"
    assert one(spark, text.current_title(F.lit("slack"), F.lit(0.0), F.lit(None).cast("int"), F.lit(None).cast("int"), F.lit(None).cast("int"))) == "Slack"


def test_cache_stale(spark):
    f = lambda n: one(spark, text.cache_stale(F.lit(n), F.lit("202506"), F.lit("2025Q2"), F.lit("2025")))
    assert f("tides_v3_77_202412.json") and not f("tides_v3_77_202506.json")
    assert f("stations_v3_2024Q4_ff.json") and f("lunar_phases_2023.json") and not f("other.json")


def test_distance(spark):
    degree = one(spark, geo.haversine(F.lit(10.0), F.lit(25.0), F.lit(11.0), F.lit(25.0)))
    assert degree == pytest.approx(111.1949, abs=1e-3)
    assert one(spark, geo.haversine(F.lit(60.0), F.lit(5.0), F.lit(60.0), F.lit(5.0))) == 0
    assert one(spark, geo.haversine(F.lit(None).cast("double"), F.lit(0.0), F.lit(0.0), F.lit(0.0))) is None


@pytest.mark.parametrize("lon, same", [(0.0, 0.0), (190.0, -170.0), (-190.0, 170.0), (180.0, 180.0), (-180.0, -180.0), (550.0, -170.0)])
def test_normalize_lon(spark, lon, same):
    assert one(spark, geo.normalize_lon(F.lit(lon))) == same


@pytest.mark.parametrize(
    "region, location, lon, zone",
    [(None, "Tampa Bay, FL", 0.0, "America/New_York"), ("Pacific Canada", None, 0.0, "America/Vancouver"), ("Hawaii", "", 0.0, "Pacific/Honolulu"), ("x", "y", -75.0, "America/New_York"), ("x", "y", 60.0, "Etc/GMT-4"), ("x", "y", -180.0, "Etc/GMT+12")],
)
def test_timezone(spark, region, location, lon, zone):
    assert one(spark, geo.timezone_fallback(F.lit(region).cast("string"), F.lit(location).cast("string"), F.lit(lon))) == zone


def test_window(spark):
    d = F.lit("2025-01-15").cast("date")
    assert str(one(spark, timefn.window_begin(d))) == "2024-12-01"
    assert str(one(spark, timefn.window_end(d, 13))) == "2025-12-28"
    assert str(one(spark, timefn.window_end(d, 12))) == "2025-11-30"
    june = F.lit("2025-06-15").cast("date")
    assert str(one(spark, timefn.window_begin(june))) == "2025-05-01"
    assert str(one(spark, timefn.window_end(june, 13))).startswith("2026-05")


def test_phase_angle(spark):
    assert one(spark, astro.phase_angle(F.lit("2025-01-01").cast("timestamp_ntz"))) == pytest.approx(28.338486259, abs=1e-6)


def test_sun(spark):
    day = F.lit("2025-06-21").cast("date")
    rise = one(spark, astro.sun_event_hours(day, F.lit(42.36), F.lit(-71.06), True))
    assert rise == pytest.approx(9 + 7 / 60, abs=0.1)  # 05:07 in Boston
    assert one(spark, astro.sun_event_hours(day, F.lit(80.0), F.lit(0.0), True)) is None


@pytest.mark.parametrize(
    "raw, lat, lon",
    [
        ("64.1466° N, 21.9426° W", 64.1466, -21.9426), ("-54.8019, -68.3030", -54.8019, -68.303), ("59°54'50\"N, 10°45'8\"E", 59.913889, 10.752222),
        ("34°36'12.6\"S, 58°22'53.4\"W", -34.6035, -58.3815), ("35°41.4'N, 139°41.52'E", 35.69, 139.692), ("1 17 24.6 N, 103 51 7.2 E", 1.290167, 103.852),
        ("41°54'9\" N 12°29'47\" E", 41.9025, 12.496389), ("48,85661° N, 2,35222° E", 48.85661, 2.35222), ("18.0179s 76.8099w", -18.0179, -76.8099),
        ("12.25, 190.5", 12.25, -190.5), ("N 60 10.2 E 24 56.4", 60.17, 24.94), ("24.94 E, 60.17 N", 60.17, 24.94), ("60 10 12, -24 56 24", 60.17, -24.94),
        ("nowhere at all", 0, 0), ("-33 51, 151 12", 33.85, 151.2), ("60.17 24.94", 60.17, 24.94),
    ],
)
def test_coordinates(raw, lat, lon):
    assert normalize(raw) == pytest.approx((lat, lon), abs=2e-4)


def test_coordinates_refused(spark):
    assert parse_gps("91.5, 10.0") is None and parse_gps("") is None and parse_gps(None) is None and parse_gps("x") is None
    rows = spark.createDataFrame([("10.0, 20.0",), (None,)], "t string").select(gps(F.col("t")).alias("g")).select("g.lat", "g.lon").collect()
    assert sorted(rows, key=str) == [(10.0, 20.0), (None, None)]
