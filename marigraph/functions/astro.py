"""Columns of astronomy: arguments of the tides, the moon's phase, sunrise and sunset."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .timefn import micros_between

#: Obliquity of the ecliptic and the moon's inclination (degrees), epoch of the series, Julian century (s).
OBLIQUITY = 23 + 27 / 60 + 8.26 / 3600
INCLINATION = 5 + 8 / 60 + 43.3546 / 3600
EPOCH = "1899-12-31 12:00:00"
CENTURY_SECONDS = 3155760000.0

#: Mean longitudes as polynomials of Julian centuries since the epoch, in degrees (Special Publication 98, table 1).
SERIES = {
    "s": (270 + 26 / 60 + 14.72 / 3600, 1336 * 360 + 1108411.2 / 3600, 9.09 / 3600, 0.0068 / 3600),
    "h": (279 + 41 / 60 + 48.04 / 3600, 129602768.13 / 3600, 1.089 / 3600, 0.0),
    "p": (334 + 19 / 60 + 40.87 / 3600, 11 * 360 + 392515.94 / 3600, -37.24 / 3600, -0.045 / 3600),
    "p1": (281 + 13 / 60 + 15 / 3600, 6189.03 / 3600, 1.63 / 3600, 0.012 / 3600),
    "n": (259 + 10 / 60 + 57.12 / 3600, -(5 * 360 + 482912.63 / 3600), 7.58 / 3600, 0.008 / 3600),
}


def sind(x: Column) -> Column:
    return F.sin(F.radians(x))


def cosd(x: Column) -> Column:
    return F.cos(F.radians(x))


def atan2d(y: Column, x: Column) -> Column:
    return F.degrees(F.atan2(y, x))


def seconds_since_epoch(ts: Column) -> Column:
    return micros_between(F.lit(EPOCH).cast("timestamp_ntz"), ts) / 1e6


def arguments(ts: Column) -> dict[str, Column]:
    """Mean longitudes s, h, p, p1 and n, and tau, the hour angle of the mean sun, in degrees."""
    seconds = seconds_since_epoch(ts)
    t = seconds / CENTURY_SECONDS
    out = {k: F.lit(a) + F.lit(b) * t + F.lit(c) * t * t + F.lit(d) * t * t * t for k, (a, b, c, d) in SERIES.items()}
    return out | {"tau": F.pmod(seconds / 86400 * 360, F.lit(360.0))}


#: Node factors of the equilibrium tide by formula number, over inclination (i), nu and the factors of M1 and L2.
def node_factor(number: Column, i: Column, nu: Column, qa: Column, ra: Column) -> Column:
    si, ch, sh = sind(i), cosd(i / 2), sind(i / 2)
    formulas = {
        73: (F.lit(2.0) / 3 - si**2) / 0.5021,
        74: si**2 / 0.1578,
        75: si * ch**2 / 0.38,
        76: sind(2 * i) / 0.7214,
        77: si * sh**2 / 0.0164,
        78: ch**4 / 0.9154,
        79: si**2 / 0.1565,
        144: (1 - 10 * sh**2 + 15 * sh**4) * ch**2 / 0.5873,
        149: ch**6 / 0.8758,
        206: si * ch**2 / 0.38 / qa,
        215: ch**4 / 0.9154 / ra,
        227: F.sqrt(0.8965 * sind(2 * i) ** 2 + 0.6001 * sind(2 * i) * cosd(nu) + 0.1006),
        235: F.sqrt(19.0444 * si**4 + 2.7702 * si**2 * cosd(2 * nu) + 0.0981),
    }
    out = F.lit(1.0)
    for k, f in formulas.items():
        out = F.when(number == k, f).otherwise(out)
    return out


def phase_angle(ts: Column) -> Column:
    """Elongation of the moon in degrees, 0 at new moon, by a short series (hours off at worst; kept as the results to match have it)."""
    # fixed values: the coefficients of a published short series of the sun's and moon's mean motion
    jd = micros_between(F.lit("2000-01-01 12:00:00").cast("timestamp_ntz"), ts) / 86400e6 + 0.5
    t = jd / 36525
    turn = lambda x: F.pmod(x, F.lit(360.0))
    sun = turn(280.46646 + 36000.76983 * t + 0.0003032 * t * t)
    sun_anomaly = turn(357.52911 + 35999.05029 * t - 0.0001537 * t * t)
    moon = turn(218.3165 + 481267.8813 * t)
    moon_anomaly = turn(134.9634 + 477198.8675 * t + 0.0087414 * t * t)
    elongation = turn(297.8502 + 445267.1115 * t - 0.0016300 * t * t)
    terms = -6.289 * sind(moon_anomaly) + 2.100 * sind(sun_anomaly) - 1.274 * sind(2 * elongation - moon_anomaly) - 0.658 * sind(2 * elongation) - 0.214 * sind(2 * moon_anomaly)
    return turn(moon - sun + terms)


#: Names of the eight phases, from 22.5 degrees before new moon on, 45 degrees each.
PHASES = ("new", "waxing_crescent", "first_quarter", "waxing_gibbous", "full", "waning_gibbous", "last_quarter", "waning_crescent")


def phase_name(angle: Column) -> Column:
    return F.get(F.array(*[F.lit(p) for p in PHASES]), F.floor(F.pmod(angle + 22.5, F.lit(360.0)) / 45).cast("int"))


def illuminated(angle: Column) -> Column:
    return (1 - cosd(angle)) / 2


def sun_event_hours(day: Column, lat: Column, lon: Column, rising: bool, zenith: float = 90 + 50 / 60) -> Column:
    """Hours after 00:00 UTC of the local date's sunrise or sunset, by the almanac's short method; null where the sun doesn't cross the zenith."""
    n = F.dayofyear(day).cast("double")
    hour = lon / 15
    t = n + ((6 if rising else 18) - hour) / 24
    m = 0.9856 * t - 3.289
    place = F.pmod(m + 1.916 * sind(m) + 0.020 * sind(2 * m) + 282.634, F.lit(360.0))
    ra = F.pmod(F.degrees(F.atan(0.91764 * F.tan(F.radians(place)))), F.lit(360.0))
    ra = (ra + F.floor(place / 90) * 90 - F.floor(ra / 90) * 90) / 15
    sin_dec = 0.39782 * sind(place)
    cos_dec = F.cos(F.asin(sin_dec))
    cos_h = (F.cos(F.radians(F.lit(zenith))) - sin_dec * sind(lat)) / (cos_dec * cosd(lat))
    angle = F.degrees(F.acos(F.when(F.abs(cos_h) <= 1, cos_h)))
    h = ((360 - angle) if rising else angle) / 15
    local = F.pmod(h + ra - 0.06571 * t - 6.622, F.lit(24.0))
    return local - hour
