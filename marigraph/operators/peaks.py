"""Extrema, crossings and types of series, by windows over one series each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import timefn


def extrema(points: DataFrame, key: str, ts: str, value: str, refine: bool = True, places: int = 3) -> DataFrame:
    """``key, type, ts, height`` of strict three-point extrema: High or Low.

    With ``refine`` a parabola through the three points moves time and height (to
    ``places``). First and last points and plateaus are never extrema.
    """
    w = Window.partitionBy(key).orderBy(ts)
    y = F.col(value)
    p = points.select(key, ts, y.alias("_y"), F.lag(y).over(w).alias("_a"), F.lead(y).over(w).alias("_c"), F.lag(ts).over(w).alias("_before"))
    a, b, c = F.col("_a"), F.col("_y"), F.col("_c")
    kind = F.when((b > a) & (b > c), "High").when((b < a) & (b < c), "Low")
    p = p.withColumn("type", kind).where("type is not null")
    if not refine:
        return p.select(key, "type", F.col(ts).alias("ts"), b.alias("height"))
    den = a - 2 * b + c
    step = timefn.micros_between(F.col("_before"), F.col(ts)) / 1e6
    offset = F.when(den != 0, (a - c) / (2 * den) * step).otherwise(0.0)
    top = F.when(den != 0, b - (a - c) * (a - c) / (8 * den)).otherwise(b)
    return p.select(key, "type", timefn.shift(F.col(ts), offset).alias("ts"), F.round(top, places).alias("height"))


def zero_crossings(points: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """``key, ts`` where a series goes from one side of 0 to 0 or beyond, between two points in proportion; a start at 0 is none."""
    w = Window.partitionBy(key).orderBy(ts)
    p = points.select(key, ts, F.col(value).alias("_y"), F.lag(value).over(w).alias("_a"), F.lag(ts).over(w).alias("_before"))
    a, b = F.col("_a"), F.col("_y")
    p = p.where(((a > 0) & (b <= 0)) | ((a < 0) & (b >= 0)))
    seconds = timefn.micros_between(F.col("_before"), F.col(ts)) / 1e6
    return p.select(key, timefn.shift(F.col("_before"), seconds * F.abs(a) / (F.abs(a) + F.abs(b))).alias("ts"))


def infer_types(points: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """``points`` with ``type``: High where a value isn't below the one before; the first one is measured by the second, an only one is null."""
    w = Window.partitionBy(key).orderBy(order)
    before = F.coalesce(F.lag(value).over(w), F.lead(value).over(w))
    return points.withColumn("type", F.when(F.col(value) >= before, "High").when(F.col(value) < before, "Low"))


def next_events(events: DataFrame, key: str, type_: str, ts: str, now, types: list[str] | None = None, values: tuple[str, ...] = ()) -> DataFrame:
    """The first event of each type after ``now`` for each key, with ``values``; groups are pre-aggregated, not sorted."""
    future = events.where(F.col(ts) > F.lit(now).cast("timestamp_ntz"))
    if types:
        future = future.where(F.col(type_).isin(types))
    first = future.groupBy(key, type_).agg(F.min_by(F.struct(ts, *values), F.struct(ts, *values)).alias("_e"))
    return first.select(key, type_, "_e.*")


def next_currents(events: DataFrame, now) -> DataFrame:
    """``station_id, type, ts, velocity``: the next slack, flood and ebb of each station after ``now``, types as titles; a slack has no velocity."""
    first = next_events(events.withColumn("type", F.lower("type")), "station_id", "type", "ts", now, ["slack", "flood", "ebb"], ("velocity",))
    return first.select("station_id", F.initcap("type").alias("type"), "ts", F.when(F.col("type") != "slack", F.col("velocity")).alias("velocity"))
