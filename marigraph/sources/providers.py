"""JSON of the providers' web services, as files that were fetched before; explicit schemas, no inference.

Files may hold an empty or broken document, which gives no rows. ``ord`` is a row's
place in its catalog.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import peaks


def _documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    text = spark.read.text(path, wholetext=True)
    return text.select(F.from_json("value", schema).alias("d"))


def _rows(spark: SparkSession, path: str, schema: str, field: str) -> DataFrame:
    return _documents(spark, path, schema).select(F.posexplode(F.col(f"d.{field}")).alias("pos", "r")).select(F.col("pos").cast("long").alias("ord"), "r.*")


def _number(c: Column) -> Column:
    """The number that a text begins with; 0 without one."""
    return F.coalesce(F.regexp_extract(c, r"^\s*([+-]?\d+(?:\.\d+)?)", 1).try_cast("double"), F.lit(0.0))


def _station(df: DataFrame, **columns: Column) -> DataFrame:
    names = {"name": "string", "alternate_names": "array<string>", "id": "string", "public_id": "string", "region": "string", "location": "string", "lat": "double", "lon": "double", "url": "string", "provider": "string", "bid": "string", "depth": "double", "kind": "string", "ord": "long"}
    return df.select(*[columns.get(n, F.lit(None)).cast(t).alias(n) for n, t in names.items()])


def noaa_tide_stations(spark: SparkSession, path: str, url: str = "") -> DataFrame:
    schema = "stationList array<struct<name: string, commonName: string, stationId: string, etidesStnName: string, stationFullName: string, region: string, state: string, lat: double, lon: double>>"
    r = _rows(spark, path, schema, "stationList")
    c = F.col
    # a missing part keeps its place between the commas
    location = F.array_join(F.array("etidesStnName", "region", "state"), ", ", "")
    return _station(r, name=c("etidesStnName"), alternate_names=F.array("etidesStnName", "commonName", "stationFullName"), id=c("stationId"), public_id=c("stationId"), region=F.coalesce(c("state"), c("region")), location=location, lat=c("lat"), lon=c("lon"), url=F.concat(F.lit(url), c("stationId")), provider=F.lit("noaa"), kind=F.lit("tide"), ord=c("ord"))


def noaa_tide_events(spark: SparkSession, path: str, station_id: str, url: str = "") -> DataFrame:
    """Predictions in feet; H is High, all else Low."""
    r = _rows(spark, path, "predictions array<struct<t: string, v: string, type: string>>", "predictions")
    at = F.to_timestamp_ntz(F.col("t"), F.lit("yyyy-MM-dd HH:mm"))
    return r.select(F.lit(station_id).alias("station_id"), F.when(F.col("type") == "H", "High").otherwise("Low").alias("type"), F.lit("ft").alias("units"), _number(F.col("v")).alias("prediction"), at.alias("time"), F.concat(F.lit(f"{url}&bdate="), F.date_format(at, "yyyyMMdd")).alias("url"))


def noaa_current_stations(spark: SparkSession, path: str, url: str = "") -> DataFrame:
    """Stations but for those of type W; their bid joins id and bin."""
    r = _rows(spark, path, "stations array<struct<id: string, name: string, type: string, currbin: int, lat: double, lng: double, depth: double>>", "stations")
    r = r.where((F.col("type") != "W") | F.col("type").isNull())
    c = F.col
    return _station(r, name=c("name"), alternate_names=F.array("name"), id=c("id"), public_id=c("id"), region=F.lit("United States"), location=c("name"), lat=c("lat"), lon=c("lng"), url=F.lit(url), provider=F.lit("noaa"), bid=F.concat(c("id"), F.lit("_"), c("currbin").cast("string")), depth=c("depth"), kind=F.lit("current"), ord=c("ord"))


def noaa_current_events(spark: SparkSession, path: str, bid: str, url: str = "") -> DataFrame:
    schema = "current_predictions struct<units: string, cp: array<struct<Type: string, meanFloodDir: string, meanEbbDir: string, Bin: string, Time: string, Depth: string, Velocity_Major: double>>>"
    r = _rows(spark, path, schema, "current_predictions.cp")
    at = F.to_timestamp_ntz(F.col("Time"), F.lit("yyyy-MM-dd HH:mm"))
    return r.select(F.lit(bid).alias("bid"), F.col("Bin").alias("bin"), F.lower("Type").alias("type"), F.col("meanFloodDir").alias("mean_flood_dir"), F.col("meanEbbDir").alias("mean_ebb_dir"), at.alias("time"), F.col("Depth").alias("depth"), F.col("Velocity_Major").alias("velocity_major"), F.concat(F.lit(f"{url}&d="), F.date_format(at, "yyyy-MM-dd")).alias("url"))


def split_bid(bid: str) -> tuple[str, str]:
    """Id and bin of a bid: what the last underscore before digits parts."""
    head, _, tail = bid.rpartition("_")
    if not head or not tail.isdigit():
        raise ValueError(f"no bin in {bid!r}")
    return head, tail


def chs_stations(spark: SparkSession, path: str, url: str = "") -> DataFrame:
    schema = "array<struct<id: string, code: string, officialName: string, alternativeName: string, latitude: double, longitude: double>>"
    r = _documents(spark, path, schema).select(F.posexplode("d").alias("pos", "r")).select(F.col("pos").cast("long").alias("ord"), "r.*")
    c = F.col
    region = geo.chs_region(c("latitude"), c("longitude"))
    return _station(r, name=c("officialName"), alternate_names=F.array_compact(F.array("officialName", "alternativeName")), id=c("id"), public_id=c("code"), region=region, location=c("officialName"), lat=c("latitude"), lon=c("longitude"), url=F.concat(F.lit(url), c("code")), provider=F.lit("chs"), kind=F.lit("tide"), ord=c("ord"))


def chs_tide_events(spark: SparkSession, path: str, station_id: str, url: str = "") -> DataFrame:
    """Highs and lows in metres; the service names no type, so the value before tells it."""
    r = _documents(spark, path, "array<struct<eventDate: string, value: double>>").select(F.posexplode("d").alias("pos", "r")).select("pos", "r.*", F.lit(station_id).alias("station_id"))
    at = F.to_timestamp_ntz(F.regexp_replace("eventDate", "Z$", ""))
    typed = peaks.infer_types(r.select("station_id", "pos", at.alias("time"), F.col("value").alias("prediction")), "station_id", "pos", "prediction")
    return typed.select("station_id", "type", F.lit("m").alias("units"), "prediction", "time", F.concat(F.lit(f"{url}/"), F.date_format("time", "yyyy-MM-dd")).alias("url"))


def moon_data(spark: SparkSession, path: str) -> DataFrame:
    """Phases numbered 0 to 3; rows without a date or with another number are left out."""
    r = _documents(spark, path, "array<struct<Date: string, Phase: int>>").select(F.explode("d").alias("r")).select("r.*")
    names = F.array(*[F.lit(x) for x in ("new_moon", "first_quarter", "full_moon", "last_quarter")])
    out = r.select(F.col("Date").try_cast("timestamp_ntz").alias("ts"), F.get(names, F.col("Phase")).alias("type"))
    return out.where("ts is not null and type is not null")


def usno_phases(spark: SparkSession, path: str) -> DataFrame:
    """Phases by name with year, month, day and time; unknown names are left out."""
    r = _rows(spark, path, "phasedata array<struct<year: int, month: int, day: int, time: string, phase: string>>", "phasedata")
    ts = F.format_string("%04d-%02d-%02d %s:00", "year", "month", "day", "time").try_cast("timestamp_ntz")
    name = F.lower(F.regexp_replace(F.regexp_replace("phase", " Quarter$", " Quarter"), " ", "_"))
    return r.select(ts.alias("ts"), name.alias("type")).where(F.col("type").isin("new_moon", "first_quarter", "full_moon", "last_quarter") & F.col("ts").isNotNull())


def phases_for_years(spark: SparkSession, first: int, last: int, readers=()) -> DataFrame:
    """Phases of the first reader that gives any for the years; else those of the ephemeris."""
    from ..operators.calendar import lunar_phases

    for reader in readers:
        try:
            found = reader(spark).where(F.year("ts").between(first, last))
            if not found.isEmpty():
                return found
        except Exception as error:  # a source that fails gives way to the next
            print(f"moon phases: {error}")
    return lunar_phases(spark, first, last)


def union_catalog(*parts: DataFrame) -> DataFrame:
    """Catalogs one after the other, in the order of preference; ``ord``, the catalog's rank and its own order, keeps that order."""
    out = None
    for k, part in enumerate(parts):
        placed = part.withColumn("ord", F.struct(F.lit(k).alias("rank"), F.col("ord").alias("ord")))
        out = placed if out is None else out.unionByName(placed)
    return out
