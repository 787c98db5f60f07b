"""Harmonic constants: JSON stations, a site list and constants as separated text, and our own Parquet form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, text
from ..operators.cluster import roll_up_constituents
from ..operators.proximity import first_in_box

_JSON = "stations array<struct<name: string, lat: double, lon: double, timezone: string, region: string, units: string, datum_offset: double, constituents: array<struct<name: string, amp: double, phase: double>>>>"


def harmonic_json(spark: SparkSession, path: str) -> DataFrame:
    """Stations of one JSON document; knots mark currents, the id comes from the place, a depth from the name. A broken file gives no rows."""
    d = spark.read.text(path, wholetext=True).select(F.from_json("value", _JSON).alias("d"))
    r = d.select(F.posexplode("d.stations").alias("ord", "s")).select(F.col("ord").cast("long"), "s.*")
    kind = F.when(F.col("units") == "knots", "current").otherwise("tide")
    id_ = text.coordinate_id("T", F.col("lat"), F.col("lon"))
    depth = text.depth_in_name(F.col("name"))
    bid = F.when(kind == "current", F.concat(id_, F.lit("_"), F.coalesce(depth.cast("int"), F.lit(0)).cast("string")))
    out = r.select(
        id_.alias("id"), bid.alias("bid"), "name", "lat", "lon", "region", "units", kind.alias("type"), F.coalesce("datum_offset", F.lit(0.0)).alias("datum"),
        F.lit(0.0).alias("meridian"), "constituents", depth.alias("depth"), "timezone", "ord",
    )
    # stations at one place share an id; the last one holds
    last = out.groupBy(F.coalesce("bid", "id").alias("_k")).agg(F.max_by(F.struct("*"), "ord").alias("s"))
    return last.select("s.*")


def sites_csv(spark: SparkSession, path: str) -> DataFrame:
    """Sites (name, code, country, lat, lon, ord) of a CSV with headings; rows without a place are left out."""
    c = spark.read.csv(path, header=True)
    out = c.select(F.col("SITE NAME").alias("name"), F.col("SITE CODE").alias("code"), F.col("COUNTRY").alias("country"), F.col("LATITUDE").try_cast("double").alias("lat"), F.col("LONGITUDE").try_cast("double").alias("lon"), F.monotonically_increasing_id().alias("ord"))
    return out.where("lat is not null and lon is not null")


def constants_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Constants (id, lat, lon, constituent, amp in metres, phase, ord) of a tab-separated file without headings, of nine columns at least."""
    names = [f"c{i}" for i in range(9)]
    schema = ", ".join(f"{n} string" for n in names)
    c = spark.read.csv(path, sep="\t", schema=schema).where("c8 is not null")
    lat, lon = F.col("c0").try_cast("double"), F.col("c1").try_cast("double")
    lon = F.when(lon > 180, lon - 360).otherwise(lon)
    out = c.select(lat.alias("lat"), lon.alias("lon"), F.trim("c2").alias("constituent"), (F.col("c3").try_cast("double") / 100).alias("amp"), F.col("c4").try_cast("double").alias("phase"), F.monotonically_increasing_id().alias("ord"))
    return out.withColumn("id", text.coordinate_id("T", F.col("lat"), F.col("lon")))


def of_kind(stations: DataFrame, kind: str) -> DataFrame:
    """The tide stations or the current stations of a harmonic catalog."""
    return stations.where(F.col("type") == kind)


#: Constituents that every licence of the source allows to pass on.
SAFE = ("M2", "S2", "N2", "K2", "K1", "O1", "P1", "Q1", "M4")


def build_dataset(constants: DataFrame, sites: DataFrame, constituents: tuple[str, ...] = SAFE, degrees: float = 0.01) -> DataFrame:
    """Stations with a site's name and country (the first within ``degrees``), constituents, datum and time zone."""
    rows = constants.where(F.col("constituent").isin(*constituents)).withColumn("name", F.lit("Unknown"))
    stations = roll_up_constituents(rows)
    named = first_in_box(stations.select("id", "lat", "lon"), sites, degrees, "name")
    land = first_in_box(stations.select("id", "lat", "lon"), sites, degrees, "country")
    out = stations.drop("name").join(named, "id").join(land, "id")
    region = text.region_label(F.lit(None).cast("string"), F.col("country"))
    return out.select("id", F.coalesce("name", F.lit("Unknown")).alias("name"), "lat", "lon", region.alias("region"), geo.timezone_fallback(F.col("country"), F.col("name"), F.col("lon")).alias("timezone"), F.lit("m").alias("units"), "datum", "constituents")
