"""Sinks: event and station tables in partitions, lookups that grow, calendars and JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators.calendar import to_ics


def write_events(events: DataFrame, path: str, time: str = "time") -> None:
    """Events as Parquet by month; months that are written replace those there."""
    out = events.withColumn("yyyymm", F.date_format(time, "yyyyMM"))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("yyyymm").parquet(path)


def read_events(spark: SparkSession, path: str, month: str) -> DataFrame:
    """One month's events; other months' folders aren't opened."""
    return spark.read.parquet(path).where(F.col("yyyymm") == month).drop("yyyymm")


def write_stations(stations: DataFrame, path: str, day, checksum: str) -> None:
    """A catalog as Parquet by quarter and its sources' checksum."""
    quarter = F.concat(F.year(F.lit(day).cast("date")).cast("string"), F.lit("Q"), F.quarter(F.lit(day).cast("date")).cast("string"))
    out = stations.withColumn("quarter", quarter).withColumn("source_checksum", F.lit(checksum))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("quarter", "source_checksum").parquet(path)


def _path(spark: SparkSession, path: str):
    """A path and its file system."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def drop_stale_stations(spark: SparkSession, path: str, quarter: str, checksum: str) -> int:
    """Deletes all versions of a catalog but one; returns how many went."""
    top, files = _path(spark, path)
    gone = 0
    for a in files.listStatus(top):
        for b in files.listStatus(a.getPath()) if a.isDirectory() else ():
            if b.isDirectory() and (a.getPath().getName(), b.getPath().getName()) != (f"quarter={quarter}", f"source_checksum={checksum}"):
                files.delete(b.getPath(), True)
                gone += 1
        if a.isDirectory() and not files.listStatus(a.getPath()):
            files.delete(a.getPath(), True)
    return gone


def clean_cache(spark: SparkSession, path: str, month: str, quarter: str, year: str, delete: bool = True) -> tuple[int, int]:
    """Files of a cache folder older than the given month, quarter or year, and their bytes; they are deleted, except with ``delete`` off."""
    found = spark.read.format("binaryFile").load(path).select("path", "length")  # contents aren't read
    name = F.element_at(F.split("path", "/"), -1)
    stale = found.where(text.cache_stale(name, F.lit(month), F.lit(quarter), F.lit(year)))
    n, size = stale.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
    for r in stale.select("path").toLocalIterator() if delete else ():
        where, files = _path(spark, r["path"])
        files.delete(where, False)
    return n, size


def save_catalog(stations: DataFrame, aliases: DataFrame, speeds: DataFrame, path: str) -> None:
    """Harmonic stations (with their constituents), aliases (alias, id) and speeds (name, speed) as three tables."""
    for name, rows in (("stations", stations), ("aliases", aliases), ("speeds", speeds)):
        rows.write.mode("overwrite").parquet(f"{path}/{name}")


def load_catalog(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The stations, aliases and speeds that ``save_catalog`` wrote."""
    return tuple(spark.read.parquet(f"{path}/{name}") for name in ("stations", "aliases", "speeds"))


def source_checksum(spark: SparkSession, paths: list[str]) -> str:
    """First 8 digits of each file's MD5, joined; zeros for a missing file."""
    out = []
    for p in paths:
        try:
            out.append(spark.read.format("binaryFile").load(p).select(F.substring(F.md5("content"), 1, 8)).first()[0])
        except Exception:
            out.append("0" * 8)
    return "_".join(out)


def require_files(spark: SparkSession, paths: list[str]) -> None:
    """Raises FileNotFoundError with the paths that lack a file."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    missing = [p for p in paths if not jvm.org.apache.hadoop.fs.Path(p).getFileSystem(conf).exists(jvm.org.apache.hadoop.fs.Path(p))]
    if missing:
        raise FileNotFoundError(", ".join(missing))


def append_lookup(rows: DataFrame, path: str) -> None:
    """Adds rows (key, value) to a lookup; later ones win on reading."""
    rows.select("key", "value", F.current_timestamp().alias("written")).write.mode("append").parquet(path)


def read_lookup(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).groupBy("key").agg(F.max_by("value", "written").alias("value"))


def to_json(rows: DataFrame, name: str = "json") -> DataFrame:
    """Each row as a JSON text that keeps null fields."""
    return rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias(name))


def calendar_text(rows: DataFrame, name: str, description: str | None = None) -> str:
    """The ICS text of one station's calendar; a calendar holds a window of some months, so its rows fit the driver."""
    return to_ics((r.asDict() for r in rows.toLocalIterator()), name, description)
