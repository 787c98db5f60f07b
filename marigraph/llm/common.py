"""Shared helpers of the text operators: reading, durable intermediate tables, field access."""

from __future__ import annotations

import contextlib
import os
import tempfile
import threading
import time
import uuid
import weakref

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rule ``[^\x20\x09-\x0D]+``, as a Java and DuckDB character class.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, read through Spark only (the path may be in a remote store)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """The folder that every executor shares: ``spark.checkpoint.dir``. In local mode, where that is unset, one of our own; on a cluster that raises."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")
    return found.rstrip("/")


def durable(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again.

    Cuts the lineage with a table that outlives the executors that wrote it; the
    files go when the application's JVM ends.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{uuid.uuid4().hex}"
    schema = df.schema
    (df.coalesce(partitions) if partitions else df).write.parquet(path)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(conf).deleteOnExit(where)
    give_back(spark)
    return spark.read.schema(schema).parquet(path)


def give_back(spark: SparkSession) -> None:
    """Collects the driver's garbage if its heap has grown beyond a third of its limit, so that the JVM returns what plans and ended tasks took.

    Left alone the heap grows to its limit over many queries, though little of it is in
    use. The same is done from now on while jobs run, as a long query writes no table
    meanwhile. Shuffle files and broadcasts that nothing refers to any more are cleaned, too.
    """
    jvm = spark.sparkContext._jvm
    heap = jvm.java.lang.Runtime.getRuntime()
    if 3 * heap.totalMemory() > heap.maxMemory():
        _collect(jvm)
    with _lock:
        watched = _watched.get(spark.sparkContext)
        if not watched or not watched.is_alive():
            _watched[spark.sparkContext] = watched = threading.Thread(target=_watch, args=(weakref.ref(spark.sparkContext), jvm), daemon=True)
            watched.start()


_lock, _watched = threading.Lock(), weakref.WeakKeyDictionary()


def _collect(jvm) -> None:
    """A collection after which at most 40 % of the heap are free (Java's default is 70 %), where the JVM has flags for that."""
    flags, were = None, {}
    try:
        flags = jvm.java.lang.management.ManagementFactory.getPlatformMXBean(jvm.java.lang.Class.forName("com.sun.management.HotSpotDiagnosticMXBean"))
        for name, ratio in (("MinHeapFreeRatio", "20"), ("MaxHeapFreeRatio", "40")):
            were[name] = flags.getVMOption(name).getValue()
            flags.setVMOption(name, ratio)
    except Py4JError:
        pass
    jvm.java.lang.System.gc()
    for name in reversed(were):
        with contextlib.suppress(Py4JError):
            flags.setVMOption(name, were[name])


def _watch(context, jvm) -> None:
    """Until the context stops: collects while jobs run and the heap is beyond a third of its limit and 1.5 times what the last collection left."""
    heap, least = jvm.java.lang.Runtime.getRuntime(), 0
    with contextlib.suppress(Exception):  # the JVM may end at any time
        while (sc := context()) is not None and sc._jsc is not None:
            if heap.totalMemory() > max(heap.maxMemory() / 3, least) and len(sc._jsc.statusTracker().getActiveJobIds()):
                _collect(jvm)
                least = 1.5 * heap.totalMemory()
            del sc
            time.sleep(1)


def crc_mod(column: str, modulus: int):
    """crc32 of the column's text form, modulo ``modulus``; null stays null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under our own names, so that extra or clashing ones do no harm."""
    return df.select(*[df[source].alias(target) for target, source in columns.items()])


def sampled(labels: DataFrame, most: int) -> DataFrame:
    """``doc_id, mark`` of labelled rows that may be learned from: mark 0 or 1, crc32(doc_id) mod 3 other than 1, one of each doc_id.

    More than ``most`` are thinned to about that number by a hash of doc_id, so the
    result can be broadcast and texts needn't be shuffled to meet their labels.
    """
    marks = labels.where("mark in (0, 1)").where(crc_mod("doc_id", 3) != 1).groupBy("doc_id").agg(F.min("mark").alias("mark"))
    there = marks.count()
    if there > most:
        marks = marks.where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit("sample")), F.lit(1_000_000)) < int(1_000_000 * most / there))
    return marks
