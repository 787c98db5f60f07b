"""Near-duplicate vectors by cross-polytope hashing.

Each of ``TABLES`` hash tables turns a vector with ``TURNS`` fast pseudorandom rotations
(three rounds of random signs and a Hadamard transform). The axis, with its sign, that
the turned vector is nearest to is one part of the bucket's name. A vector lies in the
bucket of its nearest axes and also probes the buckets with a second nearest axis in
place of a nearest one. Two vectors meet where one's own bucket is the other's own or
probed one; their cosine is then verified in double precision.

Equal vectors of one label are one class with a count from the start, so a vector that
is held many times costs its rows once. Buckets of classes are searched in blocks: a
bucket of many is dealt into blocks of about ``block``, and every pair of blocks is a
task's group, so no group grows with the data. (The number of links of each of m unlike
vectors in one dense cluster takes m squared comparisons by any way; a class is sent
m / ``block`` times for them.) From a group come only counts of links and, for each class,
the smallest of its part of the group; pairs are never written out. A pair that meets in
several buckets counts in the first of them alone, which both vectors' codes tell.
Buckets meet by hashes; label, length and code of a pair are compared too.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textarrays as ta
from .common import durable, table
from .components import components


@dataclass(frozen=True)
class Config:
    cosine: float = 0.93
    tables: int = 10
    turns: int = 2
    block: int = 2048
    seed: int = 77


PAIRS = 1 << 15
#: Groups of more vectors are compared by products of matrices first.
LARGE = 64


def _signs(config: Config, width: int) -> np.ndarray:
    return np.random.default_rng((config.seed, width)).choice([-1.0, 1.0], (config.tables, config.turns, 3, width))


def _hadamard(x: np.ndarray) -> np.ndarray:
    """The transform of every row, of a power of two entries."""
    n, width = x.shape
    step = 1
    while step < width:
        x = x.reshape(n, width // (2 * step), 2, step)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, width)
        step *= 2
    return x / np.sqrt(width)


def codes(x: np.ndarray, config: Config) -> tuple[np.ndarray, np.ndarray]:
    """Own bucket (rows, tables) and probed buckets (rows, tables, 2^turns; the first is the own one)."""
    n, d = x.shape
    width = 1 << max(1, int(np.ceil(np.log2(max(d, 2)))))
    full = np.zeros((n, width))
    full[:, :d] = x
    signs = _signs(config, width)
    probes = np.zeros((n, config.tables, 1 << config.turns), np.int64)
    rows = np.arange(n)
    for t in range(config.tables):
        for k in range(config.turns):
            y = full
            for r in range(3):
                y = _hadamard(y * signs[t, k, r])
            size = np.abs(y)
            best = size.argmax(axis=1)
            near = [2 * best + (y[rows, best] < 0)]
            size[rows, best] = -1
            second = size.argmax(axis=1)
            near.append(2 * second + (y[rows, second] < 0))
            for p in range(1 << config.turns):
                probes[:, t, p] = probes[:, t, p] * 2 * width + near[p >> k & 1]
    return probes[:, :, 0].copy(), probes


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    flat = column.flatten() if isinstance(column, (pa.ListArray, pa.LargeListArray)) else column
    return np.asarray(flat.cast(pa.float64()), dtype=np.float64), np.diff(np.asarray(column.offsets))


def unit_rows(vectors: DataFrame) -> DataFrame:
    """``uid, vec_id, label, dim, x``: dim is 0 and x empty for what links with nothing (null or no label, null, zero or non-finite)."""
    rows = vectors.select(F.monotonically_increasing_id().alias("uid"), F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("x"))
    fine = F.col("label").isNotNull() & F.col("x").isNotNull() & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("x", lambda v: v != 0)
    # scaled by the largest entry first, so that no square leaves the doubles
    most = F.array_max(F.transform("x", lambda v: F.abs(v)))
    return rows.withColumn("fine", F.coalesce(fine, F.lit(False))).select(
        "uid", "vec_id", "label", F.when(F.col("fine"), F.size("x")).otherwise(0).alias("dim"),
        F.when(F.col("fine"), F.transform("x", lambda v: v / most + 0.0)).otherwise(F.array().cast("array<double>")).alias("x"),
    )


def _entries(classes: DataFrame, config: Config) -> DataFrame:
    """One row per class with its buckets: uid, n (vectors), lab (hash of the label), dim, x of length 1, probes (tables * 2^turns codes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.asarray(batch.column("dim"))
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                part = batch.take(pa.array(at))
                flat, _ = _matrix(part.column("x"))
                x = flat.reshape(len(at), d)
                x = x / np.sqrt((x * x).sum(axis=1))[:, None]
                _, probes = codes(x, config)
                each = probes.shape[1] * probes.shape[2]
                lists = [pa.ListArray.from_arrays(pa.array((np.arange(len(at) + 1) * w).astype(np.int32)), pa.array(v.ravel())) for v, w in ((x, int(d)), (probes, each))]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("uid", "n", "lab", "dim")), *lists], ["uid", "n", "lab", "dim", "x", "probes"])

    return classes.select("uid", "n", "lab", "dim", "x").mapInArrow(ta.tidy(run), "uid long, n long, lab long, dim int, x array<double>, probes array<long>")


def _meetings(config: Config):
    """The search of one partition, sorted by group: yields (uid, links, least) of the vectors with links."""
    per = 1 << config.turns

    def pairs_of(sizes: np.ndarray, side: np.ndarray, single: np.ndarray):
        """Index pairs (i < j) within consecutive groups, at most about PAIRS at a time."""
        start = np.append(0, np.cumsum(sizes))
        for g in np.flatnonzero(sizes <= LARGE):
            at = np.arange(start[g], start[g + 1])
            if single[g]:
                left, right = at, at
            else:
                left, right = at[side[at] == 0], at[side[at] == 1]
            rows = max(1, PAIRS // max(1, len(right)))
            for a in range(0, len(left), rows):
                i, j = np.meshgrid(left[a : a + rows], right, indexing="ij")
                i, j = i.ravel(), j.ravel()
                if single[g]:
                    i, j = i[i < j], j[i < j]
                yield i, j

    def packed(parts):
        """Small batches of pairs joined until there are about PAIRS."""
        held, n = [], 0
        for i, j in parts:
            if len(i):
                held.append((i, j))
                n += len(i)
            if n >= PAIRS:
                yield tuple(np.concatenate(z) for z in zip(*held, strict=True))
                held, n = [], 0
        if held:
            yield tuple(np.concatenate(z) for z in zip(*held, strict=True))

    def large_pairs(sizes: np.ndarray, side: np.ndarray, single: np.ndarray, flat: np.ndarray, begin: np.ndarray, width: np.ndarray):
        """Index pairs of large groups whose product is near the threshold or above; a group's vectors of other lengths don't meet."""
        start = np.append(0, np.cumsum(sizes))
        for g in np.flatnonzero(sizes > LARGE):
            at = np.arange(start[g], start[g + 1])
            for d in np.unique(width[at]):
                own = at[width[at] == d]
                x = flat[begin[own][:, None] + np.arange(d)]
                left = np.flatnonzero(side[own] == 0) if not single[g] else np.arange(len(own))
                right = np.flatnonzero(side[own] == 1) if not single[g] else left
                rows = max(1, 8 * PAIRS // max(1, len(right)))
                for a in range(0, len(left), rows):
                    i, j = np.nonzero(x[left[a : a + rows]] @ x[right].T >= config.cosine - 1e-9)
                    i, j = own[left[a + i]], own[right[j]]
                    keep = i < j if single[g] else np.ones(len(i), bool)
                    for k in range(0, int(keep.sum()), PAIRS):
                        yield i[keep][k : k + PAIRS], j[keep][k : k + PAIRS]

    def search(t: pa.Table, key: np.ndarray):
        """All groups of ``t`` (rows sorted by group); key numbers the groups."""
        t = t.combine_chunks()
        uid, n, lab = (t.column(c).to_numpy() for c in ("uid", "n", "lab"))
        tab, code = t.column("tab").to_numpy(), t.column("code").to_numpy()
        own, side = t.column("own").to_numpy(zero_copy_only=False), t.column("side").to_numpy()
        lo, hi = t.column("lo").to_numpy(), t.column("hi").to_numpy()
        flat, width = _matrix(t.column("x").chunk(0))
        probe = np.asarray(t.column("probes").chunk(0).flatten()).reshape(t.num_rows, config.tables, per)
        begin = np.append(0, np.cumsum(width))
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        sizes = np.diff(np.append(first, t.num_rows))
        edges, links = [], np.zeros(t.num_rows, np.int64)
        single = (lo == hi)[first]
        for i, j in chain(packed(pairs_of(sizes, side, single)), large_pairs(sizes, side, single, flat, begin, width)):
            meet = (own[i] | own[j]) & (uid[i] != uid[j])
            # buckets met by a hash: what it stands for must be the same
            meet &= (lab[i] == lab[j]) & (width[i] == width[j]) & (tab[i] == tab[j]) & (code[i] == code[j])
            i, j = i[meet], j[meet]
            if not len(i):
                continue
            cos = np.empty(len(i))
            for d in np.unique(width[i]):
                m = width[i] == d
                grid = np.arange(d)
                cos[m] = np.einsum("ij,ij->i", flat[begin[i[m]][:, None] + grid], flat[begin[j[m]][:, None] + grid])
            near = cos >= config.cosine
            i, j = i[near], j[near]
            if not len(i):
                continue
            edges.append((i.astype(np.int32), j.astype(np.int32)))
            # the first table that joins the two, and there the smaller bucket
            a = (probe[i] == probe[j][:, :, :1]).any(axis=2)
            b = (probe[j] == probe[i][:, :, :1]).any(axis=2)
            table_ = (a | b).argmax(axis=1)
            r = np.arange(len(i))
            big = np.iinfo(np.int64).max
            bucket = np.minimum(np.where(a[r, table_], probe[j, table_, 0], big), np.where(b[r, table_], probe[i, table_, 0], big))
            here = (tab[i] == table_) & (code[i] == bucket)
            np.add.at(links, i[here], n[j[here]])
            np.add.at(links, j[here], n[i[here]])
        if not edges:
            return None
        i, j = (np.concatenate(z) for z in zip(*edges, strict=True))
        least = uid.copy()
        while True:  # smallest vector of each part of a group
            before = least.copy()
            low = np.minimum(least[i], least[j])
            np.minimum.at(least, i, low)
            np.minimum.at(least, j, low)
            if np.array_equal(before, least):
                break
        hit = np.unique(np.concatenate([i, j]))
        return pa.RecordBatch.from_arrays([pa.array(uid[hit]), pa.array(links[hit]), pa.array(least[hit])], ["uid", "links", "least"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(last: bool):
            t = pa.Table.from_batches(held)
            held.clear()
            cols = [t.column(c).to_numpy() for c in ("grp", "lo", "hi")]
            new = np.ones(t.num_rows, bool)
            new[1:] = np.any([c[1:] != c[:-1] for c in cols], axis=0)
            key = np.cumsum(new)
            whole = t.num_rows if last else int(np.flatnonzero(new)[-1])
            if whole < t.num_rows:
                held.extend(t.slice(whole).to_batches())
            return search(t.slice(0, whole), key[:whole]) if whole else None

        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                held.append(batch.slice(k, 4096))
                if (out := flush(False)) is not None:
                    yield out
        if held and (out := flush(True)) is not None:
            yield out

    return run


def near_duplicates(vectors: DataFrame, config: Config = Config()) -> DataFrame:
    """``vec_id, n_links, component_id, kept``: vectors of one label whose cosine is at least ``config.cosine``.

    Vectors that are null, zero or hold null or non-finite entries, and those without a
    label, link with nothing; so do vectors of different lengths. Repeated rows are
    vectors of their own. component_id is the smallest vec_id reachable; a row whose
    vec_id is null takes its component's, and is kept only where there is none. An empty
    table gives an empty table.
    """
    spark = vectors.sparkSession
    seen = unit_rows(vectors)
    equal = [F.when(F.col("dim") > 0, F.xxhash64(F.lit(salt), "label", "dim", "x")) for salt in (1, 2)]
    rows = durable(seen.withColumns({"h1": equal[0], "h2": equal[1], "lab": F.xxhash64(F.lit(3), "label")}))
    # equal vectors of a label are one class, named by its smallest row
    named = durable(rows.where("dim > 0").groupBy("h1", "h2").agg(F.min("uid").alias("c"), F.count(F.lit(1)).alias("n")))
    first = named.select(F.col("c").alias("uid"), "n")
    each = durable(_entries(rows.where("dim > 0").select("uid", "lab", "dim", "x").join(first, "uid"), config))
    per = 1 << config.turns
    codes_of = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(config.tables - 1)), lambda t: F.slice("probes", t * per + 1, per)))
    flat = each.select("uid", "lab", "dim", codes_of.alias("tab", "own_codes")).select("uid", "lab", "dim", "tab", F.posexplode("own_codes").alias("p", "code"))
    # a probe may be the own bucket again
    flat = flat.groupBy("uid", "lab", "dim", "tab", "code").agg(F.min("p").alias("p")).withColumn("grp", F.xxhash64("lab", "dim", "tab", "code"))
    size = flat.groupBy("grp").agg(F.count(F.lit(1)).alias("m"), F.sum((F.col("p") == 0).cast("int")).alias("owners")).where("m > 1 and owners > 0").select("grp", F.ceil(F.col("m") / config.block).cast("int").alias("blocks"))
    met = flat.join(size.hint("merge"), "grp")
    mine = F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int")
    dealt = met.withColumn("mine", mine).select("uid", "tab", "code", "grp", (F.col("p") == 0).alias("own"), "mine", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("uid", "tab", "code", "grp", "own", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), (F.col("mine") > F.col("other")).cast("int").alias("side"))
    full = dealt.join(each.select("uid", "n", "lab", "x", "probes").hint("merge"), "uid")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    found = full.repartition(n, "grp", "lo", "hi").sortWithinPartitions("grp", "lo", "hi").mapInArrow(ta.tidy(_meetings(config)), "uid long, links long, least long")
    found = durable(found)
    links = found.groupBy("uid").agg(F.sum("links").alias("links"))
    labels = components(found.where("uid <> least").select(F.col("uid").alias("a"), F.col("least").alias("b")))
    told = named.join(links, named["c"] == links["uid"], "left").drop("uid").join(labels, F.col("c") == F.col("v"), "left")
    told = durable(told.select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("label", "c").alias("part")))
    fine = rows.where("dim > 0").select("vec_id", "h1", "h2").join(told, ["h1", "h2"]).select("vec_id", "n_links", "part")
    least = fine.groupBy("part").agg(F.min("vec_id").alias("component_id"))
    out = fine.join(least, "part").select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id")
    out = out.unionByName(rows.where("dim = 0").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.select("*", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


SQL = {
    "op10_embedding_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings),
u AS (SELECT *, sqrt(list_sum(list_transform(x, lambda a: a * a))) AS n FROM v
  WHERE label IS NOT NULL AND x IS NOT NULL AND len(list_filter(x, lambda a: a IS NULL OR isnan(a) OR isinf(a))) = 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND a.n > 0 AND b.n > 0
  WHERE list_dot_product(a.x, b.x) / (a.n * b.n) >= 0.93),
r(vec_id, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT p.b, r.c FROM r JOIN p ON p.a = r.vec_id),
m AS (SELECT vec_id, min(c) AS component_id FROM r GROUP BY vec_id),
k AS (SELECT a AS vec_id, count(*) AS n FROM p GROUP BY a)
SELECT m.vec_id, CAST(coalesce(k.n, 0) AS BIGINT) AS n_links, component_id, m.vec_id = component_id AS kept FROM m LEFT JOIN k USING (vec_id)
"""
}
