"""Near-duplicate documents by bottom-k sketches from one hash function.

1. One pass over the texts gives every document its set of word shingles as 64-bit
   hashes, of which only the size, a 128-bit fingerprint of the set and the k smallest
   values (the sketch) stay. Documents of equal sets are one vertex from here on.
2. Values that many vertices retain are counted. Each vertex lists itself under its
   rarest values only: so many that a pair over the threshold must meet in several
   lists (the prefix filter, with the overlap of two sketches bounded from below).
3. Members of a short list are paired. What meets in enough of them is estimated from
   the sketch of the union and confirmed on the full sets.
4. A long list has a hub, the member whose sketch is most common. Each member is
   compared with its hubs, not with all other members. Components of the links so far
   say which members of a list still lie apart. Where these are few, pairs are made that
   share a hub, lie in different components and overlap enough, judged by bits that
   tell which of the hub's values each holds. Where they are many (pages of one template,
   each with words of its own), members are listed again under further values: full
   sets are ordered by whether the hub has a value, those it lacks first, and each member
   lists itself under so many of its first values that a similar one must meet it in
   several lists. What is found is confirmed too, and components are taken again.

So a group of copies and a group of unlike pages of one template cost their size, not their
size squared, and no pair is dropped by a cap: all ways find the same links. Sets are
rebuilt from the texts of candidates only. What stays quadratic are members whose share of
the hub's values lies just below the threshold (0.90 to 0.92 of an equally large set at 85
hundredths) and that aren't linked: their further lists reach the hub's own values.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textarrays as ta
from .common import durable, pick, table
from .components import components


@dataclass(frozen=True)
class Config:
    """Shingle length in words; threshold in hundredths; sketch size; a value is frequent from ``frequent`` vertices on.

    A pair must meet in ``meetings`` lists, fewer for tiny sets; lists of up to ``short`` members are paired. A hub whose
    members would make more than ``dense`` pairs with those that lie apart has them listed under further values.

    ``sigmas`` standard deviations below its mean lies the least overlap of two
    sketches that a pair at the threshold is taken to have; 5 leaves a chance of
    about one in a million for such a pair, and none worth naming above it.
    """

    words: int = 5
    percent: int = 80
    k: int = 128
    frequent: int = 8
    sigmas: float = 5.0
    meetings: int = 4
    short: int = 32
    dense: int = 1 << 16

    def least_overlap(self, small: Column, large: Column, k: int | None = None) -> Column:
        """Least number of values that the sketches of two sets of these sizes share if the sets are similar enough."""
        p, k = self.percent / 100, k or self.k
        inside = F.ceil(F.lit(p / (1 + p)) * (small + large) - 1e-9)
        union = small + large - inside
        kept = F.least(F.lit(float(k)), large.cast("double"))
        mean = inside * kept / large
        q = inside / union
        spread = F.sqrt(mean * (1 - q) * F.greatest(F.lit(0.0), 1 - k / union))
        return F.greatest(F.lit(1.0), F.ceil(mean - self.sigmas * spread - 1e-9))

    def prefix(self, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many of its rarest values a set of n lists itself under, enough for any partner's size, and in how many lists it meets a partner at least."""
        p, n = self.percent / 100, np.asarray(n, float)
        kept = np.minimum(self.k, n)
        mean = np.where(n <= self.k, np.ceil(p * n - 1e-9), p * self.k)
        larger = n / p
        sigma = np.sqrt(p * self.k * (1 - p) * np.maximum(0, 1 - self.k / larger))
        # a set below k may meet one above it, whose sketch leaves out the rest
        beyond = np.where(larger > self.k, np.minimum(mean, p * self.k - self.sigmas * sigma), mean)
        least = np.maximum(1, np.ceil(beyond - 1e-9))
        meet = np.minimum(self.meetings, least)
        return (kept - least + meet).astype(np.int64), meet.astype(np.int64)


def sets(column: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending: owners, values, offsets. A-Z count as a-z."""
    data, offsets = ta.flat(column)
    data = ta.lower_ascii(data)
    s, e, per_text = ta.spans(data, offsets, ta.SPACED)
    doc, value = ta.shingles(ta.span_hashes(data, s, e), per_text, words)
    return ta.distinct_sorted(doc, value, len(column))


def _signed(x: np.ndarray) -> np.ndarray:
    """Unsigned hashes as longs of the same order, so that Spark's sorting of sketches agrees with ours."""
    return (x ^ np.uint64(1 << 63)).view(np.int64)


def _fingerprints(value: np.ndarray, offsets: np.ndarray) -> pa.Array:
    n = len(offsets) - 1
    both = np.stack([ta.mix(ta.segment_sums(ta.mix(value ^ np.uint64(salt)), offsets)) for salt in (0x1234567, 0x89ABCDEF01)], axis=1)
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), n, [None, pa.py_buffer(np.ascontiguousarray(both).tobytes())]).cast(pa.binary())


def sketch(docs: DataFrame, config: Config) -> DataFrame:
    """``doc_id, n_shingles, fp, sketch``: fp null and sketch empty for a text without words."""
    rows = pick(docs, doc_id="doc_id", text="text")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in ta.chunks(batch, "text"):
                doc, value, offsets = sets(part.column("text"), config.words)
                size = np.diff(offsets)
                low = (np.arange(len(doc)) - offsets[doc]) < config.k
                kept = np.append(0, np.cumsum(np.minimum(size, config.k)))
                fp = pa.compute.if_else(pa.array(size > 0), _fingerprints(value, offsets), pa.scalar(None, pa.binary()))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(size.astype(np.int64)), fp, ta.list_array(_signed(value[low]), kept, pa.int64())],
                    ["doc_id", "n_shingles", "fp", "sketch"],
                )

    return rows.mapInArrow(ta.tidy(run), f"doc_id {kind}, n_shingles long, fp binary, sketch array<long>")


def _bits(ids: DataFrame) -> tuple[int, np.ndarray]:
    """A filter of bits over a column of longs: its width follows their number, up to 8 MB. What it lets through may be wrong, what it stops isn't."""
    ids = durable(ids.toDF("id"))
    bits = int(min(26, max(16, np.ceil(np.log2(16 * max(1, ids.count()))))))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.unique(_slot(np.asarray(batch.column(0)), bits))
            word, at = np.unique(x >> 5, return_inverse=True)
            each = np.bincount(at, (1 << (x & 31)).astype(float), len(word)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(each)], ["word", "bits"])

    told = ids.mapInArrow(ta.tidy(mark), "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    mask = np.zeros(1 << (bits - 5), np.uint32)
    mask[told.column("word").to_numpy()] = told.column("bits").to_numpy().astype(np.uint32)
    return bits, mask


def _slot(ids: np.ndarray, bits: int) -> np.ndarray:
    return (ta.mix(ids.astype(np.int64).view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)


def _inside(ids: np.ndarray, bits: int, mask: np.ndarray) -> np.ndarray:
    slot = _slot(ids, bits)
    return (mask[slot >> 5] >> (slot & 31).astype(np.uint32) & 1).astype(bool)


def _among(spark: SparkSession, ids: DataFrame):
    """A test of a column of longs on executors: false for most values that aren't among ``ids`` and for null, true for all that are."""
    bits, mask = _bits(ids)
    sent = spark.sparkContext.broadcast(mask)

    def test(column: pa.Array) -> pa.Array:
        x = column.cast(pa.int64())
        return pa.compute.and_(pa.array(_inside(np.asarray(pa.compute.fill_null(x, 0)), bits, sent.value)), x.is_valid())

    return test


def _thinned(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """``df`` without most rows whose ``column`` isn't among ``ids``, before a join shuffles them; a null is let through by none."""
    among = _among(df.sparkSession, ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(among(batch.column(column)))

    return df.mapInArrow(ta.tidy(run), df.schema)


def _lists(vertices: DataFrame, config: Config) -> DataFrame:
    """``value, v, n, meet, rank``: the lists that each vertex is in; rank orders the members of a list, the most common sketch first.

    The frequent values come as a filter of bits, sized by their number up to 8 MB. A
    wrong bit only changes the order of a vertex's values, alike for all vertices.
    """
    frequent = vertices.select(F.explode("sketch").alias("value")).groupBy("value").count().where(F.col("count") >= config.frequent).select("value")
    bits, mask = _bits(frequent)
    sent = vertices.sparkSession.sparkContext.broadcast(mask)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = sent.value
        for batch in batches:
            kept = batch.column("sketch")
            value = np.asarray(kept.flatten()).view(np.uint64)
            size = np.diff(np.asarray(kept.offsets))
            doc = np.repeat(np.arange(len(size)), size)
            often = _inside(value.view(np.int64), bits, seen)
            order = np.lexsort((value, often, doc))
            start = np.append(0, np.cumsum(size))
            n = np.asarray(batch.column("n"))
            prefix, meet = config.prefix(n)
            take = (np.arange(len(doc)) - start[doc]) < prefix[doc]
            at = order[take]
            common = np.bincount(doc, often, len(size)).astype(np.int64)
            v = np.asarray(batch.column("v"))
            # fewer frequent values rank behind; ties go to the smaller id
            own = doc[at]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (value[at].view(np.int64), v[own], n[own], meet[own], config.k - common[own])], ["value", "v", "n", "meet", "rank"])

    return vertices.select("v", "n", "sketch").mapInArrow(ta.tidy(run), "value long, v long, n long, meet long, rank long")


def _overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


#: Words of 64 bits that mark which of a hub's smallest values a set holds; as many hold what the hub lacks.
WORDS = 8


def _masks(pairs: DataFrame) -> DataFrame:
    """Of (v, hub, n, low, hub_low, label, hub_label): the low values as bits over the hub's (m0 to m7), and bits of the values that the hub lacks (m8 to m15), ``extra`` in number."""
    bits = 64 * WORDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                yield mark(batch.slice(k, 512))

    def mark(batch: pa.RecordBatch) -> pa.RecordBatch:
        mine, hubs = batch.column("low"), batch.column("hub_low")
        a, b = (np.asarray(x.flatten()).view(np.uint64) for x in (mine, hubs))
        na, nb = (np.diff(np.asarray(x.offsets)) for x in (mine, hubs))
        n = batch.num_rows
        da, db = np.repeat(np.arange(n), na), np.repeat(np.arange(n), nb)
        place = np.arange(len(b)) - np.append(0, np.cumsum(nb))[db]
        row, value = np.concatenate([db, da]), np.concatenate([b, a])
        side = np.concatenate([np.zeros(len(b), np.int8), np.ones(len(a), np.int8)])
        order = np.lexsort((side, value, row))
        r, x, s = row[order], value[order], side[order]
        twin = np.zeros(len(r), bool)
        twin[1:] = (r[1:] == r[:-1]) & (x[1:] == x[:-1]) & (s[1:] == 1)
        words = np.zeros((n, 2 * WORDS), np.uint64)
        at = order[np.flatnonzero(twin) - 1]
        np.bitwise_or.at(words, (db[at], place[at] >> 6), np.uint64(1) << (place[at] & 63).astype(np.uint64))
        own = (s == 1) & ~twin
        slot = (ta.mix(x[own]) % np.uint64(bits)).astype(np.int64)
        np.bitwise_or.at(words, (r[own], WORDS + (slot >> 6)), np.uint64(1) << (slot & 63).astype(np.uint64))
        extra = np.bincount(r[own], minlength=n).astype(np.int64)
        cols = [batch.column(c) for c in ("v", "hub", "n", "label", "hub_label")] + [pa.array(extra)]
        return pa.RecordBatch.from_arrays([*cols, *[pa.array(np.ascontiguousarray(words[:, k]).view(np.int64)) for k in range(2 * WORDS)]], ["v", "hub", "n", "label", "hub_label", "extra", *[f"m{k}" for k in range(2 * WORDS)]])

    return pairs.select("v", "hub", "n", "low", "hub_low", "label", "hub_label").mapInArrow(ta.tidy(run), "v long, hub long, n long, label long, hub_label long, extra long, " + ", ".join(f"m{k} long" for k in range(2 * WORDS)))


def _full_sets(need: DataFrame, docs: DataFrame, vertices: DataFrame, config: Config) -> DataFrame:
    """``v, s``: the full sets of the vertices ``v`` in ``need``, rebuilt from their texts. Texts aren't shuffled, sets are."""
    need = durable(need.distinct())
    rows = pick(docs, doc_id="doc_id", text="text")
    among = _among(docs.sparkSession, need)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in ta.chunks(batch.filter(among(batch.column("doc_id"))), "text"):
                _, value, offsets = sets(part.column("text"), config.words)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), _fingerprints(value, offsets), ta.list_array(_signed(value), offsets, pa.int64())], ["v", "fp", "s"])

    full = rows.mapInArrow(ta.tidy(run), "v long, fp binary, s array<long>")
    of = need.join(vertices.select("v", "fp"), "v").select(F.col("v").alias("_v"), F.col("fp").alias("_fp"))
    return durable(full.join(of, (F.col("v") == F.col("_v")) & (F.col("fp") == F.col("_fp")), "left_semi").dropDuplicates(["v", "fp"]).select("v", "s"))


def _similar(a: Column, b: Column, config: Config) -> Column:
    """Whether two full sets reach the threshold."""
    shared = _overlap(a, b)
    return 100 * shared >= config.percent * (F.size(a) + F.size(b) - shared)


def _alike(a: Column, b: Column, n: Column, m: Column, k: int, config: Config) -> Column:
    """Whether sketches of k values, of sets of n and m, leave it open that the sets are similar: the union's sketch estimates it."""
    small, large = F.least(n, m), F.greatest(n, m)
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, k)
    estimate = F.size(F.array_intersect(union, F.array_intersect(a, b))) / F.size(union)
    p = config.percent / 100
    spread = F.sqrt(p * (1 - p) / F.size(union))
    return (100 * small >= config.percent * large) & (estimate >= p - config.sigmas * spread) & (_overlap(a, b) >= config.least_overlap(small, large, k))


def _confirm(pairs: DataFrame, full: DataFrame, config: Config) -> DataFrame:
    """Those of ``pairs`` (a, b) whose full sets reach the threshold."""
    one = pairs.join(full.select(F.col("v").alias("a"), F.col("s").alias("sa")), "a")
    both = one.join(full.select(F.col("v").alias("b"), F.col("s").alias("sb")), "b")
    return both.where(_similar(F.col("sa"), F.col("sb"), config)).select("a", "b").distinct()


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("v")).unionAll(pairs.select(F.col("b").alias("v")))


def _short_pairs(met: DataFrame, vertices: DataFrame, config: Config) -> DataFrame:
    """Pairs (a, b) that meet in enough short lists and whose sketches leave them open."""
    x, y = met.alias("x"), met.alias("y")
    both = x.join(y, (F.col("x.value") == F.col("y.value")) & (F.col("x.v") < F.col("y.v")))
    both = both.where(100 * F.least("x.n", "y.n") >= config.percent * F.greatest("x.n", "y.n"))
    pairs = both.groupBy(F.col("x.v").alias("a"), F.col("y.v").alias("b")).agg(F.count(F.lit(1)).alias("times"), F.max(F.least("x.meet", "y.meet")).alias("meet"))
    # a pair that shares a long list too may meet in fewer short ones: it goes by that list's hub
    return _open(durable(pairs.where("times >= meet").select("a", "b")), vertices, config)


def _open(pairs: DataFrame, vertices: DataFrame, config: Config) -> DataFrame:
    """Those of ``pairs`` (a, b) that the vertices' sketches leave open."""
    told = _thinned(vertices.select("v", "n", "sketch"), "v", _ends(pairs).distinct())
    one = pairs.join(told.select(F.col("v").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa")), "a")
    two = one.join(told.select(F.col("v").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb")), "b")
    return two.where(_alike(F.col("sa"), F.col("sb"), F.col("na"), F.col("nb"), config.k, config)).select("a", "b")


def links(docs: DataFrame, vertices: DataFrame, config: Config) -> tuple[DataFrame, DataFrame]:
    """(links that connect all similar vertices, labels ``v, label`` of the vertices that have links)."""
    lists = durable(_lists(vertices, config))
    top = lists.groupBy("value").agg(F.min(F.struct("rank", "v")).alias("top"), F.count(F.lit(1)).alias("m")).where("m > 1").select("value", F.col("top.v").alias("hub"), "m")
    met = durable(lists.join(top, "value").select("value", "v", "n", "meet", "hub", "m"))
    short = durable(_short_pairs(met.where(F.col("m") <= config.short), vertices, config))
    near = met.where(F.col("m") > config.short).select("v", "hub", "n").distinct()
    # sets of all members of long lists, and of the pairs from short ones
    near = durable(near)
    full = _full_sets(_ends(short).unionAll(near.select("v")), docs, vertices, config)
    by_hub = near.select("hub").distinct().join(full.select(F.col("v").alias("hub"), F.col("s").alias("hub_s")), "hub")
    low = lambda c: F.slice(c, 1, 64 * WORDS)
    both = near.join(full, "v").join(by_hub, "hub")
    star = both.where("v <> hub").where(_alike(low("s"), low("hub_s"), F.col("n"), F.size("hub_s"), 64 * WORDS, config)).where(_similar(F.col("s"), F.col("hub_s"), config))
    star = star.select(F.least("v", "hub").alias("a"), F.greatest("v", "hub").alias("b")).distinct()
    # each vertex against the smallest one that it meets; then what lies apart still
    first = short.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    found = durable(_confirm(first, full, config).union(star))
    labels = components(found)
    rest = short.join(first, ["a", "b"], "left_anti")
    for end in ("a", "b"):
        rest = rest.join(labels.select(F.col("v").alias(end), F.col("label").alias(f"{end}_label")), end, "left")
    rest = durable(rest.where(F.coalesce("a_label", "a") != F.coalesce("b_label", "b")).select("a", "b"))
    if not rest.isEmpty():
        found = durable(found.union(_confirm(rest, full, config)))
        labels = components(found)
    # members of a long list that lie apart still
    told = durable(near.join(labels, "v", "left").withColumn("label", F.coalesce("label", "v")))
    hub_label = told.where("v = hub").select("hub", F.col("label").alias("hub_label"))
    # summed before the join, so that a hub of very many members is a few rows in it
    counts = told.groupBy("hub", "label").agg(F.count(F.lit(1)).alias("m")).join(hub_label, "hub")
    sizes = counts.groupBy("hub", "hub_label").agg(F.sum(F.when(F.col("label") != F.col("hub_label"), F.col("m"))).alias("x"), F.sum("m").alias("m")).where("x > 0")
    told = durable(told.join(sizes.select("hub", "hub_label", (F.col("x") * F.col("m") > config.dense).alias("dense")), "hub"))
    of = lambda rows: rows.join(full, "v").join(by_hub, "hub")
    more = durable(_by_masks(of(told.where("not dense")), config).union(_by_values(of(told.where("dense")), vertices, config)))
    if more.isEmpty():
        return found, labels
    found = durable(found.union(_confirm(more, full, config)))
    return found, components(found)


def _by_masks(rows: DataFrame, config: Config) -> DataFrame:
    """Pairs (a, b) of members of one hub that lie apart and may be similar, of rows (v, hub, n, label, hub_label, s, hub_s)."""
    low = lambda c: F.slice(c, 1, 64 * WORDS)
    marked = _masks(rows.select("v", "hub", "n", low("s").alias("low"), low("hub_s").alias("hub_low"), "label", "hub_label"))
    marked = durable(marked)
    x, y = marked.where("label <> hub_label").alias("x"), marked.alias("y")
    c = lambda name: (F.col(f"x.{name}"), F.col(f"y.{name}"))
    common = lambda k: F.bit_count(c(f"m{k}")[0].bitwiseAND(c(f"m{k}")[1]))
    total = lambda terms: sum(terms[1:], terms[0])
    ones = lambda side: total([F.bit_count(F.col(f"{side}.m{k}")) for k in range(WORDS, 2 * WORDS)])
    # values of both that the hub lacks: common bits, and what shares a bit with another
    outside = F.least(c("extra")[0], c("extra")[1], total([common(k) for k in range(WORDS, 2 * WORDS)]) + F.least(c("extra")[0] - ones("x"), c("extra")[1] - ones("y")))
    inside = total([common(k) for k in range(WORDS)])
    small, large = F.least(*c("n")), F.greatest(*c("n"))
    meet = (c("hub")[0] == c("hub")[1]) & (c("label")[0] != c("label")[1]) & ((c("label")[1] == F.col("y.hub_label")) | (c("v")[0] < c("v")[1]))
    meet = meet & (100 * small >= config.percent * large) & (inside + outside >= config.least_overlap(small, large, 64 * WORDS))
    return x.join(y, meet).where("x.v <> y.hub and y.v <> y.hub").select(F.least(*c("v")).alias("a"), F.greatest(*c("v")).alias("b")).distinct()


#: Sizes of sets are put in classes, each reaching this many times its least size.
SIZE_STEP = 1.04


def _size_classes(most: int) -> np.ndarray:
    """Least sizes of the classes, ascending, up to beyond ``most``."""
    out, x = [1], 1
    while x <= most:
        x = max(x + 1, int(x * SIZE_STEP))
        out.append(x)
    return np.array(out, np.int64)


def _further_lists(v: np.ndarray, hub: np.ndarray, sizes: np.ndarray, values: np.ndarray, inside: np.ndarray, config: Config) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, meet, side) of the lists that sets enter; ``values`` are the sets end to end, ``inside`` tells which their hub has.

    A key stands for a hub, a value and the size classes of both partners; side is 0 for
    the smaller partner's class, 2 for the larger's and 1 where both are one. For each
    class of partners that a set of its size can be similar to, it enters so many lists
    of its first values, those the hub lacks first, that it meets each similar partner
    in ``meet`` lists: the prefix filter with the overlap that their sizes demand.
    """
    n, p = len(sizes), config.percent / 100
    doc = np.repeat(np.arange(n), sizes)
    order = np.lexsort((values, inside, doc))
    begin = np.append(0, np.cumsum(sizes))
    least = _size_classes(int(sizes.max(initial=1) / p) + 1)
    own = np.searchsorted(least, sizes, side="right") - 1
    first = np.searchsorted(least, np.ceil(p * sizes - 1e-9), side="right") - 1
    last = np.searchsorted(least, np.floor(sizes / p + 1e-9), side="right") - 1
    rows, keys, meets, sides = [], [], [], []
    base = ta.mix(ta.mix(values[order]) + hub.view(np.uint64)[doc])
    for step in range(int((last - first).max(initial=-1)) + 1):
        other = first + step
        live = other <= last
        other = np.minimum(other, len(least) - 1)
        need = np.ceil(p / (1 + p) * (sizes + np.maximum(least[other], p * sizes)) - 1e-9)
        both = np.ceil(p / (1 + p) * (least[own] + least[other]) - 1e-9)
        meet = np.maximum(1, np.minimum(config.meetings, both)).astype(np.int64)
        length = np.where(live, np.clip(sizes - need + meet, 0, sizes), 0).astype(np.int64)
        take = (np.arange(len(doc)) - begin[doc]) < length[doc]
        at = doc[take]
        pair = (np.minimum(own, other) << 20 | np.maximum(own, other)).astype(np.uint64)
        rows.append(at)
        keys.append(ta.mix(base[take] + pair[at] * np.uint64(0x9E3779B97F4A7C15)))
        meets.append(meet[at])
        sides.append((1 + np.sign(own - other))[at])
    join = lambda parts, kind: np.concatenate([np.zeros(0, kind), *parts])
    return join(rows, np.int64), join(keys, np.uint64), join(meets, np.int64), join(sides, np.int64)


def _by_values(rows: DataFrame, vertices: DataFrame, config: Config) -> DataFrame:
    """The same as ``_by_masks`` without meeting all members of a hub: they meet in lists of further values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                cols = [np.asarray(part.column(c)) for c in ("v", "hub", "n", "label")]
                mine, hubs = part.column("s"), part.column("hub_s")
                a, b = (np.asarray(x.flatten()).view(np.uint64) for x in (mine, hubs))
                na, nb = (np.diff(np.asarray(x.offsets)) for x in (mine, hubs))
                da, db = np.repeat(np.arange(len(na)), na), np.repeat(np.arange(len(nb)), nb)
                _, code = np.unique(np.concatenate([a, b]), return_inverse=True)
                inside = np.isin(da * (len(code) + 1) + code[: len(a)], db * (len(code) + 1) + code[len(a) :])
                at, key, meet, side = _further_lists(cols[0], cols[1], na, a, inside, config)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *[pa.array(c[at]) for c in (cols[0], cols[2], cols[3])], pa.array(meet), pa.array(side)], ["key", "v", "n", "label", "meet", "side"])

    listed = durable(rows.select("v", "hub", "n", "label", "s", "hub_s").mapInArrow(ta.tidy(run), "key long, v long, n long, label long, meet long, side long"))
    # a list whose members are linked already, or are of one size class of two, has nothing to find
    spans = [f(c).alias(f"{f.__name__}_{c}") for c in ("label", "side") for f in (F.min, F.max)]
    mixed = listed.groupBy("key").agg(*spans).where("min_label < max_label and (min_side < max_side or min_side = 1)").select("key")
    listed = durable(_thinned(listed, "key", mixed).join(mixed, "key"))
    x, y = listed.alias("x"), listed.alias("y")
    met = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.v") < F.col("y.v")) & (F.col("x.label") != F.col("y.label")) & (F.col("x.side") + F.col("y.side") == 2))
    met = met.where(100 * F.least("x.n", "y.n") >= config.percent * F.greatest("x.n", "y.n"))
    pairs = met.groupBy(F.col("x.v").alias("a"), F.col("y.v").alias("b")).agg(F.count(F.lit(1)).alias("times"), F.max("x.meet").alias("meet"))
    return _open(durable(pairs.where("times >= meet").select("a", "b")), vertices, config)


def near_duplicates(docs: DataFrame, config: Config = Config()) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``: documents linked by shingle sets of at least ``config.percent`` Jaccard similarity.

    A text of fewer words than a shingle has one shingle, all its words; a null text or
    one without words has none and links with nothing. component_id is the smallest
    doc_id reachable. Repeated rows each appear; texts whose smallest doc_id is the
    same are one vertex. A row whose doc_id is null takes its text's component and is
    kept only if that has no doc_id at all (component_id null). doc_id may be of any type
    that has an order.
    """
    if not isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        return _with_any_ids(docs, config)
    kind = docs.schema["doc_id"].dataType
    rows = durable(sketch(pick(docs, doc_id="doc_id", text="text").withColumn("doc_id", F.col("doc_id").cast("long")), config))
    groups = rows.where("fp is not null").groupBy("fp").agg(F.min("doc_id").alias("v"), F.min("n_shingles").alias("n"))
    groups = durable(groups)
    one = rows.join(groups.where("v is not null").select(F.col("fp").alias("_fp"), "v"), (F.col("fp") == F.col("_fp")) & (F.col("doc_id") == F.col("v")))
    # one of repeated rows, by the keys that the join dealt them by
    vertices = durable(one.dropDuplicates(["fp", "doc_id"]).select("v", "fp", F.col("n_shingles").alias("n"), "sketch"))
    _, labels = links(docs, vertices, config)
    told = rows.select(F.col("doc_id").cast(kind).alias("doc_id"), "n_shingles", "fp")
    ends = groups.join(labels, "v", "left").select(F.col("fp").alias("_fp"), F.coalesce("label", "v").alias("component_id"))
    # rows without words link with nothing and stay out of the join: they would all have one key
    out = told.join(ends, F.col("fp") == F.col("_fp")).select("doc_id", "n_shingles", F.col("component_id").cast(kind).alias("component_id"))
    out = out.unionByName(told.where("fp is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.select("*", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))


def _with_any_ids(docs: DataFrame, config: Config) -> DataFrame:
    """``near_duplicates`` by row numbers; a component's smallest doc_id is put in afterwards."""
    keyed = durable(docs.select(F.monotonically_increasing_id().alias("_uid"), docs["doc_id"].alias("_id"), docs["text"].alias("_text")))
    found = near_duplicates(keyed.select(F.col("_uid").alias("doc_id"), F.col("_text").alias("text")), config)
    rows = durable(found.select(F.col("doc_id").alias("_uid"), "n_shingles", F.col("component_id").alias("_c")).join(keyed.select("_uid", "_id"), "_uid"))
    least = rows.groupBy("_c").agg(F.min("_id").alias("component_id"))
    out = rows.join(least, "_c").select(F.col("_id").alias("doc_id"), "n_shingles", "component_id")
    return out.select("*", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))


#: The contract's shingles and threshold.
CONTRACT = Config(words=3, percent=85)


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), CONTRACT)


def keep_one(docs: DataFrame, config: Config = Config()) -> DataFrame:
    """The rows of ``docs`` with one row of each group of near duplicates, all columns as they are.

    Rows count one by one, whether their doc_id is null, repeated or neither; of a group
    the row of the smallest doc_id stays, null last. Texts without words all stay.
    """
    # the documents' own columns stay in one, away from ours
    keyed = durable(docs.select(F.struct("*").alias("_row"), F.monotonically_increasing_id().alias("_uid")))
    found = near_duplicates(keyed.select(F.col("_uid").alias("doc_id"), F.col("_row.text").alias("text")), config)
    found = durable(found.select(F.col("doc_id").alias("uid"), "component_id"))
    own = keyed.select(F.col("_uid").alias("uid"), F.col("_row.doc_id").alias("id"), F.xxhash64("_row.text").alias("hash"))
    # by doc_id and text, so that another layout of the same table keeps the same
    order = F.struct(F.col("id").isNull().alias("none"), "id", "hash", "uid")
    best = found.join(own, "uid").groupBy("component_id").agg(F.min(order).alias("best")).select(F.col("best.uid").alias("uid"))
    dropped = durable(found.select("uid").join(best, "uid", "left_anti"))
    return keyed.join(dropped, keyed["_uid"] == dropped["uid"], "left_anti").select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])


SQL = {
    "op9_minhash": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(words) < 3 THEN array_to_string(words, ' ') ELSE array_to_string(words[i:i + 2], ' ') END AS g
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 1, CASE WHEN len(words) > 0 THEN 2 ELSE 1 END))) AS i FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id),
m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT m.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, m.doc_id = component_id AS kept FROM m LEFT JOIN n USING (doc_id)
"""
}
