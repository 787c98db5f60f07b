"""Mixing sources to target weights, by DataFrame functions only.

Each source's documents, in a pseudorandom order, form one stream of words that is
cut into blocks of a fixed length. A source's target (``targets``) gives its number of
slots. Output shards have a fixed number of slots, and every slot of a shard draws its
source with the targets as weights, so a shard's counts of the sources are multinomial.

The draws' sums miss the targets by chance, so they are repaired by one rule: the slots
of a source are numbered by shard and place; those from its target on are surplus, and
the surplus slots, in order of source, go to the sources that lack slots, in order of
source. The j-th slot of a source takes the block at place ``j mod n`` of the source's
pseudorandom permutation of its n blocks; ``j div n`` is the epoch. Slots and blocks meet
in a join by index.

Places in a stream and numbers of slots are prefix sums in three levels, so no window
gathers a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable, table

BLOCK_WORDS = 128
SHARD_SLOTS = 1024
SHARE, CAP, WEIGHTS = 1.5, 2, (5, 2, 1)
SEED, ROUNDS, FAN = 20240, 24, 256
#: Up to this many sources, the table that maps a draw to its source (at most five times as many rows) is sent to every executor.
FEW_SOURCES = 1 << 16

_SPACES = r"[\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Number of words; a null text has none."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), _SPACES, -1), lambda w: w != "")).cast("long")


def targets(sizes: DataFrame, share: float = SHARE, cap: int = CAP, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``source, source_size`` with weight and target.

    Weights repeat over the sources by code point, null last. ``share`` times all
    sizes goes out by weight; no target is over ``cap`` times its source's size, and
    the excess goes to the others by weight. By ascending size per weight the capped
    sources come first, so one pass over running sums finds the level. The windows
    run over one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.get(F.array(*[F.lit(w) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights))
    every = Window.partitionBy()
    rise = Window.orderBy(F.col("ratio"), F.col("source").asc_nulls_last())
    before = rise.rowsBetween(Window.unboundedPreceding, -1)
    out = sizes.withColumn("weight", weight).withColumn("limit", (cap * F.col("source_size")).cast("double")).withColumn("ratio", F.col("limit") / F.col("weight"))
    rest = share * F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    left = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    out = out.withColumn("level", rest / left)
    # the first source whose own limit is above the level that the sources before it leave
    level = F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "level"))).over(every)["level"]
    return out.withColumn("target", F.least(F.col("limit"), F.coalesce(level * F.col("weight"), F.col("limit")))).select("source", "source_size", "weight", "target")


def _bits(*parts: Column) -> Column:
    return F.xxhash64(F.lit(SEED), *parts)


def permute(index: Column, n: Column, *key: Column) -> Column:
    """Place of ``index`` under a pseudorandom permutation of 0..n-1 that ``key`` picks.

    A swap-or-not shuffle: each round pairs x with ``k - x mod n`` and swaps the two
    on a hash bit of the pair, so it is a bijection for every n.
    """

    def turn(x: Column, r: Column) -> Column:
        k = F.pmod(_bits(r, *key), n)
        other = F.pmod(k - x, n)
        return F.when(F.pmod(_bits(r, F.greatest(x, other), *key), F.lit(2)) == 1, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), index.cast("long"), turn)


def _running(rows: DataFrame, keys: list[str], order: list[str], size: str, out: str) -> DataFrame:
    """Sum of ``size`` over the rows before this one, within ``keys``."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(out, F.coalesce(F.sum(size).over(w), F.lit(0)).cast("long"))


def _same(left: DataFrame, right: DataFrame, *on: str) -> Column:
    cond = left[on[0]].eqNullSafe(right[on[0]])
    for c in on[1:]:
        cond = cond & left[c].eqNullSafe(right[c])
    return cond


def place(docs: DataFrame) -> DataFrame:
    """``uid, doc_id, source, size`` with ``begin``, the place of the document's first word in its source's stream.

    ``docs`` has uid, doc_id, source, size and hash, a hash of the text.
    """
    # rows without a doc_id are told apart by their text and place in the table
    own = (F.col("doc_id"), F.when(F.col("doc_id").isNull(), F.col("hash")), F.when(F.col("doc_id").isNull(), F.col("uid")))
    rows = docs.withColumns({"b1": F.pmod(_bits(*own, F.lit(1)), F.lit(FAN)), "b2": F.pmod(_bits(*own, F.lit(2)), F.lit(FAN))})
    second = rows.groupBy("source", "b1", "b2").agg(F.sum("size").alias("s2"))
    first = second.groupBy("source", "b1").agg(F.sum("s2").alias("s1"))
    first = _running(first, ["source"], ["b1"], "s1", "o1").select("source", "b1", "o1")
    second = _running(second, ["source", "b1"], ["b2"], "s2", "o2").select("source", "b1", "b2", "o2")
    starts = second.join(first, _same(second, first, "source", "b1")).select(second["source"], second["b1"], second["b2"], (F.col("o1") + F.col("o2")).alias("o"))
    # by doc_id, so that another layout of the same table gives the same stream
    rows = _running(rows, ["source", "b1", "b2"], ["doc_id", "size", "hash", "uid"], "size", "o3")
    out = rows.join(starts, _same(rows, starts, "source", "b1", "b2"), "left")
    return out.select("uid", rows["doc_id"], rows["source"], "size", (F.col("o") + F.col("o3")).alias("begin"))


def _sized(source_targets: DataFrame, block_words: int) -> DataFrame:
    """``sid`` (a number by source), source, n_blocks, n_slots and ``low``, the slots of the sources before it; one row per source, windows over these rows."""
    s = source_targets.where("source_size > 0").withColumn("n_blocks", F.ceil(F.col("source_size") / block_words).cast("long"))
    s = s.withColumn("n_slots", F.round(F.col("target") * F.col("n_blocks") / F.col("source_size")).cast("long"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    s = s.withColumn("sid", F.row_number().over(by_name).cast("long"))
    return _running(s, [], ["sid"], "n_slots", "low").select("sid", "source", "n_blocks", "n_slots", "low")


def _by_interval(points: DataFrame, at: Column, owners: DataFrame, low: str, size: str, total: int, n_owners: int) -> DataFrame:
    """``points`` with ``sid`` and ``_low`` of the owner whose interval [low, low + size) holds ``at``; the intervals fill 0..total.

    Intervals are listed by buckets, of which there are so many that few intervals
    share one; the two meet by bucket.
    """
    width = max(1, -(-total // max(1 << 16, 4 * n_owners)))
    bucket = lambda c: F.floor(c / width).cast("long")
    listed = owners.where(F.col(size) > 0).select(F.col("sid"), F.col(low).alias("_low"), (F.col(low) + F.col(size)).alias("_high"))
    listed = listed.select("*", F.explode(F.sequence(bucket(F.col("_low")), bucket(F.col("_high") - 1))).alias("_bucket"))
    listed = F.broadcast(listed) if n_owners <= FEW_SOURCES else listed.hint("merge")
    met = points.withColumns({"_at": at, "_slot": bucket(at)}).join(listed, (F.col("_slot") == F.col("_bucket")) & (F.col("_at") >= F.col("_low")) & (F.col("_at") < F.col("_high")))
    return met.drop("_slot", "_bucket", "_high")


def draw(sources: DataFrame, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """``shard, place, sid``: the source that each slot of each shard draws. ``sources`` is what ``_sized`` gives."""
    spark = sources.sparkSession
    total, n = sources.agg(F.coalesce(F.sum("n_slots"), F.lit(0)), F.count(F.lit(1))).first()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total >> 20)
    slots = spark.range(0, total, 1, parts).select(F.floor(F.col("id") / shard_slots).cast("long").alias("shard"), (F.col("id") % shard_slots).alias("place"))
    drawn = F.pmod(_bits(F.col("shard"), F.col("place"), F.lit(4)), F.lit(max(total, 1)))
    return _by_interval(slots, drawn, sources, "low", "n_slots", total, n).select("shard", "place", "sid")


def plan_slots(source_targets: DataFrame, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """One row per slot: shard, place, source, j, block, epoch.

    A source of s words has n = ceil(s / block_words) blocks and round(target * n / s)
    slots, at most ``cap`` times n because the target is.
    """
    sources = durable(_sized(source_targets, block_words), 1)
    drawn = durable(draw(sources, shard_slots))
    counts = drawn.groupBy("sid", "shard").agg(F.count(F.lit(1)).alias("n")).withColumn("group", F.floor(F.col("shard") / FAN).cast("long"))
    first = _running(counts.groupBy("sid", "group").agg(F.sum("n").alias("n")), ["sid"], ["group"], "n", "o1").select("sid", "group", "o1")
    second = _running(counts, ["sid", "group"], ["shard"], "n", "o2").join(first, ["sid", "group"]).select("sid", "shard", (F.col("o1") + F.col("o2")).alias("o"))
    numbered = drawn.withColumn("k", F.row_number().over(Window.partitionBy("sid", "shard").orderBy("place")) - 1)
    numbered = numbered.join(second, ["sid", "shard"]).select("shard", "place", "sid", (F.col("o") + F.col("k")).alias("j"))
    # a row per source: what it drew beyond its slots, and what it lacks
    got = sources.join(counts.groupBy("sid").agg(F.sum("n").alias("drawn")), "sid", "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)))
    got = got.withColumns({"over": F.greatest(F.col("drawn") - F.col("n_slots"), F.lit(0)), "lack": F.greatest(F.col("n_slots") - F.col("drawn"), F.lit(0))})
    got = durable(_running(_running(got, [], ["sid"], "over", "over_low"), [], ["sid"], "lack", "lack_low"), 1)
    told = numbered.join(got.select("sid", "n_slots", "over_low"), "sid")
    own = told.where("j < n_slots").select("shard", "place", "sid", "j")
    moved = told.where("j >= n_slots").select("shard", "place", (F.col("over_low") + F.col("j") - F.col("n_slots")).alias("rank"))
    spare, n = got.agg(F.coalesce(F.sum("lack"), F.lit(0)), F.count(F.lit(1))).first()
    moved = _by_interval(moved, F.col("rank"), got, "lack_low", "lack", spare, n)
    moved = moved.join(got.select("sid", "drawn"), "sid").select("shard", "place", "sid", (F.col("drawn") + F.col("rank") - F.col("_low")).alias("j"))
    slots = own.unionByName(moved).join(sources.select("sid", "source", "n_blocks"), "sid")
    key = F.coalesce(F.col("source"), F.lit("\0null"))
    return slots.select(
        "shard", "place", "source", "j",
        permute(F.pmod(F.col("j"), F.col("n_blocks")), F.col("n_blocks"), key).alias("block"),
        F.floor(F.col("j") / F.col("n_blocks")).cast("long").alias("epoch"),
    )


def segments(placed: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document and block that it reaches into: block, ``first`` word within the document, ``length``."""
    full = placed.where("size > 0")
    begin, end = F.col("begin"), F.col("begin") + F.col("size")
    low = F.floor(begin / block_words).cast("long")
    high = F.floor((end - 1) / block_words).cast("long")
    out = full.select("uid", "doc_id", "source", "begin", "size", F.explode(F.sequence(low, high)).alias("block"))
    a = F.greatest(F.col("block") * block_words, begin)
    b = F.least((F.col("block") + 1) * block_words, end)
    return out.select("uid", "doc_id", "source", "block", (a - begin).alias("first"), (b - a).alias("length"))


def mix(docs: DataFrame, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents with size and target, slots, segments) of the mix of ``docs`` (doc_id, text, source).

    The mixture is ``slots`` joined with ``segments`` by (source, block): each slot of a
    shard, in order of place, holds the words of its block's segments. Null and empty texts have size 0
    and are never taken; a null source is a source; repeated rows (also of the same
    doc_id) count one by one; an empty table gives empty results.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), docs["doc_id"], docs["source"], n_words(docs["text"]).alias("size"), F.xxhash64(docs["text"]).alias("hash"))
    rows = durable(rows)
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = durable(targets(sums), 1)
    placed = place(rows)
    told = placed.join(goal, _same(placed, goal, "source"), "left").select("uid", "doc_id", placed["source"], "size", "source_size", "target")
    return told, plan_slots(goal, block_words, shard_slots), segments(placed, block_words)


def taken_words(slots: DataFrame, parts: DataFrame) -> DataFrame:
    """``uid, taken``: words that the mix takes of each document, repeats counted."""
    times = slots.groupBy("source", "block").agg(F.count(F.lit(1)).alias("times"))
    # its size follows the data though its plan looks small, so it isn't to be broadcast
    got = parts.join(times.hint("merge"), _same(parts, times, "source", "block"))
    return got.groupBy("uid").agg(F.sum(F.col("length") * F.col("times")).alias("taken"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    told, slots, parts = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    taken = taken_words(slots, parts)
    out = told.join(taken.hint("merge"), told["uid"] == taken["uid"], "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce(F.col("taken"), F.lit(0)).cast("long").alias("taken"), "source")


def mix_documents(docs: DataFrame) -> DataFrame:
    """The mix as documents: each epoch of a document that the mix takes is a row with the columns of ``docs``.

    A row's text is the document's taken words of that epoch, with the white space
    before each; a document taken whole keeps its text. ``n_chars``, where present,
    follows the text. A document whose words are never drawn gives no row.
    """
    # the documents' own columns stay in one, away from ours
    keyed = durable(docs.select(F.struct("*").alias("_row"), F.monotonically_increasing_id().alias("_uid")))
    text = F.col("_row.text")
    rows = durable(keyed.select(F.col("_uid").alias("uid"), F.col("_row.doc_id").alias("doc_id"), F.col("_row.source").alias("source"), n_words(text).alias("size"), F.xxhash64(text).alias("hash")))
    goal = durable(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"))), 1)
    slots, parts = plan_slots(goal), segments(place(rows))
    drawn = parts.join(slots.hint("merge"), _same(parts, slots, "source", "block")).select("uid", "epoch", "first", "length")
    spans = drawn.groupBy("uid", "epoch").agg(F.sort_array(F.collect_list(F.struct("first", "length"))).alias("_spans"), F.sum("length").alias("_taken"))
    spans = durable(spans)  # else one query would hold the plans of the draw, the places and the texts at once
    out = keyed.join(spans.hint("merge"), keyed["_uid"] == spans["uid"])
    words = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    cut = F.transform(F.array(words), lambda w: F.array_join(F.flatten(F.transform(F.col("_spans"), lambda s: F.slice(w, s["first"].cast("int") + 1, s["length"].cast("int")))), ""))[0]
    out = out.withColumn("_text", F.when(n_words(text) == F.col("_taken"), text).otherwise(cut))
    own = {"text": F.col("_text"), "n_chars": F.length("_text").cast("long")}
    return out.select(*[own[c].alias(c) if c in own else F.col("_row").getField(c).alias(c) for c in docs.columns])
