"""Toxicity from class-conditional Kneser-Ney models.

A toxic and an ordinary interpolated Kneser-Ney model predict every byte of a text from
the three before it, so they know expressions by their spelling, in any inflection. The
two upper orders (three and two bytes of context) are a class's own: its counts, and its
continuation counts, less an absolute discount. What the discounts take goes on to the
lower orders, whose continuation counts both classes share: an expression too rare in a
class is smoothed by what the whole training text has. Discounts are n1 / (n1 + 2 n2) of
each order's counts of counts. For every context, a model's 256 probabilities sum to 1.

A text's evidence is the difference of its two log-likelihoods, divided by its bytes. A
logistic curve, placed by rows kept out of the counts, turns it into a score from 0 to 1.
Counts cover the whole texts of all training rows, up to ``SAMPLE`` of them.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytegrams as bg
from .common import crc_mod, pick, sampled, table

#: Columns of the models' sums: the negative log-likelihoods of a text under the classes.
CLASSES = ["0", "1"]
#: Evidence is binned by this width, within plus or minus this many nats a byte, to fit the curve.
BIN, REACH = 2.0**-13, 1.0
THRESHOLD = 0.7
#: Training rows whose crc32(doc_id) mod 12 is one of these fit the curve; the rest are counted.
CURVE = (0, 2)
#: Most labelled documents that teach the models; beyond, a pseudorandom sample by doc_id of about that size. Bounds the broadcast of labels.
SAMPLE = 200_000


def discount(once: float, twice: float) -> float:
    """The absolute discount from how many counts are 1 and 2; 3/4 where there are none of either."""
    return once / (once + 2 * twice) if once and twice else 0.75


class Level:
    """One order of a model: counts of strings, of which the last byte is the symbol."""

    def __init__(self, key: np.ndarray, count: np.ndarray, cut: float | None = None):
        self.key, self.count = key, count
        self.context, start = np.unique(key >> np.uint32(8), return_index=True)
        end = np.append(start[1:], len(key))[: len(start)]
        run = np.append(0.0, np.cumsum(count))
        self.total, self.kinds = run[end] - run[start], (end - start).astype(float)
        self.cut = discount((count == 1).sum(), (count == 2).sum()) if cut is None else cut

    def over(self, want: np.ndarray, below: np.ndarray) -> np.ndarray:
        """Probabilities of the strings' last bytes; ``below`` are those of the next lower order."""
        if not len(self.key):
            return below
        at = np.minimum(np.searchsorted(self.context, want >> np.uint32(8)), len(self.context) - 1)
        seen = self.context[at] == want >> np.uint32(8)
        sym = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
        own = np.where(self.key[sym] == want, np.maximum(self.count[sym] - self.cut, 0), 0.0)
        return np.where(seen, (own + self.cut * self.kinds[at] * below) / self.total[at], below)


def _continuations(key: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct strings of ``size`` bytes and the number of different bytes before each, from longer strings."""
    longer = np.unique(key & np.uint32((1 << (8 * (size + 1))) - 1)) if size < 3 else key
    got, n = np.unique(longer & np.uint32((1 << (8 * size)) - 1), return_counts=True)
    return got, n.astype(float)


class KneserNey(bg.Model):
    """Both classes' models. ``upper`` holds what can't be told from strings with the same middle bytes: ``cuts``, the
    discounts of the two upper orders by class, and ``pairs``, the shared continuation counts of two-byte strings."""

    columns = CLASSES

    def __init__(self, counts: bg.Counts, upper: dict | None = None):
        none = (np.zeros(0, np.uint32), np.zeros(0))
        own = [counts.get(c, none) for c in CLASSES]
        pairs = upper["pairs"] if upper else _continuations(np.concatenate([c for c, _ in own]), 2)
        self.shared = [Level(*_continuations(pairs[0], 1)), Level(*pairs)]
        cut = lambda c, k: upper["cuts"].get((c, k)) if upper else None
        self.own = [[Level(*_continuations(code, 3), cut(c, 3)), Level(code, n, cut(c, 4))] for c, (code, n) in zip(CLASSES, own, strict=True)]
        known = upper["classes"] if upper else {c for c in CLASSES if c in counts}
        self.empty = len(known) < 2

    def probabilities(self, code: np.ndarray) -> np.ndarray:
        """(classes, codes): of the last byte of each string after the other three."""
        below = np.full(len(code), 1 / 256)
        for size, level in enumerate(self.shared, 1):
            below = level.over(code & np.uint32((1 << (8 * size)) - 1), below)
        return np.stack([upper.over(code, lower.over(code & np.uint32(0xFFFFFF), below)) for lower, upper in self.own])

    def costs(self, code: np.ndarray) -> np.ndarray:
        return np.zeros((2, len(code))) if self.empty else -np.log(self.probabilities(code))


def _upper(counts: DataFrame) -> dict:
    """Statistics over all strings: some numbers a class, and at most 65,536 pairs of bytes."""
    threes = counts.groupBy("class", F.col("gram").bitwiseAND(F.lit(0xFFFFFF)).alias("gram")).agg(F.count(F.lit(1)).alias("n"))
    cuts, classes = {}, set()
    for size, own in ((3, threes), (4, counts)):
        for r in own.groupBy("class").agg(F.count_if(F.col("n") == 1).alias("once"), F.count_if(F.col("n") == 2).alias("twice")).collect():
            cuts[r["class"], size] = discount(r["once"], r["twice"])
            classes.add(r["class"])
    pairs = threes.select("gram").distinct().groupBy(F.col("gram").bitwiseAND(F.lit(0xFFFF)).alias("gram")).agg(F.count(F.lit(1)).alias("n")).toPandas().sort_values("gram")
    return {"cuts": cuts, "classes": classes, "pairs": (pairs["gram"].to_numpy().astype(np.uint32), pairs["n"].to_numpy(float))}


def fit_curve(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve over binned evidence x with labels y, n rows each; (1, 0) without both classes.

    The curve passes ``THRESHOLD`` where the F-measure of the rows above is best, with
    precision weighing twice as much as recall: some labels are wrong, and a likelihood fit
    would follow those. Of equally good places it is the middle. Its slope is 2 over the
    distance of the ordinary rows' median from their 95th percentile.
    """
    if not (n[y == 1].sum() and n[y == 0].sum()):
        return 1.0, 0.0
    place, at = np.unique(x, return_inverse=True)
    toxic, all_ = (np.bincount(at, n * kind, len(place))[::-1].cumsum()[::-1] for kind in (y == 1, np.ones(len(y))))
    measure = 1.25 * toxic / (all_ + 0.25 * toxic[0])
    best = np.flatnonzero(measure >= measure.max() - 1e-12)[-1]
    cut = (place[best] + place[best - 1]) / 2 if best else place[0] - BIN / 2
    own, share = x[y == 0], n[y == 0]
    order = np.argsort(own)
    sums = np.cumsum(share[order])
    middle, high = own[order][np.searchsorted(sums, np.array([0.5, 0.95]) * sums[-1])]
    slope = 2 / max(BIN, float(high - middle))
    return slope, float(np.log(THRESHOLD / (1 - THRESHOLD)) - slope * cut)


class Toxicity:
    """The two models and the curve over their evidence."""

    def __init__(self, models: bg.Fitted, slope: float = 1.0, shift: float = 0.0):
        self.models, self.slope, self.shift = models, slope, shift

    def evidence(self, docs: DataFrame, text: Column, name: str) -> DataFrame:
        """``docs`` with ``name``: (log p(text | toxic) - log p(text | ordinary)) / bytes; 0 for a null or empty text."""
        size = f"{name}_bytes"
        told = self.models.sums(docs.withColumn(size, F.greatest(F.coalesce(F.octet_length(text), F.lit(0)), F.lit(1))), text, name)
        return told.withColumn(name, (F.col(name)[0] - F.col(name)[1]) / F.col(size)).drop(size)

    def score(self, docs: DataFrame, text: Column, name: str = "score") -> DataFrame:
        """``docs`` with ``name``, from 0 to 1, the higher the likelier a text is toxic. Rows are scored one by one, repeated or not; an empty table gives an empty table."""
        told = self.evidence(docs, text, name)
        bound = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.lit(self.slope) * F.col(name) + F.lit(self.shift)))
        return told.withColumn(name, 1 / (1 + F.exp(-bound)))


def fit(rows: DataFrame, most: int = bg.BROADCAST_GRAMS) -> Toxicity:
    """Models from rows (text, toxic 0 or 1), without a curve yet.

    Rows with a null text or label teach nothing. Without rows of both classes every
    text has evidence 0 and scores one half.
    """
    rows = rows.where("text is not null and toxic in (0, 1)").select("text", F.col("toxic").cast("int").cast("string").alias("toxic"))
    counts = bg.count(rows, "text", "toxic", lower=True)
    return Toxicity(bg.Fitted(counts, CLASSES, KneserNey, _upper, most, lower=True))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most: int = bg.BROADCAST_GRAMS) -> Toxicity:
    """Models and their curve from labelled documents with crc32(doc_id) mod 3 other than 1."""
    marks = sampled(pick(labels, doc_id="doc_id", mark="toxic"), sample).withColumnRenamed("mark", "toxic")
    rows = pick(docs, doc_id="doc_id", text="text").where("text is not null").join(F.broadcast(marks), "doc_id")
    rows = rows.withColumn("curve", crc_mod("doc_id", 12).isin(*CURVE)).select("text", "toxic", "curve")
    model = fit(rows.where("not curve"), most)
    kept_out = model.evidence(rows.where("curve").select("text", "toxic"), F.col("text"), "evidence")
    place = F.floor(F.greatest(F.lit(-REACH), F.least(F.lit(REACH), F.col("evidence"))) / BIN)
    bins = kept_out.groupBy(place.alias("place"), "toxic").count().toPandas()
    if len(bins):
        model.slope, model.shift = fit_curve((bins["place"].to_numpy() + 0.5) * BIN, bins["toxic"].to_numpy(), bins["count"].to_numpy(float))
    return model


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null doc_id is neither learned from nor held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    rows = docs.select("doc_id", F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "text")
    return model.score(rows, F.col("text")).drop("text").withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns, whatever their names."""
    whole = docs.select(F.struct("*").alias("_row"))  # away from our columns' names
    return train(docs, labels).score(whole, F.col("_row.text"), "_score").where(F.col("_score") < threshold).select("_row.*")
