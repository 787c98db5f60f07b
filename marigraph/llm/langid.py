"""Language identification by prediction with partial matching.

Per language, counts of all four-byte strings give the context trees of orders 3 to
0. A byte's code length comes from the longest context seen: escape method C with
exclusion of the symbols already ruled out, down to a uniform order -1. Statistics
are frozen before scoring, so the code length of a byte depends on its four-byte
string alone; each distinct string is worked out once and then looked up.

Text is taken as bytes after three line feeds, whole, without normalisation. All rows
with a language teach, and no string is left out, however many there are: ``bytegrams``
tells how a tree that is too large to be sent out is spread over the executors.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytegrams as bg
from .common import crc_mod, table

ORDER = bg.ORDER


class Tree:
    """The context tree of one language as sorted arrays, one level for each order.

    ``pairs``, where given, are the codes and counts of two-byte strings for the orders 1 and
    0; else these come from the four-byte strings too.
    """

    def __init__(self, code: np.ndarray, count: np.ndarray, pairs: tuple[np.ndarray, np.ndarray] | None = None):
        self.levels = []
        for order in range(ORDER, -1, -1):
            own, n = (code, count) if order > 1 or pairs is None else pairs
            mask = np.uint32((1 << (8 * (order + 1))) - 1)
            key, inv = np.unique(own & mask, return_inverse=True)
            c = np.bincount(inv, n, len(key))
            ctx, start = np.unique(key >> np.uint32(8), return_index=True)
            end = np.append(start[1:], len(key))
            run = np.append(0.0, np.cumsum(c))
            self.levels.append([key, c, ctx, run[end[: len(ctx)]] - run[start], (end[: len(ctx)] - start).astype(float), None])
        # what the parent context loses when this context's symbols are excluded from it
        for depth, (upper, lower) in enumerate(zip(self.levels, self.levels[1:], strict=False)):
            parent_mask = np.uint32((1 << (8 * (ORDER - depth))) - 1)
            at = np.searchsorted(lower[0], upper[0] & parent_mask)
            inside = np.searchsorted(upper[2], upper[0] >> np.uint32(8))
            upper[5] = np.bincount(inside, lower[1][at], len(upper[2]))

    def bits(self, code: np.ndarray) -> np.ndarray:
        """Code length of the last byte of each four-byte string."""
        n = len(code)
        out, todo = np.zeros(n), np.ones(n, bool)
        lost_n, lost_q = np.zeros(n), np.zeros(n)
        for depth, (key, c, ctx, total, kinds, lost) in enumerate(self.levels):
            if not len(key):  # no string has these bytes
                continue
            mask = np.uint32((1 << (8 * (ORDER - depth + 1))) - 1)
            want = code & mask
            at = np.minimum(np.searchsorted(ctx, want >> np.uint32(8)), len(ctx) - 1)
            seen = todo & (ctx[at] == want >> np.uint32(8))
            sym = np.minimum(np.searchsorted(key, want), len(key) - 1)
            hit = seen & (key[sym] == want)
            left_q = kinds[at] - lost_q
            whole = total[at] - lost_n + left_q
            with np.errstate(divide="ignore", invalid="ignore"):
                out += np.where(hit, np.log2(whole / c[sym]), 0.0)
                miss = seen & ~hit & (left_q > 0)
                out += np.where(miss, np.log2(whole / left_q), 0.0)
            todo &= ~hit
            if lost is not None:
                lost_n, lost_q = np.where(seen, lost[at], 0.0), np.where(seen, kinds[at], 0.0)
        return out + np.where(todo, np.log2(max(1.0, 256 - self.levels[-1][4].sum())), 0.0)


class Trees(bg.Model):
    """The trees of all languages; ``upper`` has the pairs of each."""

    def __init__(self, counts: bg.Counts, columns: list[str], upper: bg.Counts | None = None):
        self.columns = columns
        none = (np.zeros(0, np.uint32), np.zeros(0))
        self.trees = [Tree(*counts.get(x, none), upper[x] if upper else None) for x in columns]

    def costs(self, code: np.ndarray) -> np.ndarray:
        return np.stack([t.bits(code) for t in self.trees])


def _pairs(counts: DataFrame) -> bg.Counts:
    """Two-byte strings of each language with their counts: at most 65,536 a language."""
    return bg.collected(counts.groupBy("class", F.col("gram").bitwiseAND(F.lit(0xFFFF)).alias("gram")).agg(F.sum("n").alias("n")))


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", most: int = bg.BROADCAST_GRAMS) -> bg.Fitted:
    """The trees of all languages, from all rows with a language and a text.

    Rows with a null language or a null or empty text teach nothing. Up to ``most``
    strings are sent out as trees; beyond, they stay in a table. Predictions are the same.
    """
    counts = bg.count(docs, text, lang)
    columns = sorted(r[0] for r in counts.select("class").distinct().collect())  # a row a language
    return bg.Fitted(counts, columns, lambda own, upper: Trees(own, columns, upper), _pairs, most)


def _letters(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def predict(docs: DataFrame, model: bg.Fitted, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keys`` with ``lang_pred``, ``score`` (its share of the languages' probabilities) and ``bits_per_byte``.

    A null text, or one without a letter, is ``und`` with score 0; so is every text
    when nothing was learned. Ties go to the first language by name. Rows are
    judged one by one, repeated or not; an empty table gives an empty table.
    """
    rows = docs.select(F.struct(*keys).alias("_keys"), docs[text].alias("_text"))
    known = _letters(F.col("_text")) if model.columns else F.lit(False)
    told = model.sums(rows.select("_keys", "_text"), F.col("_text"))
    told = told.select("_keys", known.alias("_known"), F.octet_length("_text").alias("_size"), "_sums")
    sums, least = F.col("_sums"), F.array_min("_sums")
    best = F.get(F.array(*[F.lit(x) for x in model.columns]).cast("array<string>"), (F.array_position(sums, least) - 1).cast("int"))
    share = 1 / F.aggregate(sums, F.lit(0.0), lambda a, x: a + F.pow(F.lit(2.0), -F.least(x - least, F.lit(1000.0))))
    return told.select(
        "_keys.*", F.when(F.col("_known"), best).otherwise("und").alias("lang_pred"), F.when(F.col("_known"), share).otherwise(0.0).alias("score"),
        F.when(F.col("_known"), least / F.greatest("_size", F.lit(1))).otherwise(0.0).alias("bits_per_byte"),
    )


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from documents with crc32(doc_id) mod 4 other than 2 and a language; a null doc_id is neither learned from nor held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False))
    model = fit(docs.where(crc_mod("doc_id", 4) != 2))
    rows = docs.select("doc_id", held_out.alias("held_out"), "text")
    return predict(rows, model, keys=("doc_id", "held_out"))
