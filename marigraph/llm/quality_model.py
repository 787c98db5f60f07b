"""Quality classifier: histogram gradient-boosted trees over statistics of a document.

Statistics are worked out for whole batches of texts at once. Trees are complete to a
fixed depth and lie in flat arrays (feature, threshold, leaf value), so scoring walks
all texts down a tree together.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textarrays as ta
from .common import crc_mod, pick, sampled, table

#: Most labelled rows that the trees are fitted on; beyond, a pseudorandom sample by doc_id of about that size.
SAMPLE = 40_000
TREES, DEPTH, BINS, RATE, LEAST_WEIGHT, RIDGE = 80, 4, 64, 0.15, 2.0, 1.0

_UPPER, _LOWER, _DIGIT = ta.byte_class((65, 90)), ta.byte_class((97, 122)), ta.byte_class((48, 57))
_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>@{}[]=+~^_\\/"))
_STOP = np.isin(np.arange(256), list(b".,;:!?"))
_LINE = ~ta.byte_class((10, 10))

FEATURES = (
    "log_words", "word_bytes", "upper", "digit", "symbol", "stop_mark", "high_byte", "space", "distinct_words", "top_word", "repeated_triples",
    "repeated_words_next", "capital_words", "capital_first", "symbol_words", "mark_end_words", "short_words", "long_words", "log_lines", "words_a_line",
    "repeated_lines", "symbol_lines", "mark_end_lines", "one_word_lines",
)


def _repeats(doc: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: distinct values, the most frequent one's count, values that occur more than once (all of them)."""
    order = np.lexsort((value, doc))
    d, v = doc[order], value[order]
    if not len(d):
        return np.zeros(n), np.zeros(n), np.zeros(n)
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (v[1:] != v[:-1])
    start = np.flatnonzero(new)
    count = np.diff(np.append(start, len(d)))
    top = np.zeros(n)
    np.maximum.at(top, d[start], count)
    return np.bincount(d[start], minlength=n), top, np.bincount(d[start], np.where(count > 1, count, 0), minlength=n)


def statistics(column: pa.Array) -> np.ndarray:
    """One row of ``FEATURES`` for each text; null and empty texts have zeros."""
    data, offsets = ta.flat(column)
    n, size = len(column), np.maximum(np.diff(offsets), 1)
    share = lambda kind: ta.segment_sums(kind[data], offsets) / size
    s, e, per_text = ta.spans(data, offsets, ta.SPACED)
    own, words = ta.owners(per_text), np.maximum(np.diff(per_text), 1)
    h = ta.span_hashes(data, s, e)
    of = lambda flag: ta.segment_sums(flag, per_text) / words
    inside = lambda kind: (lambda run: run[e] - run[s])(np.append(0, np.cumsum(kind[data])))
    length, upper, symbol = e - s, inside(_UPPER), inside(_SYMBOL)
    distinct, top, _ = _repeats(own, h, n)
    td, tv = ta.shingles(h, per_text, 3)
    _, _, triples = _repeats(td, tv, n)
    same_next = np.zeros(len(h), bool)
    same_next[1:] = (h[1:] == h[:-1]) & (own[1:] == own[:-1])
    ls, le, per_line = ta.spans(data, offsets, _LINE)
    run = np.append(0, np.cumsum(ta.SPACED[data]))
    real = run[le] > run[ls]
    lown = ta.owners(per_line)[real]
    ls, le = ls[real], le[real]
    lines = np.maximum(np.bincount(lown, minlength=n), 1)
    per_line = np.searchsorted(lown, np.arange(n + 1))
    lof = lambda flag: ta.segment_sums(flag, per_line) / lines
    line_words = np.searchsorted(s, le) - np.searchsorted(s, ls)
    sym = np.append(0, np.cumsum(_SYMBOL[data]))
    _, _, twice = _repeats(lown, ta.span_hashes(data, ls, le), n)
    last = data[e - 1] if len(e) else np.zeros(0, np.uint8)
    out = [
        np.log1p(np.diff(per_text)), ta.segment_sums(length, per_text) / words, share(_UPPER), share(_DIGIT), share(_SYMBOL), share(_STOP),
        ta.segment_sums(data >= 128, offsets) / size, share(~ta.SPACED), distinct / words, top / words, triples / words,
        of(same_next), of((upper >= 2) & (2 * upper >= length)), of(_UPPER[data[s]] if len(s) else np.zeros(0, bool)), of(symbol > 0), of(_STOP[last]),
        of(length <= 2), of(length > 20), np.log1p(np.diff(per_line)), ta.segment_sums(line_words, per_line) / lines,
        twice / lines, lof(sym[le] > sym[ls]), lof(_STOP[data[le - 1]] if len(le) else np.zeros(0, bool)), lof(line_words == 1),
    ]
    return np.stack([np.asarray(x, np.float32) for x in out], axis=1)


@dataclass
class Trees:
    """``feature`` and ``threshold`` (trees, 2^depth - 1) by level, ``leaf`` (trees, 2^depth), ``start`` the score before any tree."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    start: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        rows, inner = np.arange(len(x)), self.feature.shape[1]
        out = np.full(len(x), self.start)
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            out += leaf[node - inner]
        return out

    def score(self, column: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(statistics(column)), -30, 30)))


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES) -> Trees:
    """Boosts ``trees`` trees on the logistic loss; splits are sought over ``BINS`` quantile bins of each feature."""
    n, m = x.shape
    inner = (1 << DEPTH) - 1
    mean = (y.sum() + 1) / (n + 2) if n else 0.5
    made = Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner), np.float32), np.zeros((0, inner + 1)), float(np.log(mean / (1 - mean))))
    if not n or y.min() == y.max():
        return made
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1]).astype(np.float32)) for j in range(m)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j]) for j in range(m)], axis=1)
    at = binned + BINS * np.arange(m)
    margin = np.full(n, made.start)
    feature, threshold, leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(n, np.int64)
        f, t = np.zeros(inner, np.int64), np.full(inner, np.inf, np.float32)
        for level in range(DEPTH):
            first, width = (1 << level) - 1, 1 << level
            slot = ((node - first)[:, None] * (m * BINS) + at).ravel()
            hist = [np.bincount(slot, np.repeat(v, m), width * m * BINS).reshape(width, m, BINS).cumsum(axis=2) for v in (grad, hess)]
            g, h = hist
            all_g, all_h = g[:, :, -1:], h[:, :, -1:]
            gain = g**2 / (h + RIDGE) + (all_g - g) ** 2 / (all_h - h + RIDGE) - all_g**2 / (all_h + RIDGE)
            gain[(h < LEAST_WEIGHT) | (all_h - h < LEAST_WEIGHT)] = -1
            best = gain.reshape(width, -1).argmax(axis=1)
            for k in range(width):
                j, b = divmod(int(best[k]), BINS)
                if gain[k, j, b] > 1e-6 and b < len(edges[j]):
                    f[first + k], t[first + k] = j, edges[j][b]
            node = 2 * node + 1 + (x[np.arange(n), f[node]] > t[node])
        g, h = np.bincount(node - inner, grad, inner + 1), np.bincount(node - inner, hess, inner + 1)
        leaf = -RATE * g / (h + RIDGE)
        margin += leaf[node - inner]
        feature.append(f)
        threshold.append(t)
        leaves.append(leaf)
    return Trees(np.stack(feature), np.stack(threshold), np.stack(leaves), made.start)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    """Trees from labelled documents with crc32(doc_id) mod 3 other than 1; null texts and labels teach nothing."""
    marks = sampled(pick(labels, doc_id="doc_id", mark="quality"), sample).withColumnRenamed("mark", "quality")
    rows = pick(docs, doc_id="doc_id", text="text").where("text is not null").join(F.broadcast(marks), "doc_id").select("quality", "text")
    flat = lambda x: ta.list_array(x.ravel(), np.arange(len(x) + 1) * len(FEATURES), pa.float32())
    got = rows.select("quality", ta.text_function(lambda: statistics, flat, "array<float>")(F.col("text")).alias("x")).toArrow()
    x = got.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES)) if got.num_rows else np.zeros((0, len(FEATURES)), np.float32)
    y = got.column("quality").to_numpy().astype(float) if got.num_rows else np.zeros(0)
    order = np.lexsort((*x.T, y))  # the rows' order on arrival varies
    return grow(x[order], y[order])


def score(trees: Trees, spark: SparkSession, text: Column) -> Column:
    """The probability of quality 1 of each text. Null and empty texts are scored as texts without words; rows one by one."""
    sent = spark.sparkContext.broadcast(trees)
    return ta.text_function(lambda: sent.value.score, pa.array, "double")(text)


def op6_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null doc_id is neither learned from nor held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    trees = train(docs, table(spark, sf_dir, "labels"))
    held_out = F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False))
    rows = docs.select("doc_id", held_out.alias("held_out"), score(trees, spark, F.col("text")).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_poor(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, with all their columns, whatever their names."""
    return docs.where(score(train(docs, labels), docs.sparkSession, docs["text"]) >= threshold)
