"""Models over four-byte strings: counting by class, and sums of a string's costs over whole texts.

A byte and its three predecessors make one code. A model gives every code a cost under
each of its columns; with frozen statistics the cost depends on the code alone, so a text's
sum is a sum of looked-up costs. Text is taken as bytes after three line feeds, whole.

Counts cover all rows and nothing is thinned. Up to ``BROADCAST_GRAMS`` counted strings
a model is sent to the executors. Beyond, costs are worked out where the strings are: per
group of strings with the same two middle bytes (at most 65,536 strings a class, whatever
the corpus), from the group's own counts and statistics of at most 65,536 pairs; they
meet the distinct strings of chunks of text in a join. Both ways give the same sums.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textarrays as ta
from .common import durable, pick

ORDER = 3
#: Most counted strings (over all classes) that a model may have to be sent to every executor.
BROADCAST_GRAMS = 1 << 20
_PAD = 0x0A

Counts = dict[str, tuple[np.ndarray, np.ndarray]]


def grams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The code of every byte with its three predecessors, as one uint32 a byte."""
    n = len(offsets) - 1
    out = np.full(len(data) + ORDER * n, _PAD, np.uint8)
    at = np.arange(len(data)) + ORDER * (np.repeat(np.arange(n), np.diff(offsets)) + 1)
    out[at] = data
    code = out.astype(np.uint32)
    total = code.copy()
    for k in range(1, ORDER + 1):
        total[k:] |= code[:-k] << np.uint32(8 * k)
    return total[at]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of four-byte strings by class of a partition; what is held is passed on at a million strings."""
    held: Counts = {}

    def out() -> Iterator[pa.RecordBatch]:
        for name, (code, n) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(code)), pa.array(code.astype(np.int64)), pa.array(n.astype(np.int64))], ["class", "gram", "n"])
        held.clear()

    for batch in batches:
        for part in ta.chunks(batch, "text"):
            data, offsets = ta.flat(part.column("text"))
            code = grams(data, offsets)
            kind = part.column("class").dictionary_encode()
            names, which = kind.dictionary.to_pylist(), np.repeat(np.asarray(kind.indices), np.diff(offsets))
            for k, name in enumerate(names):
                got, n = np.unique(code[which == k], return_counts=True)
                if name in held:
                    old, m = held[name]
                    got, inv = np.unique(np.concatenate([old, got]), return_inverse=True)
                    n = np.bincount(inv, np.concatenate([m, n]), len(got)).astype(np.int64)
                held[name] = (got, n)
            if sum(len(c) for c, _ in held.values()) > 1 << 20:
                yield from out()
    yield from out()


def count(rows: DataFrame, text: str, kind: str, lower: bool = False) -> DataFrame:
    """``class, gram, n``: how often each string occurs in the texts of a class, over all rows whose class isn't null; ``lower`` folds A-Z to a-z."""
    own = pick(rows, text=text, **{"class": kind}).where(F.col("class").isNotNull() & (F.length("text") > 0))
    own = own.select(F.col("class").cast("string").alias("class"), _folded(F.col("text"), lower).alias("text"))
    return durable(own.mapInArrow(ta.tidy(_count), "class string, gram long, n long").groupBy("class", "gram").agg(F.sum("n").alias("n")))


def _folded(text: Column, lower: bool) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz") if lower else text


def collected(counts: DataFrame) -> Counts:
    """The counts on the driver, sorted by code; only for what ``fits``."""
    got = counts.toArrow()
    name, code, n = got.column("class").to_pandas(), got.column("gram").to_numpy().astype(np.uint32), got.column("n").to_numpy().astype(float)
    return _by_class(name.to_numpy(), code, n)


def _by_class(name: np.ndarray, code: np.ndarray, n: np.ndarray) -> Counts:
    out = {}
    for x in sorted(set(name.tolist())):
        mine = np.flatnonzero(name == x)
        mine = mine[np.argsort(code[mine])]
        out[x] = (code[mine], n[mine])
    return out


class Model:
    """Costs of codes under ``columns``, from the counts of some strings and statistics that cover all of them."""

    columns: list[str]

    def costs(self, code: np.ndarray) -> np.ndarray:
        """(columns, codes)."""
        raise NotImplementedError


class Fitted:
    """A model as a recipe: ``build(counts, upper)`` makes it from the counts of all strings (``upper`` None), or of those
    with two given middle bytes and ``upper``, the statistics of shorter strings that ``upper_of(counts)`` takes from all.

    ``counts`` is the table of all counts, ``columns`` names what a text's sums stand for.
    """

    def __init__(self, counts: DataFrame, columns: list[str], build: Callable, upper_of: Callable, most: int = BROADCAST_GRAMS, lower: bool = False):
        self.counts, self.columns, self.lower = counts, columns, lower
        self.sent = counts.count() <= most
        upper = None if self.sent or not columns else upper_of(counts)
        self.build = lambda own: build(own, upper)
        self._ready: Model | None = None

    def model(self) -> Model:
        if self._ready is None:
            self._ready = self.build(collected(self.counts))
        return self._ready

    def sums(self, docs: DataFrame, text: Column, name: str = "_sums") -> DataFrame:
        """``docs`` with ``name``, the sums of each text's costs by column as an array of doubles; null and empty texts sum to 0."""
        text = _folded(text, self.lower)
        if not self.columns:
            return docs.withColumn(name, F.array().cast("array<double>"))
        return docs.withColumn(name, self._looked_up(docs, text)) if self.sent else self._joined(docs, text, name)

    def _looked_up(self, docs: DataFrame, text: Column) -> Column:
        sent, width = docs.sparkSession.sparkContext.broadcast(self.model()), len(self.columns)

        def of():
            memory = Memory(sent.value)
            return lambda column: memory.sums(*ta.flat(column))

        flat = lambda x: ta.list_array(x.ravel(), np.arange(len(x) + 1) * width, pa.float64())
        return ta.text_function(of, flat, "array<double>")(text)

    def _joined(self, docs: DataFrame, text: Column, name: str) -> DataFrame:
        rows = docs.select(F.struct("*").alias("_row"), text.alias("_text"))

        def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            task, k = TaskContext.get().partitionId() << 32, 0
            for batch in batches:
                for part in ta.chunks(batch, "_text"):
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(part.num_rows, task + k))], ["_row", "_text", "_chunk"])
                    k += 1

        # written once, so that a chunk's number stays its own
        rows = durable(rows.mapInArrow(ta.tidy(number), T.StructType([*rows.schema.fields]).add("_chunk", "long")))
        kind = rows.schema["_row"].dataType

        def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in ta.chunks(batch, "_text"):
                    chunk = np.asarray(part.column("_chunk"))
                    for c in np.unique(chunk):
                        code = np.unique(grams(*ta.flat(part.column("_text").filter(pa.array(chunk == c)))))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(code), c)), pa.array(code.astype(np.int64))], ["_chunk", "gram"])

        met = durable(rows.select("_text", "_chunk").mapInArrow(ta.tidy(distinct), "_chunk long, gram long").distinct())
        costs = self.cost_table(met.select("gram").distinct())
        told = met.join(costs, "gram").select("_chunk", "gram", "costs")
        width = len(self.columns)

        def add(chunk: pa.Table, known: pa.Table) -> pa.Table:
            known = known.combine_chunks()
            code = known.column("gram").to_numpy().astype(np.uint32)
            order = np.argsort(code)
            cost = known.column("costs").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)[order]
            code, column = code[order], chunk.column("_text").combine_chunks()
            data, offsets = ta.flat(column)
            at = np.searchsorted(code, grams(data, offsets))
            sums = np.stack([ta.segment_sums(cost[at, k], offsets) if len(code) else np.zeros(len(column)) for k in range(width)], axis=1)
            lists = ta.list_array(sums.ravel(), np.arange(len(column) + 1) * width, pa.float64())
            return pa.table({"_row": chunk.column("_row"), name: lists})

        add.__annotations__ = {"chunk": pa.Table, "known": pa.Table, "return": pa.Table}
        out = rows.groupBy("_chunk").cogroup(told.groupBy("_chunk")).applyInArrow(add, T.StructType().add("_row", kind).add(name, T.ArrayType(T.DoubleType())))
        return out.select("_row.*", name)

    def cost_table(self, wanted: DataFrame) -> DataFrame:
        """``gram, costs`` of the strings ``wanted`` (gram), worked out in groups by their two middle bytes."""
        middle = F.shiftright("gram", 8).bitwiseAND(F.lit(0xFFFF)).alias("middle")
        build = self.build

        def work(mine: pa.Table, asked: pa.Table) -> pa.Table:
            own = _by_class(mine.column("class").to_numpy(), mine.column("gram").to_numpy().astype(np.uint32), mine.column("n").to_numpy().astype(float))
            code = asked.column("gram").to_numpy()
            cost = build(own).costs(code.astype(np.uint32)).T if len(code) else np.zeros((0, 1))
            return pa.table({"gram": pa.array(code), "costs": ta.list_array(cost.ravel(), np.arange(len(code) + 1) * cost.shape[1], pa.float64())})

        work.__annotations__ = {"mine": pa.Table, "asked": pa.Table, "return": pa.Table}
        counts = self.counts.select("class", "gram", "n", middle)
        return counts.groupBy("middle").cogroup(wanted.select("gram", middle).groupBy("middle")).applyInArrow(work, "gram long, costs array<double>")


class Memory:
    """Sums of costs with the strings met so far in a table of slots."""

    SLOT_BITS, MOST = 20, 1 << 21

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(1 << self.SLOT_BITS, np.uint32)
        self.place = np.full(1 << self.SLOT_BITS, -1, np.int32)
        self.known = np.zeros((len(self.model.columns), 1 << 16))
        self.used = 0

    def ids(self, code: np.ndarray) -> np.ndarray:
        slot = (code * np.uint32(2654435761)) >> np.uint32(32 - self.SLOT_BITS)
        out = np.where(self.keys[slot] == code, self.place[slot], -1)
        miss = np.flatnonzero(out < 0)
        if len(miss):
            new, inv = np.unique(code[miss], return_inverse=True)
            need = self.used + len(new)
            if need > self.known.shape[1]:
                grown = np.zeros((len(self.known), max(need, 2 * self.known.shape[1])))
                grown[:, : self.used] = self.known[:, : self.used]
                self.known = grown
            self.known[:, self.used : need] = self.model.costs(new)
            number = np.arange(self.used, need, dtype=np.int32)
            out[miss] = number[inv]
            to = (new * np.uint32(2654435761)) >> np.uint32(32 - self.SLOT_BITS)
            self.keys[to], self.place[to] = new, number
            self.used = need
        return out

    def sums(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """(texts, columns)."""
        if self.used > self.MOST:
            self.clear()
        ids = self.ids(grams(data, offsets))
        return np.stack([ta.segment_sums(known[ids], offsets) for known in self.known], axis=1)
