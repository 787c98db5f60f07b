"""Arrow text columns as flat byte arrays, and words, word hashes and shingle hashes of whole batches at once.

Every function works on the bytes of many documents laid end to end: no Python
loop over documents or words. A batch is cut into chunks of about a megabyte,
so memory does not follow the batch; a longer document is a chunk by itself.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 20
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64, a bijection."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _GOLD)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P^i and P^-i for i < n, kept for chunks of the usual size."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, CHUNK_BYTES + 4096)
        made = []
        for base in (_P, _P_INV):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        if n > CHUNK_BYTES + 4096:
            return made[0][:n], made[1][:n]
        _POWERS[:] = made
    return _POWERS[0][:n], _POWERS[1][:n]


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts end to end, and n + 1 offsets; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def chunks(batch: pa.RecordBatch, text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes of text each, one row at least."""
    if not batch.num_rows:
        return
    lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0).cast(pa.int64()))
    ends = np.cumsum(lengths)
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def pieces(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[pa.Array]:
    """Slices of a column of texts, as ``chunks`` cuts a batch."""
    for part in chunks(pa.RecordBatch.from_arrays([column], ["t"]), "t", limit):
        yield part.column("t")


def release() -> None:
    """Gives back the memory that a task has freed: a worker stays for later tasks, and several of them share an executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run):
    """``run``, a function of Arrow batches, that gives back its memory at its task's end."""

    @wraps(run)
    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return inner


def text_function(of, to_arrow, kind: str):
    """A function of a column of texts that runs on Arrow batches: only the texts go to Python and only the results come back.

    ``of()`` makes, once a task, the function from a column of about a megabyte of text to
    its result, which ``to_arrow`` turns into an array of the Spark type ``kind``.
    """

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        work = of()
        try:
            for column in texts:
                # results go back a chunk at a time, so that neither side holds those of a whole batch
                for part in pieces(column) if len(column) else (column,):
                    yield to_arrow(work(part))
        finally:
            del work
            release()

    run.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, kind)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, other bytes as they are."""
    return data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of 256 booleans, true within the ranges."""
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


#: The bytes of words ``[^\x20\x09-\x0D]+``, and of words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``.
SPACED = ~byte_class((0x20, 0x20), (0x09, 0x0D))
ALNUM = ~byte_class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))


def spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and n + 1 offsets of each text's words. Words end where their text ends."""
    w = is_word[data]
    start, end = w.copy(), w.copy()
    start[1:] &= ~w[:-1]
    end[:-1] &= ~w[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    start[cut] = w[cut]
    end[cut - 1] = w[cut - 1]
    s, t = np.flatnonzero(start), np.flatnonzero(end) + 1
    return s, t, np.searchsorted(s, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes: differences of one running polynomial sum, mixed."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    p, inv = _powers(len(data))
    run = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * p, out=run[1:])
    return mix((run[ends] - run[starts]) * inv[starts] + (ends - starts).astype(np.uint64) * _GOLD)


def owners(word_offsets: np.ndarray) -> np.ndarray:
    """The text's index of each word."""
    return np.repeat(np.arange(len(word_offsets) - 1), np.diff(word_offsets))


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each place on (len - k + 1 of them; borders of texts aren't heeded)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    whole = (1 << 64) - 1
    total = np.full(n, k * int(_M2) & whole, np.uint64)
    for m in range(k):
        total += words[m : m + n] * np.uint64((2 * m + 3) * int(_M1) & whole | 1)
        total = mix(total)
    return total


def shingles(words: np.ndarray, word_offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(text's index, hash) of every k-word shingle; a text of 1 to k - 1 words is one shingle of all its words."""
    count = np.diff(word_offsets)
    own = owners(word_offsets)
    grams = gram_hashes(words, k)
    fits = (own[: len(grams)] == own[len(words) - len(grams) :]) if len(grams) else np.zeros(0, bool)
    doc, value = [own[: len(grams)][fits]], [grams[fits]]
    for short in range(1, k):
        at = np.flatnonzero(count == short)
        if len(at):
            g = gram_hashes(words, short)
            doc.append(at)
            value.append(g[word_offsets[at]])
    return np.concatenate(doc), np.concatenate(value)


def distinct_sorted(doc: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values of each text in ascending order: the texts' indices, the values, n + 1 offsets."""
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    if len(doc):
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
        doc, value = doc[new], value[new]
    return doc, value, np.searchsorted(doc, np.arange(n + 1))


def segment_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of each segment; empty ones are 0. Differences of a running sum for integers, else reduceat."""
    if values.dtype.kind in "iub":
        run = np.zeros(len(values) + 1, np.uint64 if values.dtype.kind == "u" else np.int64)
        np.cumsum(values, out=run[1:])
        return run[offsets[1:]] - run[offsets[:-1]]
    out = np.zeros(len(offsets) - 1, np.float64)
    full = np.flatnonzero(np.diff(offsets) > 0)
    if len(full):
        out[full] = np.add.reduceat(values, offsets[full])
    return out


def list_array(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """An Arrow list column from flat values."""
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values).cast(kind))
