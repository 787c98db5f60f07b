"""SentencePiece encoding and decoding in batches of numpy arrays.

A text is cut into units before each run of spaces and around line feeds, which no
piece reaches across. Each distinct unit of a worker is worked out once; texts are put
together from the units' ids by array gathers.

Units of the same length advance together. Hashes of all their substrings, from
differences of running polynomial sums, probe the sorted hashes of the pieces. From
that table of pieces

* a unigram model takes the Viterbi path: column by column, the best of all pieces that
  end there, with vectorised maxima and backpointers;
* a BPE model takes its merges: per step, every unit joins its best neighbouring pair.
  A Viterbi path over BPE scores is another segmentation than the model's own, so it is
  not used there unless asked for (``method="viterbi"``).

Characters that no piece covers become byte pieces, or the unknown piece without them.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textarrays as ta
from .common import table

MODEL = "piece_bpe_32k.model"
#: Units of more characters are encoded one by one, with a heap.
WIDE = 64
#: Units that a worker remembers.
MEMORY = 1 << 18
_UNK_PENALTY = 10.0
_SPACE = 0x2581
_P = np.uint64(0xD6E8FEB86659FD93)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_FIRST = np.uint64(0xA5A5A5A55A5A5A5B)


def model_path(name: str = MODEL) -> str:
    """Place of a public tokenizer file on the driver."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _hash_rows(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums (rows, length + 1) of the rows' characters and the inverse powers."""
    n, width = points.shape
    power = np.full(max(width, 1), _P, np.uint64)
    power[0] = 1
    inverse = np.full(max(width, 1), _P_INV, np.uint64)
    inverse[0] = 1
    power, inverse = np.multiply.accumulate(power), np.multiply.accumulate(inverse)
    run = np.zeros((n, width + 1), np.uint64)
    np.cumsum(ta.mix(points.astype(np.uint64) + np.uint64(1)) * power[:width], axis=1, out=run[:, 1:])
    return run, inverse


class Pieces:
    """A SentencePiece model as arrays: sorted piece hashes, scores, byte pieces and the bytes of each piece."""

    def __init__(self, model: bytes, method: str | None = None):
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        m.ParseFromString(model)
        kinds = pb.ModelProto.SentencePiece
        if m.normalizer_spec.precompiled_charsmap or m.normalizer_spec.remove_extra_whitespaces or not m.normalizer_spec.escape_whitespaces:
            raise ValueError("only models with identity normalisation are supported")
        if any(p.type == kinds.USER_DEFINED for p in m.pieces):
            raise ValueError("models with user-defined pieces aren't supported")
        self.method = method or {1: "viterbi", 2: "merges"}[m.trainer_spec.model_type]
        self.prefix = m.normalizer_spec.add_dummy_prefix
        text = [(i, p.piece, p.score) for i, p in enumerate(m.pieces) if p.type in (kinds.NORMAL, 0)]
        if any("\n" in t or (t.strip("▁") and "▁" in t[1:]) for _, t, _ in text):
            raise ValueError("a piece reaches across the places where texts are cut")
        self.longest = max(len(t) for _, t, _ in text)
        points = np.zeros((len(text), self.longest), np.int64)
        size = np.array([len(t) for _, t, _ in text])
        for k, (_, t, _) in enumerate(text):
            points[k, : len(t)] = [ord(c) for c in t]
        run, _ = _hash_rows(points)
        key = run[np.arange(len(text)), size] + size.astype(np.uint64)
        order = np.argsort(key)
        self.keys, self.ids = key[order], np.array([i for i, _, _ in text], np.int32)[order]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces share a hash")
        self.maybe = np.zeros(1 << 20, bool)  # by a key's first 20 bits: most substrings are no piece
        self.maybe[(self.keys >> np.uint64(44)).astype(np.int64)] = True
        self.scores = np.full(len(m.pieces), -np.inf)
        self.scores[[i for i, _, _ in text]] = [s for _, _, s in text]
        self.least = float(min(s for _, _, s in text))
        self.unknown = next((i for i, p in enumerate(m.pieces) if p.type == kinds.UNKNOWN), 0)
        byte = {int(p.piece[1:-1], 16): i for i, p in enumerate(m.pieces) if p.type == kinds.BYTE}
        self.byte_ids = np.array([byte[b] for b in range(256)], np.int32) if len(byte) == 256 else None
        self.is_byte = np.zeros(len(m.pieces), bool)
        raw = [b""] * len(m.pieces)
        for i, t, _ in text:
            raw[i] = t.replace("▁", " ").encode()
        for b, i in byte.items():
            raw[i], self.is_byte[i] = bytes([b]), True
        raw[self.unknown] = " ⁇ ".encode()
        self.raw_offsets = np.append(0, np.cumsum([len(r) for r in raw]))
        self.raw = np.frombuffer(b"".join(raw), np.uint8)

    # -- units of one length ----------------------------------------------------------------

    def substrings(self, points: np.ndarray) -> np.ndarray:
        """(rows, starts, lengths) of piece ids, -1 where a substring is no piece; index 0 of the last axis is length 1."""
        n, width = points.shape
        run, inverse = _hash_rows(points)
        most = min(width, self.longest)
        out = np.full((n, width, most), -1, np.int32)
        for k in range(1, most + 1):
            key = (run[:, k:] - run[:, : width - k + 1]) * inverse[: width - k + 1] + np.uint64(k)
            row, start = np.nonzero(self.maybe[(key >> np.uint64(44)).astype(np.int64)])
            key = key[row, start]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            out[row, start, k - 1] = np.where(self.keys[at] == key, self.ids[at], -1)
        return out

    def viterbi(self, points: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, start and end of the pieces of the best path of each row, in order."""
        n, width = points.shape
        score = np.where(found >= 0, self.scores[found], -np.inf)
        score[:, :, 0] = np.where(found[:, :, 0] >= 0, score[:, :, 0], self.least - _UNK_PENALTY)
        best = np.full((n, width + 1), -np.inf)
        best[:, 0] = 0
        back = np.zeros((n, width + 1), np.int64)
        rows = np.arange(n)
        for end in range(1, width + 1):
            k = np.arange(min(end, found.shape[2]), 0, -1)  # of equal paths the one with the longest last piece
            paths = best[:, end - k] + score[:, end - k, k - 1]
            pick = paths.argmax(axis=1)
            best[:, end], back[:, end] = paths[rows, pick], end - k[pick]
        is_end = np.zeros((n, width + 1), bool)
        at = np.full(n, width)
        while (at > 0).any():
            is_end[rows, at] = True
            at = np.where(at > 0, back[rows, at], 0)
        row, end = np.nonzero(is_end[:, 1:])
        end = end + 1
        start = np.append(0, end[:-1])
        start[np.append(True, row[1:] != row[:-1])] = 0
        return row, start, end

    def merges(self, points: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same after joining, again and again, the neighbours whose union scores best (the leftmost first)."""
        n, width = points.shape
        most = found.shape[2]
        score = np.append(self.scores, -np.inf)[found].astype(np.float32).reshape(n, -1)
        ends = np.tile(np.arange(width + 1), (n, 1))
        count = np.full(n, width)
        live = np.arange(n)
        column, k = np.arange(width + 1), np.arange(max(width - 1, 0))
        for _ in range(width - 1):
            e = ends[live]
            size = e[:, 2:] - e[:, :-2]
            fits = (k < (count[live] - 1)[:, None]) & (size <= most)
            place = np.where(fits, e[:, :-2] * most + size - 1, 0)
            s = np.where(fits, np.take_along_axis(score[live], place, axis=1), -np.inf)
            pick = s.argmax(axis=1)
            can = s[np.arange(len(live)), pick] > -np.inf
            live, pick, e = live[can], pick[can], e[can]
            if not len(live):
                break
            ends[live] = np.take_along_axis(e, np.minimum(column + (column[None, :] > pick[:, None]), width), axis=1)
            count[live] -= 1
        row, at = np.nonzero(np.arange(width) < count[:, None])
        return row, ends[row, at], ends[row, at + 1]

    def _heap(self, points: np.ndarray) -> list[tuple[int, int]]:
        """Merges of one long unit: spans of its pieces."""
        n = len(points)
        run, inverse = _hash_rows(points[None, :])
        run = run[0]
        after, before, end, alive = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
        best: list[tuple[float, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and end[j] - i <= self.longest:
                key = (run[end[j]] - run[i]) * inverse[i] + np.uint64(end[j] - i)
                at = int(np.searchsorted(self.keys, key))
                if at < len(self.keys) and self.keys[at] == key:
                    heapq.heappush(best, (-self.scores[self.ids[at]], i, j, end[j]))

        with np.errstate(over="ignore"):
            for i in range(n - 1):
                offer(i)
            while best:
                _, i, j, to = heapq.heappop(best)
                if not (alive[i] and j < n and alive[j] and after[i] == j and end[j] == to):
                    continue
                alive[j], end[i], after[i] = False, to, after[j]
                if after[i] < n:
                    before[after[i]] = i
                offer(i)
                if before[i] >= 0:
                    offer(before[i])
        return [(i, end[i]) for i in range(n) if alive[i]]

    def _emit(self, piece: int, points: np.ndarray) -> list[int]:
        if piece >= 0:
            return [piece]
        if self.byte_ids is None:
            return [self.unknown]
        return self.byte_ids[list("".join(map(chr, points)).encode("utf-8", "surrogatepass"))].tolist()

    def encode_units(self, points: np.ndarray, starts: np.ndarray, sizes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units end to end and their offsets; units are spans of ``points``, with a space put before the ``first`` ones."""
        total = sizes + first
        order, counts, flat = [], [], []
        for width in np.unique(total):
            rows = np.flatnonzero(total == width)
            if width > WIDE and self.method == "merges":
                for r in rows:
                    own = np.concatenate([[_SPACE] * int(first[r]), points[starts[r] : starts[r] + sizes[r]]]).astype(np.int64)
                    ids = [x for a, b in self._heap(own) for x in self._emit(self._one(own[a:b]), own[a:b])]
                    order.append([r])
                    counts.append([len(ids)])
                    flat.append(ids)
                continue
            step = max(1, (1 << 19) // (int(width) * min(int(width), self.longest)))
            for k in range(0, len(rows), step):
                part = rows[k : k + step]
                at = starts[part][:, None] + np.arange(width) - first[part][:, None]
                block = np.where((np.arange(width) == 0) & (first[part] > 0)[:, None], _SPACE, points[np.maximum(at, 0)])
                found = self.substrings(block)
                row, a, b = getattr(self, self.method)(block, found)
                size = b - a
                ids = np.where(size <= found.shape[2], found[row, a, np.minimum(size, found.shape[2]) - 1], -1)
                n = np.ones(len(ids), np.int64)
                odd = np.flatnonzero(ids < 0)
                if len(odd):
                    spelled = [self._emit(-1, block[row[i], a[i] : b[i]]) for i in odd]
                    n[odd] = [len(x) for x in spelled]
                    to = np.append(0, np.cumsum(n))
                    ids = np.repeat(ids, n)
                    ids[_ragged(to[odd], n[odd])] = np.concatenate([np.asarray(x, np.int32) for x in spelled])
                order.append(part)
                counts.append(np.bincount(row, n, len(part)).astype(np.int64))
                flat.append(ids)
        if not order:
            return np.zeros(0, np.int32), np.zeros(1, np.int64)
        order, counts, flat = (np.concatenate([np.asarray(x) for x in z]) for z in (order, counts, flat))
        begin = np.cumsum(counts) - counts
        back = np.argsort(order, kind="stable")
        return flat[_ragged(begin[back], counts[back])].astype(np.int32), np.append(0, np.cumsum(counts[back]))

    def _one(self, points: np.ndarray) -> int:
        if len(points) > self.longest:
            return -1
        run, _ = _hash_rows(points[None, :])
        key = run[0, -1] + np.uint64(len(points))
        at = int(np.searchsorted(self.keys, key))
        return int(self.ids[at]) if at < len(self.keys) and self.keys[at] == key else -1


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of the entries of consecutive ragged rows."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - sizes), sizes)


class Encoder:
    """Encodes columns of texts, remembering the units it has met by a 64-bit hash."""

    SLOT_BITS = 20

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(1 << self.SLOT_BITS, np.uint64)
        self.place = np.full(1 << self.SLOT_BITS, -1, np.int32)
        self.store, self.offsets = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _units(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        space, feed = data == 0x20, data == 0x0A
        start = space | feed
        wide = space.copy()  # ends of what counts as a space, the sign U+2581 included
        wide[2:] |= (data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81)
        start[1:] &= ~(space[1:] & wide[:-1])
        start[1:] |= feed[:-1]
        begin = offsets[:-1][np.diff(offsets) > 0]
        start[begin] = True
        first = np.zeros(len(data), bool)
        first[begin] = self.pieces.prefix
        at = np.flatnonzero(start)
        return at, first[at]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids end to end, offsets by text, bytes of the texts, offsets of the bytes)."""
        data, offsets = ta.flat(column)
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64), data, offsets
        if len(self.offsets) > MEMORY:
            self.clear()
        s, first = self._units(data, offsets)
        e = np.append(s[1:], len(data))
        h = ta.span_hashes(data, s, e)
        h = np.where(first, ta.mix(h ^ _FIRST), h)
        slot = (h >> np.uint64(64 - self.SLOT_BITS)).astype(np.int64)
        number = np.where(self.keys[slot] == h, self.place[slot], -1)
        miss = np.flatnonzero(number < 0)
        if len(miss):
            new, at, inv = np.unique(h[miss], return_index=True, return_inverse=True)
            at = miss[at]
            points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32).astype(np.int64)
            points = np.where(points == 0x20, _SPACE, points)
            index = np.append(0, np.cumsum((data & 0xC0) != 0x80))
            a, b = index[s[at]], index[e[at]]
            ids, off = self.pieces.encode_units(points, a, b - a, first[at].astype(np.int64))
            known = len(self.offsets) - 1
            self.offsets = np.concatenate([self.offsets, off[1:] + self.offsets[-1]])
            self.store = np.concatenate([self.store, ids])
            mine = np.arange(known, known + len(new), dtype=np.int32)
            number[miss] = mine[inv]
            to = (new >> np.uint64(64 - self.SLOT_BITS)).astype(np.int64)
            self.keys[to], self.place[to] = new, mine
        size = self.offsets[number + 1] - self.offsets[number]
        ids = self.store[_ragged(self.offsets[number], size)]
        run = np.append(0, np.cumsum(size))
        return ids, run[np.searchsorted(s, offsets)], data, offsets


_WORKER: list = []


def _encoder(pieces: Pieces) -> Encoder:
    """This worker's encoder for a model: what it has met stays for the worker's next tasks."""
    if not _WORKER or _WORKER[0].pieces is not pieces and not np.array_equal(_WORKER[0].pieces.keys, pieces.keys) or _WORKER[0].pieces.method != pieces.method:
        _WORKER[:] = [Encoder(pieces)]
    return _WORKER[0]


def decode(pieces: Pieces, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the texts that the ids spell, end to end, and their offsets; the space put before a text is taken off."""
    size = pieces.raw_offsets[ids + 1] - pieces.raw_offsets[ids]
    out = pieces.raw[_ragged(pieces.raw_offsets[ids], size)]
    run = np.append(0, np.cumsum(size))[offsets]
    if pieces.prefix and len(out):
        full = run[:-1][(np.diff(run) > 0)]
        drop = full[out[full] == 0x20]
        keep = np.ones(len(out), bool)
        keep[drop] = False
        out = out[keep]
        run = run - np.searchsorted(drop, run)
    return out, run


def _same_texts(a: np.ndarray, a_off: np.ndarray, b: np.ndarray, b_off: np.ndarray) -> np.ndarray:
    """Which texts are equal byte by byte."""
    equal = np.diff(a_off) == np.diff(b_off)
    if len(a) == len(b) and equal.all():
        return ta.segment_sums(a != b, a_off) == 0
    for i in np.flatnonzero(equal):
        equal[i] = np.array_equal(a[a_off[i] : a_off[i + 1]], b[b_off[i] : b_off[i + 1]])
    return equal


def encode(docs: DataFrame, path: str | None = None, text: str = "text", method: str | None = None) -> DataFrame:
    """``docs`` without clashing columns, with ``tokens`` (ids), ``n_tokens``, ``n_bytes_spelled`` (byte pieces) and ``round_trip``.

    round_trip says whether decoding the ids gives the text again byte by byte; a text
    that holds the sign for spaces, U+2581, doesn't come back, and null counts as an
    empty text, which has no tokens. Repeated rows are encoded one by one; an empty
    table gives an empty table. The model file is read on the driver and sent out.
    """
    with open(path or model_path(), "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast(Pieces(f.read(), method))
    kinds = {"tokens": "array<int>", "n_tokens": "bigint", "n_bytes_spelled": "bigint", "round_trip": "boolean"}

    def of():
        pieces = sent.value
        encoder = _encoder(pieces)

        def work(column: pa.Array) -> pa.StructArray:
            ids, offsets, data, data_off = encoder.encode(column)
            back, back_off = decode(pieces, ids, offsets)
            cols = [ta.list_array(ids, offsets, pa.int32()), pa.array(np.diff(offsets)), pa.array(ta.segment_sums(pieces.is_byte[ids], offsets)), pa.array(_same_texts(data, data_off, back, back_off))]
            return pa.StructArray.from_arrays(cols, list(kinds))

        return work

    coded = ta.text_function(of, lambda x: x, f"struct<{','.join(f'{k}: {v}' for k, v in kinds.items())}>")
    rows = docs.drop(*[c for c in kinds if c in docs.columns])
    # what was there stays in one column, away from ours, and doesn't go to Python
    told = docs.select(F.struct(*[docs[c] for c in rows.columns]).alias("_row"), coded(docs[text]).alias("_code"))
    return told.select("_row.*", "_code.*")


def decode_tokens(rows: DataFrame, path: str | None = None, tokens: str = "tokens") -> DataFrame:
    """``rows`` with ``decoded``, the text that the ids in ``tokens`` spell; null ids spell nothing, bytes that are no UTF-8 become U+FFFD."""
    with open(path or model_path(), "rb") as f:
        sent = rows.sparkSession.sparkContext.broadcast(Pieces(f.read()))
    kept = rows.drop("decoded") if "decoded" in rows.columns else rows
    names = kept.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(tokens)
            size = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(column), 0)).astype(np.int64)
            ids = np.asarray(column.flatten()).astype(np.int64)
            out, off = decode(sent.value, ids, np.append(0, np.cumsum(size)))
            raw = out.tobytes()
            texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(off, off[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*names, "decoded"])

    return kept.mapInArrow(ta.tidy(run), T.StructType(list(kept.schema.fields)).add("decoded", "string"))


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
