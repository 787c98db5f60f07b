"""Token counts of fields and sections by offset mapping.

A document is encoded once, whole. The lengths of its tokens give each token's span of
characters, which meets the spans of the sections in a join of intervals. A token that
lies in several sections goes to one of them by an explicit rule:

* ``most``: the section that holds most of its bytes, the earlier of equal ones;
* ``first``: the section of its first byte.

A token that touches no section is counted as between sections. So the counts of a
document's sections and the tokens between them sum to the document's tokens, which
encoding the sections one by one would not give.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from . import textarrays as ta
from .common import table

VOCABULARY = "byte_bpe_50k.tiktoken"


class Vocabulary:
    """Ranks of a byte-level BPE as bytes, with the pattern that cuts texts before merging; picklable."""

    def __init__(self, path: str | None = None, pattern: str | None = None):
        import public_tokenizers

        with open(path or public_tokenizers.path(VOCABULARY), "rb") as f:
            self.raw = f.read()
        self.pattern = pattern or public_tokenizers.PATTERN


@lru_cache(maxsize=2)
def _encoding(raw: bytes, pattern: str):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    size = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        size[rank] = len(token)
    return tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), size


def line_sections(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte spans (starts, ends) of the lines with their line feeds, and n + 1 offsets by text: every byte is in one line."""
    start = np.zeros(len(data), bool)
    start[1:] = data[:-1] == 0x0A
    start[offsets[:-1][np.diff(offsets) > 0]] = True
    s = np.flatnonzero(start)
    return s, np.append(s[1:], len(data))[: len(s)], np.searchsorted(s, offsets)


def given_sections(column: pa.Array, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte spans of sections given by character offsets (array of structs first, last; the last character's successor), in their order.

    Bounds are held within the text. A section that is null, lacks a bound or ends before
    it begins is empty. Where sections overlap, the one that begins first (the earlier of
    equal ones) keeps what they share.
    """
    size = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(column), 0)).astype(np.int64)
    flat = column.flatten()
    own = np.repeat(np.arange(len(size)), size)
    heads = np.flatnonzero((data & 0xC0) != 0x80)
    chars = np.searchsorted(heads, offsets)
    place = np.append(heads, len(data))
    bounds = [pa.compute.struct_field(flat, name).cast(pa.int64()) for name in ("first", "last")]
    known = np.asarray(pa.compute.and_(*(b.is_valid() for b in bounds)))
    s, e = (place[np.clip(chars[own] + np.asarray(b.fill_null(0)), chars[own], chars[own + 1])] for b in bounds)
    s, e = np.where(known, s, offsets[own]), np.where(known, np.maximum(s, e), offsets[own])
    order = np.lexsort((np.arange(len(s)), s, own))
    before = np.maximum.accumulate(np.append(0, e[order]))[:-1] if len(s) else s
    s[order] = np.maximum(s[order], before)
    return s, np.maximum(s, e), np.append(0, np.cumsum(size))


def attribute(token_end: np.ndarray, s: np.ndarray, e: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Section of each token, -1 where it touches none, and how many sections it touches.

    Tokens follow one another without gaps; ``token_end`` are their ends over all
    texts. Sections are sorted and apart.
    """
    begin = np.append(0, token_end[:-1])[: len(token_end)]
    low = np.searchsorted(e, begin, side="right")  # first section that ends after the token begins
    high = np.searchsorted(s, token_end, side="left")  # first section that begins at or after the token's end
    n = np.maximum(high - low, 0)
    pick = np.where(n > 0, low, -1)
    if rule == "first" and len(s):
        return np.where((n > 0) & (s[np.minimum(low, len(s) - 1)] <= begin), low, -1), n
    many = np.flatnonzero(n > 1)
    a, z = begin[many], token_end[many]
    best = low[many]
    size = np.minimum(e[best], z) - np.maximum(s[best], a)
    for step in range(1, int(n.max(initial=0))):
        k = np.where(n[many] > step, low[many] + step, best)
        here = np.minimum(e[k], z) - np.maximum(s[k], a)
        best, size = np.where(here > size, k, best), np.maximum(here, size)
    pick[many] = best
    return pick, n


def count(docs: DataFrame, vocabulary: Vocabulary | None = None, text: str = "text", sections: str | None = None, rule: str = "most", keys: tuple[str, ...] = ("doc_id",), spans: bool = False) -> DataFrame:
    """``keys`` with n_tokens, n_sections, n_between, n_crossing and section_tokens, the tokens of each section in order.

    ``sections`` names a column of arrays of structs (first, last) in characters; by
    default a text's lines, each with its line feed, are its sections. n_crossing
    tokens touch more than one section. With ``spans`` the token ids and the
    character each begins at follow. A null or empty text has no tokens and, by
    default, no sections. Rows are counted one by one, repeated or not; an empty
    table gives an empty table.
    """
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary or Vocabulary())
    picked = [*[docs[c] for c in keys], docs[text].alias("_text")] + ([docs[sections].alias("_sections")] if sections else [])
    rows = docs.select(*picked)
    out = ["n_tokens", "n_sections", "n_between", "n_crossing", "section_tokens"] + (["tokens", "token_starts"] if spans else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, size = _encoding(sent.value.raw, sent.value.pattern)
        for batch in batches:
            for part in ta.chunks(batch, "_text"):
                column = part.column("_text")
                data, offsets = ta.flat(column)
                ids = [encoding.encode_to_numpy(t, disallowed_special=()) if t else np.zeros(0, np.uint32) for t in column.to_pylist()]
                per_text = np.append(0, np.cumsum([len(x) for x in ids]))
                flat = np.concatenate(ids).astype(np.int64)
                end = np.cumsum(size[flat])
                s, e, per_section = given_sections(part.column("_sections"), data, offsets) if sections else line_sections(data, offsets)
                full = e > s
                number = np.flatnonzero(full)
                number = number[np.argsort(s[number], kind="stable")]
                pick, n = attribute(end, s[number], e[number], rule)
                got = np.bincount(number[pick[pick >= 0]], minlength=len(s)) if len(s) else np.zeros(0, np.int64)
                cols = [
                    pa.array(np.diff(per_text)), pa.array(np.diff(per_section)), pa.array(ta.segment_sums(pick < 0, per_text)),
                    pa.array(ta.segment_sums(n > 1, per_text)), ta.list_array(got.astype(np.int64), per_section, pa.int32()),
                ]
                if spans:
                    heads = np.append(0, np.cumsum((data & 0xC0) != 0x80))
                    begin = np.append(0, end[:-1])[: len(end)]
                    # the character that holds a token's first byte
                    char = heads[np.minimum(begin + 1, len(data))] - 1 - np.repeat(heads[offsets[:-1]], np.diff(per_text))
                    cols += [ta.list_array(flat, per_text, pa.int32()), ta.list_array(char, per_text, pa.int32())]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keys)], *cols], [*keys, *out])

    kinds = T.StructType(rows.schema.fields[: len(keys)])
    for name, kind in zip(out, (*["long"] * 4, *[T.ArrayType(T.IntegerType())] * 3), strict=False):
        kinds = kinds.add(name, kind)
    return rows.mapInArrow(ta.tidy(run), kinds)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections are the lines of each document."""
    return count(table(spark, sf_dir, "documents").select("doc_id", "text"))
