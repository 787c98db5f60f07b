"""License scans by diagonal voting.

All word k-gram hashes of a text meet the k-grams of the license templates in a join.
A hit at word i of a text and word j of a template votes for the diagonal i - j; votes
are added up for each diagonal, diagonals that lie a few words apart (a word put in or
left out) are merged, and the span that a merged group covers is verified word by word
against the template. Phrases are templates that must match in full.

The templates are fixed and small, so their hashes go to every executor; texts are
not shuffled, only hits are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textarrays as ta
from .common import durable, table

K = 3
#: Diagonals closer than this many words are one match; a template's words must match in this share at least.
NEAR, COVER = 8, 0.7

#: Phrases that must stand word for word, by label.
PHRASES = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}

#: Sentences of public license texts, by label.
TEMPLATES = {
    "mit": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    ),
    "apache-2": (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis",
    ),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",),
    "gpl": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
        "this work is licensed under the gnu general public license version",
    ),
    "all-rights-reserved": ("all rights reserved",),
    "mpl-2": ("this source code form is subject to the terms of the mozilla public license v 2 0",),
    "cc-by": ("this work is licensed under a creative commons attribution 4 0 international license",),
    "cc-by-sa": ("this work is licensed under a creative commons attribution sharealike 4 0 international license",),
    "cc-by-nc": ("this work is licensed under a creative commons attribution noncommercial 4 0 international license",),
}


def _words(texts: list[str]) -> list[np.ndarray]:
    data, offsets = ta.flat(pa.array(texts))
    s, e, per_text = ta.spans(data, offsets, ta.ALNUM)
    h = ta.span_hashes(data, s, e)
    return [h[a:b] for a, b in zip(per_text, per_text[1:], strict=False)]


class Templates:
    """Templates by number: label, whether a phrase, word hashes; and all their k-grams with places."""

    def __init__(self, phrases: dict[str, str] = PHRASES, templates: dict[str, tuple[str, ...]] = TEMPLATES, k: int = K):
        rows = [(label, True, t) for label, t in phrases.items()] + [(label, False, t) for label, ts in templates.items() for t in ts]
        self.k = k
        self.labels, self.exact = [r[0] for r in rows], [r[1] for r in rows]
        self.words = _words([r[2] for r in rows])
        assert all(len(w) >= k for w in self.words)
        self.grams = [(int(g), n, j) for n, w in enumerate(self.words) for j, g in enumerate(ta.gram_hashes(w, k).view(np.int64))]
        self.filter = np.unique(np.array([g for g, _, _ in self.grams], np.int64).view(np.uint64))


def hits(docs: DataFrame, templates: Templates, text: str = "text") -> DataFrame:
    """``doc_id, uid, n_words, at, gram, words``: places and hashes of a text's k-grams that some template has; the word hashes where there are any."""
    rows = docs.select(docs["doc_id"], F.monotonically_increasing_id().alias("uid"), docs[text].alias("_text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    wanted, k = templates.filter, templates.k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in ta.chunks(batch, "_text"):
                data, offsets = ta.flat(part.column("_text"))
                data = ta.lower_ascii(data)
                s, e, per_text = ta.spans(data, offsets, ta.ALNUM)
                h = ta.span_hashes(data, s, e)
                own = ta.owners(per_text)
                g = ta.gram_hashes(h, k)
                slot = np.minimum(np.searchsorted(wanted, g), len(wanted) - 1)
                found = np.flatnonzero((wanted[slot] == g) & (own[: len(g)] == own[len(own) - len(g) :]) if len(g) else np.zeros(0, bool))
                doc = own[found]
                cut = np.searchsorted(doc, np.arange(part.num_rows + 1))
                some = np.diff(cut) > 0
                size = np.diff(per_text)
                keep = np.repeat(some, size)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"), part.column("uid"), pa.array(size.astype(np.int64)),
                        ta.list_array(found - per_text[doc], cut, pa.int64()), ta.list_array(g[found].view(np.int64), cut, pa.int64()),
                        ta.list_array(h[keep].view(np.int64), np.append(0, np.cumsum(np.where(some, size, 0))), pa.int64()),
                    ],
                    ["doc_id", "uid", "n_words", "at", "gram", "words"],
                )

    return rows.mapInArrow(ta.tidy(run), f"doc_id {kind}, uid long, n_words long, at array<long>, gram array<long>, words array<long>")


def matches(found: DataFrame, templates: Templates) -> DataFrame:
    """``uid, label, exact, first, covered, length``: one row per verified span. ``found`` is what ``hits`` gives.

    ``first`` is the word that the span's template starts at, ``covered`` the template's
    words that stand there in order, of ``length``.
    """
    spark = found.sparkSession
    grams = spark.createDataFrame(templates.grams, "gram long, template int, place long")
    one = found.where(F.size("at") > 0).select("uid", F.explode(F.arrays_zip("at", "gram")).alias("z")).select("uid", "z.at", "z.gram")
    votes = one.join(F.broadcast(grams), "gram").groupBy("uid", "template", (F.col("at") - F.col("place")).alias("diagonal")).agg(F.count(F.lit(1)).alias("votes"), F.min("at").alias("low"), F.max("at").alias("high"))
    exact = [i for i, x in enumerate(templates.exact) if x]
    by = Window.partitionBy("uid", "template").orderBy("diagonal")
    apart = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(by)) > F.when(F.col("template").isin(exact), 0).otherwise(NEAR), F.lit(True))
    groups = votes.withColumn("new", apart.cast("int")).withColumn("group", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    merged = groups.groupBy("uid", "template", "group").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.min("diagonal").alias("first"), F.sum("votes").alias("votes"))
    spans = merged.groupBy("uid").agg(F.collect_list(F.struct("template", "low", "high", "first")).alias("spans"))
    joined = spans.join(found.select(F.col("uid").alias("_uid"), "words"), F.col("uid") == F.col("_uid")).select("uid", "spans", "words")
    labels, full, words, k = templates.labels, templates.exact, templates.words, templates.k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for uid, spans_, text in zip(batch.column("uid").to_pylist(), batch.column("spans").to_pylist(), batch.column("words"), strict=True):
                h = np.asarray(text.values).view(np.uint64)
                for x in spans_:
                    w = words[x["template"]]
                    first = x["first"]
                    if full[x["template"]]:
                        if 0 <= first and np.array_equal(h[first : first + len(w)], w):
                            out.append((uid, labels[x["template"]], True, first, len(w), len(w)))
                        continue
                    covered = in_order(w, h[max(0, x["low"]) : x["high"] + k])
                    if covered >= COVER * len(w):
                        out.append((uid, labels[x["template"]], False, max(0, first), covered, len(w)))
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            kinds = [pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds, strict=True)], ["uid", "label", "exact", "first", "covered", "length"])

    return joined.mapInArrow(ta.tidy(run), "uid long, label string, exact boolean, first long, covered long, length long")


def in_order(template: np.ndarray, part: np.ndarray) -> int:
    """Most words of the template that stand in ``part`` in the template's order (a longest common subsequence).

    ``part`` is cut to the words that the template has, so a long gap costs nothing.
    """
    part = part[np.isin(part, template)]
    best = np.zeros(len(template) + 1, np.int64)
    for x in part:
        up = np.where(template == x, best[:-1] + 1, 0)
        best[1:] = np.maximum(np.maximum.accumulate(up), best[1:])
    return int(best[-1])


def scan(docs: DataFrame, templates: Templates | None = None, text: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts the places of phrases; first_word and last_word are the smallest and
    largest of their starts, null without any. labels adds those of verified
    templates to the phrases' own. score is the best share of a phrase or template
    that was found. Null and empty texts have no words and match nothing; rows are
    scanned one by one, repeated or not; an empty table gives an empty table.
    """
    templates = templates or Templates()
    found = durable(hits(docs, templates, text))
    spans = matches(found, templates)
    place = F.when(F.col("exact"), F.col("first"))
    told = spans.groupBy("uid").agg(
        F.count(place).alias("n_base"), F.min(place).alias("first_word"), F.max(place).alias("last_word"),
        F.collect_set(F.when(F.col("exact"), F.col("label"))).alias("_base"), F.collect_set("label").alias("_all"),
        F.max(F.col("covered") / F.col("length")).alias("score"),
    )
    told = told.withColumnRenamed("uid", "_uid")
    out = found.select("doc_id", "uid", "n_words").join(told, F.col("uid") == F.col("_uid"), "left")
    joined = lambda c: F.coalesce(F.array_join(F.array_sort(c), ","), F.lit(""))
    return out.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        joined("_base").alias("base_labels"), joined("_all").alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
