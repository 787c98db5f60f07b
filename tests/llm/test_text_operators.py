"""Each operator against brute force on a small table with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import gc
import math
import random
import re
import threading
import time
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marigraph.llm import bytegrams, common, langid, licenses, mixing, pieces, quality_model, quality_rules, textarrays, token_counts, toxicity

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words int, score string, uid int, label int"
LONG = "long word " * 3000
TEXTS = [
    None, "", "   ", "\n\n", "one", "The the THE the", "a b c a b c a b c", "é à ü\nline\nline\n line", "Released under the MIT License.", "licensed under the Apache License, Version 2.0 and CC BY-NC 4.0 cc by nc",
    LONG, "x" * 5000, "tab\tand\rcarriage", "12345 !!! ???", "日本語 テキスト 日本語", "### *** $$$ a", "same text here", "same text here", "ends with space ", " starts",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i != 5 else None, t, ["en", "de", None][i % 3], [None, "b", "a", "C"][i % 4], len(t or ""), 7, "s", 1, 2) for i, t in enumerate(TEXTS)]
    rows.append((7, TEXTS[7], "en", "b", 1, 7, "s", 1, 2))  # a repeated row
    return spark.createDataFrame(rows, DOCS)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def by_text(df, *cols):
    return {r["_text"]: tuple(r[c] for c in cols) for r in df.collect()}


def test_quality_rules(spark, docs):
    got = quality_rules.judge(docs.withColumnRenamed("lang", "_text").withColumn("_text", docs["text"])).collect()
    assert len(got) == len(TEXTS) + 1
    for r in got:
        t = r["_text"] or ""
        w, lines = words(t), [x for x in t.split("\n") if words(x)]
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        again = {p for i, g in enumerate(grams) if grams.count(g) > 1 for p in (i, i + 1, i + 2)} if len(w) < 500 else set(range(len(w)))
        assert r["n_words"] == len(w) and r["word_chars"] == sum(map(len, w)) and r["n_symbols"] == len(re.findall(r"[#*$%&|<>]", t))
        assert r["n_dup_lines"] == len(lines) - len(set(lines)) and r["n_repeat_words"] == len(again)
        assert r["base_failed"] == (len(w) < 50 or 100 * len(again) > 50 * len(w))
    assert quality_rules.judge(docs.limit(0)).count() == 0
    odd = docs.withColumnsRenamed({"lang": "_words", "source": "_lines", "score": "_row"})
    assert [c for c in quality_rules.judge(odd).columns if c in odd.columns] == [c for c in odd.columns if c != "n_words"] + ["n_words"]


def test_quality_rules_keep_prose(spark):
    prose = " ".join(f"the w{i} of x{i * 7}." for i in range(40))
    junk = " ".join(f"w{i}### x{i}***" for i in range(40))
    got = {r["text"]: r["kept"] for r in quality_rules.judge(spark.createDataFrame([(prose,), (junk,)], "text string")).collect()}
    assert got == {prose: True, junk: False}


def test_language(spark, docs):
    train = spark.createDataFrame([("the cat sat on the mat and the dog ran " * 5, "en"), ("der hund und die katze sind auf dem dach " * 5, "de"), (None, "fr"), ("x", None)], "text string, lang string")
    model = langid.fit(train)
    assert model.columns == ["de", "en"] and model.sent
    rows = spark.createDataFrame([(1, "the dog sat on the mat"), (2, "die katze und der hund"), (3, None), (4, "123 !"), (5, ""), (6, "Ω"), (7, LONG)], "doc_id long, text string")
    told = {r["doc_id"]: r for r in langid.predict(rows, model).collect()}
    got = {k: r["lang_pred"] for k, r in told.items()}
    assert got == got | {1: "en", 2: "de", 3: "und", 4: "und", 5: "und"} and got[6] in ("de", "en") and all(0 <= r["score"] <= 1 for r in told.values())
    # a tree that stays in a table gives the same
    spread = langid.fit(train, most=0)
    again = {r["doc_id"]: r for r in langid.predict(rows, spread).collect()}
    assert not spread.sent and {k: r["lang_pred"] for k, r in again.items()} == got
    assert all(again[k]["score"] == pytest.approx(told[k]["score"]) and again[k]["bits_per_byte"] == pytest.approx(told[k]["bits_per_byte"]) for k in told)
    nothing = langid.fit(train.limit(0))
    assert nothing.columns == [] and {r["lang_pred"] for r in langid.predict(rows, nothing).collect()} == {"und"}
    for m in (model, spread):
        assert langid.predict(docs, m).count() == len(TEXTS) + 1 and langid.predict(docs.limit(0), m).count() == 0


def test_languages_alike(spark):
    """Of equally good languages the first by name is taken, each with an equal share."""
    model = langid.fit(spark.createDataFrame([("same words", "b"), ("same words", "a"), ("same words", "b"), ("same words", "a")], "text string, lang string"))
    (row,) = langid.predict(spark.createDataFrame([(1, "same words")], "doc_id long, text string"), model).collect()
    assert row["lang_pred"] == "a" and row["score"] == pytest.approx(0.5)


def test_code_lengths_are_those_of_a_plain_model():
    """Prediction by partial matching, symbol by symbol, with escape method C and exclusion."""
    text, probe = b"abracadabra abracadabra banana", b"abra banzai"
    code, n = np.unique(bytegrams.grams(np.frombuffer(text, np.uint8), np.array([0, len(text)])), return_counts=True)
    counts: dict = {}
    padded = b"\n\n\n" + text
    for i in range(3, len(padded)):
        for k in range(4):
            counts.setdefault(padded[i - k : i], {}).setdefault(padded[i], 0)
            counts[padded[i - k : i]][padded[i]] += 1
    total, run = 0.0, b"\n\n\n" + probe
    for i in range(3, len(run)):
        gone: set = set()
        for k in range(3, -1, -1):
            here = counts.get(run[i - k : i])
            if here is None:
                continue
            left = {s: c for s, c in here.items() if s not in gone}
            whole = sum(left.values()) + len(left)
            if run[i] in left:
                total += math.log2(whole / left[run[i]])
                break
            if left:
                total += math.log2(whole / len(left))
            gone |= set(here)
        else:
            total += math.log2(256 - len(gone))
    trees = langid.Trees({"x": (code, n.astype(float))}, ["x"])
    got = bytegrams.Memory(trees).sums(np.frombuffer(probe, np.uint8), np.array([0, len(probe)]))
    assert got[0, 0] == pytest.approx(total, rel=1e-9)


def test_licenses(spark, docs):
    got = licenses.scan(docs.withColumn("label", docs["label"]))
    rows = sorted(got.collect(), key=str)
    assert len(rows) == len(TEXTS) + 1
    by = {r["doc_id"]: r for r in rows}
    assert by[8]["base_labels"] == "mit" and by[8]["n_base"] == 1 and by[8]["first_word"] == 1
    assert by[9]["base_labels"] == "apache-2,cc-by-nc" and by[9]["n_base"] == 3 and by[9]["last_word"] == 14
    assert by[0]["n_words"] == 0 and by[0]["first_word"] is None and by[0]["labels"] == "" and by[0]["score"] == 0
    assert by[6]["n_words"] == 9 and licenses.scan(docs.limit(0)).count() == 0


def test_licenses_as_brute_force(spark):
    rows = duckdb.sql(f"select doc_id, text from read_parquet('{SF}/documents.parquet')").fetchall()
    rows += [(10**6 + i, t) for i, t in enumerate(["cc by nc cc by nc", "under the mit license " * 40, "CC BY\nNC", "cc by. nc by nc", "the mit license under the MIT-License"])]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        found = [(k, label) for label, p in licenses.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        r = got[i]
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(w), len(found), ",".join(sorted({x for _, x in found})))
        assert (r["first_word"], r["last_word"]) == ((min(found)[0], max(found)[0]) if found else (None, None))
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))
        if "gnu general public license" in " ".join(w):
            assert "gpl" in r["labels"]


def test_license_texts_with_changes(spark):
    text = "x y Permission is hereby granted, free of charge, to any kind person obtaining a copy of this software and associated files z"
    rows = spark.createDataFrame([(1, text), (2, "permission is hereby granted to park")], "doc_id long, text string")
    got = {r["doc_id"]: (r["labels"], r["base_labels"]) for r in licenses.scan(rows).collect()}
    assert got == {1: ("mit", ""), 2: ("", "")}


def test_quality_model_and_toxicity(spark):
    rng = random.Random(2)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(200)]
    rows, labels = [], []
    for i in range(400):
        w = [rng.choice(vocabulary) for _ in range(80)]
        poor, toxic = i % 5 == 0, i % 4 == 0
        if poor:
            w = [x + "###" for x in w]
        if toxic:
            for k in range(0, 80, 10):
                w[k] = "nasty"
        rows.append((i, " ".join(w), "x"))
        labels.append((i, int(not poor), int(toxic)))
    rows += [(None, "a", "x"), (1000, None, "x"), (1001, "", "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string, score string")
    marks = spark.createDataFrame(labels + labels[:3], "doc_id long, quality int, toxic int")
    trees = quality_model.train(d, marks)
    scored = lambda t: d.select("doc_id", quality_model.score(t, spark, d["text"]).alias("score"))
    got = {r["doc_id"]: r["score"] for r in scored(trees).collect()}
    assert len(got) == 403 and all(0 <= s <= 1 for s in got.values())
    assert np.mean([(got[i] >= 0.5) == q for i, q, _ in labels if zlib.crc32(str(i).encode()) % 3 == 1]) == 1
    assert sorted(r["doc_id"] for r in quality_model.drop_poor(d, marks).select("doc_id").collect() if r["doc_id"] is not None and r["doc_id"] < 400) == [i for i, q, _ in labels if q]
    model = toxicity.train(d, marks)
    got = {r["doc_id"]: r["score"] for r in model.score(d.drop("score"), d["text"]).collect()}
    assert np.mean([(got[i] >= toxicity.THRESHOLD) == t for i, _, t in labels if zlib.crc32(str(i).encode()) % 3 == 1]) > 0.97
    empty = marks.limit(0)
    half = toxicity.train(d, empty).score(d, d["text"])
    assert {round(r["score"], 3) for r in half.collect()} == {0.5}
    assert scored(quality_model.train(d, empty)).count() == 403
    assert toxicity.drop_toxic(d.limit(0), marks).count() == 0 and quality_model.drop_poor(d.limit(0), marks).count() == 0
    # rows count one by one, whatever their columns are called
    odd = d.unionAll(d).withColumnRenamed("score", "_score").withColumn("_row", F.lit(1))
    kept = toxicity.drop_toxic(odd, marks)
    assert kept.columns == odd.columns and kept.count() == 2 * toxicity.drop_toxic(d, marks).count()
    assert quality_model.drop_poor(odd, marks).columns == odd.columns
    long = spark.createDataFrame([(1, LONG), (2, None), (3, "")], "doc_id long, text string")
    assert all(0 <= r["score"] <= 1 for r in model.score(long, long["text"]).collect())


def plain_kneser_ney(texts):
    """Probability of a byte after three others in each class, symbol by symbol; ``texts`` by class."""
    rows = {c: [b"\n\n\n" + t for t in ts] for c, ts in texts.items()}
    grams = {c: [r[i - 3 : i + 1] for r in rs for i in range(3, len(r))] for c, rs in rows.items()}
    cut = lambda n: (lambda a, b: a / (a + 2 * b) if a and b else 0.75)(sum(x == 1 for x in n.values()), sum(x == 2 for x in n.values()))
    count = lambda items: {x: items.count(x) for x in set(items)}
    full = {c: count(g) for c, g in grams.items()}
    three = {c: count([x[1:] for x in set(g)]) for c, g in grams.items()}
    both = {x[1:] for g in grams.values() for x in g}
    two = count([x[1:] for x in both])
    one = count([x[1:] for x in two])

    def over(n, gram, below):
        own = {x: k for x, k in n.items() if x[:-1] == gram[:-1]}
        if not own:
            return below
        return (max(n.get(gram, 0) - cut(n), 0) + cut(n) * len(own) * below) / sum(own.values())

    def p(c, gram):
        low = over(two, gram[2:], over(one, gram[3:], 1 / 256))
        return over(full[c], gram, over(three[c], gram[1:], low))

    return p


def test_probabilities_of_the_toxic_models(spark):
    texts = {"0": [b"abracadabra cab", b"a bad cab"], "1": [b"abba dabba", b"a bad bad dab"]}
    rows = spark.createDataFrame([(t.decode().title(), int(c)) for c, ts in texts.items() for t in ts], "text string, toxic int")
    model, plain = toxicity.fit(rows).models.model(), plain_kneser_ney(texts)
    code = lambda g: sum(b << (8 * (3 - i)) for i, b in enumerate(g))
    probes = [b"abra", b"bad ", b"\n\n\na", b"xyzq", b"zabb", b"yyab", b" dab", b"zzzb"]
    got = model.probabilities(np.array([code(g) for g in probes], np.uint32))
    assert got == pytest.approx(np.array([[plain(c, g) for g in probes] for c in ("0", "1")]))
    for context in (b"abr", b"ba ", b"xyz", b"qab"):
        every = model.probabilities(np.array([code(context + bytes([b])) for b in range(256)], np.uint32))
        assert every.sum(axis=1) == pytest.approx([1, 1])
    probe = spark.createDataFrame([(1, "A bad dabba xyz"), (2, None), (3, "")], "doc_id long, text string")
    told = {r["doc_id"]: r["ev"] for r in toxicity.fit(rows).evidence(probe, probe["text"], "ev").collect()}
    again = {r["doc_id"]: r["ev"] for r in toxicity.fit(rows, most=0).evidence(probe, probe["text"], "ev").collect()}
    line = b"\n\n\na bad dabba xyz"
    want = sum(math.log(plain("1", line[i - 3 : i + 1]) / plain("0", line[i - 3 : i + 1])) for i in range(3, len(line))) / 15
    assert told == pytest.approx({1: want, 2: 0, 3: 0}) and again == pytest.approx(told)


def test_trees_are_walked_as_trees():
    """Scores equal those of a plain walk, node by node; statistics of a text by itself equal those in a batch."""
    rng = np.random.default_rng(5)
    texts = [" ".join("abcdefgh"[rng.integers(8)] * int(rng.integers(1, 9)) + "#" * int(rng.integers(3)) for _ in range(int(rng.integers(1, 60)))) for _ in range(200)] + TEXTS
    x = quality_model.statistics(pa.array(texts, pa.string()))
    for i in (0, 7, 50, 203, 207, 210, 211):
        assert quality_model.statistics(pa.array([texts[i]], pa.string()))[0] == pytest.approx(x[i], rel=1e-5)
    t = quality_model.grow(x, (x[:, 4] + rng.normal(size=len(x)) * 0.01 > 0.1).astype(float), trees=12)
    for row, score in zip(x, t.margin(x), strict=True):
        total = t.start
        for f, cut, leaf in zip(t.feature, t.threshold, t.leaf, strict=True):
            node = 0
            while node < len(f):
                node = 2 * node + (2 if row[f[node]] > cut[node] else 1)
            total += leaf[node - len(f)]
        assert score == pytest.approx(total)


def test_statistics_of_a_text():
    t = "The cat. The cat. THE CAT! ab#\n\none\none"
    got = dict(zip(quality_model.FEATURES, quality_model.statistics(pa.array([t]))[0].tolist(), strict=True))
    w = words(t)
    triples = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    want = {
        "log_words": math.log1p(len(w)), "word_bytes": sum(map(len, w)) / len(w), "upper": sum(c.isupper() for c in t) / len(t), "digit": 0, "symbol": 1 / len(t),
        "stop_mark": 3 / len(t), "space": sum(c.isspace() for c in t) / len(t), "distinct_words": len(set(w)) / len(w), "top_word": 2 / len(w),
        "repeated_triples": sum(triples.count(g) for g in set(triples) if triples.count(g) > 1) / len(w), "repeated_words_next": 1 / len(w),
        "capital_words": 2 / len(w), "capital_first": 4 / len(w), "symbol_words": 1 / len(w), "mark_end_words": 3 / len(w), "short_words": 0, "long_words": 0,
        "log_lines": math.log1p(3), "words_a_line": len(w) / 3, "repeated_lines": 2 / 3, "symbol_lines": 1 / 3, "mark_end_lines": 0, "one_word_lines": 2 / 3,
    }
    assert {k: got[k] for k in want} == pytest.approx(want, rel=1e-5)


def test_mixing(spark, docs):
    told, slots, parts = mixing.mix(docs, block_words=16, shard_slots=8)
    taken = {r["uid"]: r["taken"] for r in mixing.taken_words(slots, parts).collect()}
    rows = told.collect()
    assert len(rows) == len(TEXTS) + 1 and [r["size"] for r in sorted(rows, key=lambda r: r["uid"])][:5] == [len(words(t)) for t in TEXTS[:5]]
    s = slots.collect()
    by = {}
    for r in s:
        by.setdefault(r["source"], []).append(r)
    for source, own in by.items():
        assert sorted(r["j"] for r in own) == list(range(len(own)))
        n = math.ceil(next(r["source_size"] for r in rows if r["source"] == source) / 16)
        for epoch in {r["epoch"] for r in own}:
            blocks = [r["block"] for r in own if r["epoch"] == epoch]
            assert len(set(blocks)) == len(blocks) and max(blocks) < n
        words_ = sum(taken.get(r["uid"], 0) for r in rows if r["source"] == source)
        goal = next(r["target"] for r in rows if r["source"] == source)
        assert abs(words_ - goal) <= 17
    assert all(taken.get(r["uid"], 0) <= 2 * r["size"] for r in rows)
    assert sorted(map(str, s)) == sorted(map(str, mixing.mix(docs, 16, 8)[1].collect()))
    # the slots fill the shards; what each takes is what its block holds
    assert sorted((r["shard"], r["place"]) for r in s) == [(k // 8, k % 8) for k in range(len(s))]
    held = {}
    for r in parts.collect():
        held.setdefault((r["source"], r["block"]), []).append((r["uid"], r["length"]))
    brute = {}
    for r in s:
        for uid, n in held[r["source"], r["block"]]:
            brute[uid] = brute.get(uid, 0) + n
    assert brute == taken
    assert mixing.mix(docs.limit(0))[0].count() == 0 and mixing.mix_documents(docs.limit(0)).count() == 0
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    original = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in mixed.collect():
        whole = iter(words(original[r["doc_id"]]))
        assert all(w in whole for w in words(r["text"]))  # the words in their order


def test_driver_holds_little_of_a_mix(spark, docs):
    """The last query of a mix only joins texts with their spans, and intermediate tables give back the driver's heap."""
    plan = mixing.mix_documents(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "Aggregate" not in plan
    jvm, mb = spark.sparkContext._jvm, 1 << 20
    heap, gateway = jvm.java.lang.Runtime.getRuntime(), spark.sparkContext._gateway
    held = []
    while 2 * heap.totalMemory() <= heap.maxMemory():
        held.append(gateway.new_array(jvm.byte, 64 * mb))
    del held
    gc.collect()
    common.durable(spark.range(1))
    assert 2 * heap.totalMemory() <= heap.maxMemory()


def test_driver_gives_back_its_heap_during_a_query(spark):
    """A heap that fills after the last intermediate table shrinks while a job runs."""
    jvm, held = spark.sparkContext._jvm, []
    heap, gateway = jvm.java.lang.Runtime.getRuntime(), spark.sparkContext._gateway
    common.durable(spark.range(1))
    while 3 * heap.totalMemory() <= heap.maxMemory():
        held.append(gateway.new_array(jvm.java.lang.Object, 16 << 20))
    del held
    gc.collect()
    job = threading.Thread(target=lambda: spark.sparkContext.parallelize([12], 1).foreach(time.sleep), daemon=True)
    job.start()
    while 3 * heap.totalMemory() > heap.maxMemory() and job.is_alive():
        time.sleep(0.2)
    shrunk = job.is_alive()
    job.join()
    assert shrunk


def test_shards_draw_their_sources(spark):
    """Counts over shards vary as multinomial ones do, and the repair leaves each source its slots."""
    goal = spark.createDataFrame([("a", 40_000, 60_000.0), ("b", 30_000, 20_000.0), (None, 10_000, 20_000.0), ("empty", 0, 0.0)], "source string, source_size long, target double")
    sources = mixing._sized(goal, 10)
    drawn = mixing.draw(sources, 100).groupBy("shard", "sid").count().toPandas().pivot(index="shard", columns="sid", values="count").fillna(0).to_numpy()
    assert drawn.sum(axis=1).tolist() == [100] * 100
    share = np.array([0.6, 0.2, 0.2])
    assert np.abs(drawn.mean(axis=0) / 100 - share).max() < 0.02 and np.abs(drawn.var(axis=0) / (100 * share * (1 - share)) - 1).max() < 0.5
    slots = mixing.plan_slots(goal, 10, 100).toPandas()
    assert slots.groupby("source", dropna=False)["j"].agg(lambda j: sorted(j) == list(range(len(j)))).all()
    assert slots["source"].fillna("-").value_counts().to_dict() == {"a": 6000, "b": 2000, "-": 2000}
    few = slots.assign(n=1).pivot_table(index="shard", columns=slots["source"].fillna("-"), values="n", aggfunc="sum").to_numpy()
    assert (few != drawn[:, [2, 0, 1]]).any(axis=1).mean() < 0.5  # most shards keep what they drew


def test_targets(spark):
    sizes = [("a", 100), ("b", 1000), ("c", 10), ("d", 400), (None, 300)]
    got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(sizes, "source string, source_size long")).collect()}
    weight = dict(zip(["a", "b", "c", "d", None], [5, 2, 1, 5, 2], strict=True))
    goal, full = {}, set()
    while True:
        rest = 1.5 * 1810 - sum(2 * s for k, s in sizes if k in full)
        goal = {k: 2 * s if k in full else rest * weight[k] / sum(weight[x] for x in weight if x not in full) for k, s in sizes}
        over = {k for k, s in sizes if goal[k] > 2 * s}
        if not over:
            break
        full |= over
    assert got == pytest.approx(goal)


def test_permutation(spark):
    for n in (1, 2, 7, 100):
        got = [r[0] for r in spark.range(n).select(mixing.permute(mixing.F.col("id"), mixing.F.lit(n).cast("long"), mixing.F.lit("k"))).collect()]
        assert sorted(got) == list(range(n)) and (n < 50 or got != list(range(n)))


def test_token_counts(spark, docs):
    vocabulary = token_counts.Vocabulary()
    encoding, size = token_counts._encoding(vocabulary.raw, vocabulary.pattern)
    got = token_counts.count(docs, spans=True).collect()
    assert len(got) == len(TEXTS) + 1
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in got:
        t = text[r["doc_id"]] or ""
        ids = encoding.encode_ordinary(t)
        lines = re.findall(r"[^\n]*\n|[^\n]+", t)
        own, want, p, crossing = [k for k, x in enumerate(lines) for _ in x.encode()], [0] * len(lines), 0, 0
        for i in ids:
            o = own[p : p + size[i]]
            want[max(sorted(set(o)), key=lambda k: (o.count(k), -k))] += 1
            crossing += len(set(o)) > 1
            p += size[i]
        assert list(r["tokens"]) == ids and list(r["section_tokens"]) == want and r["n_crossing"] == crossing and r["n_between"] == 0
        assert sum(want) == r["n_tokens"] == len(ids)


def test_given_sections(spark):
    rows = spark.createDataFrame([(1, "héllo wörld again", [(0, 5), (6, 9), (9, 12)]), (2, None, None)], "doc_id long, text string, parts array<struct<first: int, last: int>>")
    got = {r["doc_id"]: r for r in token_counts.count(rows, sections="parts").collect()}
    assert got[2]["n_tokens"] == 0 and got[2]["section_tokens"] == []
    assert sum(got[1]["section_tokens"]) + got[1]["n_between"] == got[1]["n_tokens"] and got[1]["n_sections"] == 3


def test_odd_sections(spark):
    """Null sections and bounds, sections out of order, overlapping and out of the text."""
    t = "héllo wörld again"
    parts = [(6, 12), None, (0, 8), (None, 3), (3, None), (9, 4), (-5, 2), (12, 99), (0, 0)]
    rows = spark.createDataFrame([(1, t, parts), (2, t, []), (3, "", [(0, 5)]), (4, t, None)], "doc_id long, text string, parts array<struct<first: int, last: int>>")
    got = {r["doc_id"]: r for r in token_counts.count(rows, sections="parts").collect()}
    n = got[2]["n_tokens"]
    # (-5, 2) begins first with (0, 8), which comes earlier and keeps all that they share; (6, 12) keeps 8 to 12
    held = [(8, 12), None, (0, 8), None, None, None, None, (12, 17), None]
    apart = spark.createDataFrame([(1, t, [p or (0, 0) for p in sorted(filter(None, held))])], rows.schema)
    plain = token_counts.count(apart, sections="parts").first()["section_tokens"]
    assert [got[1]["section_tokens"][k] for k in (2, 0, 7)] == plain and sum(got[1]["section_tokens"]) == sum(plain) == n and got[1]["n_sections"] == 9
    assert got[3]["section_tokens"] == [0] and got[4]["n_sections"] == 0 and got[2]["n_between"] == got[4]["n_between"] == n


def test_attribution_rules():
    end, s, e = np.array([2, 6, 8]), np.array([0, 3, 5]), np.array([3, 5, 8])
    assert token_counts.attribute(end, s, e, "most")[0].tolist() == [0, 1, 2]
    assert token_counts.attribute(end, s, e, "first")[0].tolist() == [0, 0, 2]


@pytest.fixture(scope="module")
def model():
    with open(pieces.model_path(), "rb") as f:
        return f.read()


def _encode(p, texts):
    encoder, out = pieces.Encoder(p), []
    for part in textarrays.chunks(pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["t"]), "t", 4000):
        ids, offsets, _, _ = encoder.encode(part.column("t"))
        out += [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:], strict=False)]
    return out


def test_pieces_equal_the_library(model):
    import sentencepiece

    rng = random.Random(4)
    letters = "ab  \n\tthe é漢字🎉▁x., \r1234<s>"
    texts = [*TEXTS, *("".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(500))]
    texts += [r[0] for r in duckdb.sql(f"select text from read_parquet('{SF}/documents.parquet') limit 60").fetchall()]
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    assert _encode(pieces.Pieces(model), texts) == [library.encode(t or "") for t in texts]


def test_viterbi_equals_the_library(model):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.ParseFromString(model)
    m.trainer_spec.model_type = 1
    for p in m.pieces:
        p.score = max(p.score, -40000.0)  # single precision holds the sums of such scores
    library = sentencepiece.SentencePieceProcessor(model_proto=m.SerializeToString())
    lines = [x for r in duckdb.sql(f"select text from read_parquet('{SF}/documents.parquet') limit 40").fetchall() for x in r[0].split("\n")]
    assert _encode(pieces.Pieces(m.SerializeToString()), lines) == [library.encode(t) for t in lines]


def test_pieces_round_trip(spark, docs):
    coded = pieces.encode(docs)
    rows = pieces.decode_tokens(coded).collect()
    assert len(rows) == len(TEXTS) + 1 and all(r["round_trip"] and r["decoded"] == (r["text"] or "") and r["n_tokens"] == len(r["tokens"]) for r in rows)
    assert pieces.encode(docs.limit(0)).count() == 0
