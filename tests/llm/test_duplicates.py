"""Near-duplicates of texts and vectors against brute force; components; the pipeline."""

import random
import re

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from marigraph.llm import embeddings, minhash, registry
from marigraph.llm.components import components

SF = "/root/testdata/sf0.001"


def groups(n, edges):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 140)] + [(rng.randrange(100), rng.randrange(100)) for _ in range(70)]
    want = groups(141, edges)
    got = {r["v"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: want[v] for v in {x for e in edges if e[0] != e[1] for x in e}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def sets(t, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


@pytest.mark.parametrize("config", [minhash.CONTRACT, minhash.Config(), minhash.Config(words=3, percent=85, short=4, k=64, dense=0)])
def test_texts(spark, config):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(3000)]
    base = [rng.choice(vocabulary) for _ in range(220)]
    common = " ".join(rng.choice(vocabulary) for _ in range(60))
    texts = [None, "", "one", "ONE", "one two", "  "]
    for size in (0.0, 0.01, 0.02, 0.03, 0.05):  # one group of near copies around a text
        for _ in range(14):
            texts.append(" ".join(rng.choice(vocabulary) if rng.random() < size else w for w in base))
    for _ in range(50):  # unlike texts that share a passage
        texts.append(common + " " + " ".join(rng.choice(vocabulary) for _ in range(rng.choice([5, 40, 150]))))
    texts += [texts[20]] * 5 + [" ".join(base[:200]), " ".join(base[:180])]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)]
    own = [sets(t, config.words) for t in texts]
    edges = [(i, j) for i in range(len(own)) for j in range(i) if own[i] and own[j] and 100 * len(own[i] & own[j]) >= config.percent * len(own[i] | own[j])]
    want = groups(len(own), edges)
    got = {r["doc_id"]: r for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fp string, v int"), config).collect()}
    assert {i: got[i]["component_id"] for i in got} == dict(enumerate(want))
    assert {i: got[i]["n_shingles"] for i in got} == {i: len(s) for i, s in enumerate(own)}
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got.values())


def test_extracts_at_the_threshold(spark):
    config, fresh = minhash.CONTRACT, iter(range(10**7))
    words = lambda n: [f"w{next(fresh)}" for _ in range(n)]
    texts = []
    for size in list(range(150, 260, 2)):  # isolated pairs: a text and an extract
        base = words(size + 2)
        texts += [base, base[: -(-85 * size // 100) + 2]]
    for size in (700, 850):  # many texts that are alike only through the one they all extend
        base = words(size + 2)
        texts += [base] + [base + words(size * 100 // 85 - size) for _ in range(40)]
    own = [sets(" ".join(t), config.words) for t in texts]
    edges = [(i, j) for i in range(len(own)) for j in range(max(0, i - 41), i) if 100 * len(own[i] & own[j]) >= config.percent * len(own[i] | own[j])]
    want = groups(len(own), edges)
    assert len(set(want)) == 55 + 2
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), config).collect()}
    assert got == dict(enumerate(want))


def test_texts_odd_rows(spark):
    rows = spark.createDataFrame([(None, "a b c d"), (3, "a b c d"), (3, "a b c d"), (None, "other words here"), (5, None)], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(rows).collect()), key=str)
    assert got == sorted([(None, 3, False), (3, 3, True), (3, 3, True), (None, None, True), (5, 5, True)], key=str)
    assert minhash.near_duplicates(rows.limit(0)).count() == 0
    assert minhash.keep_one(rows).columns == rows.columns


def test_ids_of_any_type(spark):
    rows = [("b", "a b c d e f"), ("a", "a b c d e f"), (None, "a b c d e f"), ("z", None), ("z", ""), ("y", "other words")]
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id string, text string")).collect()), key=str)
    assert got == sorted([("b", "a", False), ("a", "a", True), (None, "a", False), ("z", "z", True), ("z", "z", True), ("y", "y", True)], key=str)
    small = minhash.near_duplicates(spark.createDataFrame([(1, "x y"), (2, "x y")], "doc_id int, text string"))
    assert sorted(map(tuple, small.collect())) == [(1, 1, 1, True), (2, 1, 1, False)] and dict(small.dtypes)["component_id"] == "int"


def test_pages_of_one_template(spark):
    """Unlike pages that share most words: links among them are found without comparing all with all."""
    rng = random.Random(3)
    template, texts = [f"t{i}" for i in range(85)], []
    for i in range(700):
        texts.append(template + (texts[-1][85:] + ["x"] if i % 100 == 7 else [f"o{rng.randrange(10**9)}" for _ in range(12)]))
    texts += [template[:70] + [f"o{rng.randrange(10**9)}" for _ in range(k)] for k in (5, 20, 40)]
    want = [i - 1 if i % 100 == 7 and i < 700 else i for i in range(len(texts))]
    d = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(d, minhash.Config(words=3, percent=85, dense=1000)).collect()}
    assert got == dict(enumerate(want))


def test_one_row_of_each_group_stays(spark):
    near = " ".join(f"w{i}" for i in range(200))
    rows = [(None, near, 1), (9, near + " x", 2), (None, near, 3), (7, "a b c d e f", 4), (7, "a b c d e f", 5), (8, near, 6), (8, "clean words of its own here", 7)]
    rows += [(None, "only without an id here", 8), (None, "only without an id here", 9), (None, None, 10), (None, "", 11), (4, None, 12), (4, None, 13)]
    for part in (1, 3):
        got = minhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, uid int").repartition(part, "uid")).collect()
        kept = sorted(r["uid"] for r in got)
        assert [x for x in kept if x not in (4, 5, 8, 9)] == [6, 7, 10, 11, 12, 13]
        assert len({4, 5} & set(kept)) == len({8, 9} & set(kept)) == 1


def test_vectors(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 24))
    for i in range(120, 200):
        x[i] = x[i - 120] + rng.normal(size=24) * rng.choice([0.02, 0.2, 0.3])
    x[200:290] = x[0] + rng.normal(size=(90, 24)) * 0.05  # a dense group
    x[290:295] = x[1]
    rows = [(i, v.tolist(), int(i % 3)) for i, v in enumerate(x)]
    rows += [(400, None, 1), (401, [0.0] * 24, 1), (402, [float("nan")] * 24, 1), (403, x[0].tolist(), None), (404, [], 1), (405, [None] + [1.0] * 23, 1), (406, [1.0, 2.0], 1), (407, [2.0, 4.0], 1), (408, [1e200, 2e200], 1)]
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    edges = [(i, j) for i in range(400) for j in range(i) if i % 3 == j % 3 and unit[i] @ unit[j] >= 0.93] + [(406, 407), (406, 408), (407, 408)]
    want, n = groups(409, edges), np.zeros(409, int)
    for a, b in edges:
        n[a] += 1
        n[b] += 1
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    for block in (256, 8):
        got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_duplicates(d, embeddings.Config(block=block)).collect()}
        assert got == {i: (n[i], want[i], want[i] == i) for i in range(409)}
    assert embeddings.near_duplicates(d.limit(0)).count() == 0


def test_one_vector_held_many_times(spark):
    rows = [(i, [1.0, 2.0, 0.5], "a" if i % 2 else "b") for i in range(20_000)] + [(20_000, [1.0, 2.0, 0.6], "a"), (20_001, [-1.0, 2.0, 0.6], "a")]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string"))
    count = {(r["component_id"], r["n_links"]): r["count"] for r in got.groupBy("component_id", "n_links").count().collect()}
    assert count == {(1, 10_000): 10_001, (0, 9_999): 10_000, (20_001, 0): 1}


def test_recall_at_the_threshold():
    rng = np.random.default_rng(1)
    x, z = rng.normal(size=(5000, 64)), rng.normal(size=(5000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    z -= (z * x).sum(1)[:, None] * x
    z /= np.linalg.norm(z, axis=1)[:, None]
    config = embeddings.Config()
    a, p = embeddings.codes(x, config)
    b, q = embeddings.codes(0.93 * x + np.sqrt(1 - 0.93**2) * z, config)
    met = ((p == b[:, :, None]) | (q == a[:, :, None])).any(axis=2)
    assert met.any(axis=1).mean() > 0.999


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(registry.oracle_sql()[name]).fetchdf()
    got = registry.queries()[name](spark, SF).toPandas()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    rows = lambda d: sorted(map(tuple, d[cols].astype(str).values))
    assert rows(got) == rows(want)


def test_pipeline_on_odd_tables(spark, tmp_path):
    """Null and repeated doc_ids, null and empty and very long texts, clashing columns; empty tables."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = [(i, " ".join(word() for _ in range(60)), "en", "s", 1, "x", 1, 0.5) for i in range(60)]
    rows += [(0, rows[0][1], "en", "s", 1, "x", 1, 0.5), (None, rows[1][1], None, None, None, None, None, None), (61, None, "en", "t", 0, "x", 1, 0.5), (62, "", "en", "t", 0, "x", 1, 0.5), (63, "long words " * 20_000, "en", "t", 0, "x", 1, 0.5)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, tokens string, uid long, _score double"
    for name, own in (("full", rows), ("empty", [])):
        spark.createDataFrame(own, schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(i, 1, int(i % 9 == 0)) for i in range(len(own))], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}")
        assert set(out.columns) == {"doc_id", "text", "lang", "source", "n_chars", "uid", "_score", "tokens", "n_tokens", "n_bytes_spelled", "round_trip"}
        assert dict(out.dtypes)["tokens"] == "array<int>" and (out.count() > 0) == bool(own)


def test_pipeline(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "quality classifier", "MinHash near-dedup", "mixing sources", "SentencePiece"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    out = corpus_pipeline.run(spark, SF)
    assert set(docs.columns) < set(out.columns) and out.count() > 0 and out.where("not round_trip").count() == 0
