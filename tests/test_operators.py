import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tamarack.functions.text import STOPWORDS
from tamarack.operators import hybrid, keyword, merge, search

DIM = 8


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((300, DIM))
    x[7] = x[11]  # a tie
    rows = [(i, x[i].tolist(), "a" if i % 3 else "b") for i in range(300)]
    return x / np.linalg.norm(x, axis=1, keepdims=True), spark.createDataFrame(rows, "id long, values array<double>, lang string").cache()


def nearest(x, q, k, keep=lambda i: True):
    scores = x @ (q / np.linalg.norm(q))
    return [i for i in sorted(range(len(x)), key=lambda i: (-round(scores[i], 9), i)) if keep(i)][:k]


def test_knn_of_brute_force_and_ties(vectors):
    x, rows = vectors
    assert [r.id for r in search.knn(rows, x[11].tolist(), 5).collect()] == nearest(x, x[11], 5)
    assert search.knn(rows, x[0].tolist(), 0).count() == 0


def test_filters_before_and_after(vectors):
    x, rows = vectors
    pre = [r.id for r in search.knn(rows, x[1].tolist(), 8, F.col("lang") == "b").collect()]
    assert pre == nearest(x, x[1], 8, lambda i: i % 3 == 0)
    post = [r.id for r in search.knn(rows, x[1].tolist(), 8, F.col("lang") == "b", "post").collect()]
    assert post == [i for i in nearest(x, x[1], 32) if i % 3 == 0][:8]


@pytest.mark.parametrize("size", [None, 2000])
def test_batch_in_one_or_several_slices(spark, vectors, monkeypatch, size):
    x, rows = vectors
    if size:
        monkeypatch.setattr(search, "QUERY_BYTES", size)
    queries = rows.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("values").alias("vector"))
    got = search.knn_batch(rows, queries, 4).collect()
    for q in range(0, 300, 20):
        assert [r.id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == nearest(x, x[q], 4)
    assert search.knn_batch(rows, queries.where("false"), 4).count() == 0


def test_quantised_recall(vectors):
    x, rows = vectors
    hits = [len({r.id for r in search.knn_quantized(rows, x[i].tolist(), 10).collect()} & set(nearest(x, x[i], 10))) for i in range(0, 60, 20)]
    assert sum(hits) / (10 * len(hits)) >= 0.95


@pytest.mark.parametrize("bits", [1, 4])
def test_quantised_batch_is_the_single_search(vectors, bits):
    _, rows = vectors
    queries = rows.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("values").alias("vector"))
    got = search.knn_quantized_batch(rows, queries, 10, bits).collect()
    for q in queries.collect():
        want = [r.id for r in search.knn_quantized(rows, q.vector, 10, bits).collect()]
        assert [r.id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q.query_id] == want
    truth = search.knn_batch(rows, queries, 10)
    shares = [r.recall for r in search.recall(search.knn_quantized_batch(rows, queries, 10, bits), truth, ["query_id"]).collect()]
    assert len(shares) == 3 and (min(shares) >= 0.9 if bits == 4 else min(shares) < 1)


def test_quantised_codes(spark):
    r = search.quantize(spark.createDataFrame([(1, [3.0, 4.0, 0.0])], "id int, values array<double>"), 2).first()
    assert list(r.codes) == [2, 3, 0]


TEXTS = {1: "contrat de bail commercial", 2: "clause de non-concurrence du contrat contrat", 3: "", 4: "bail bail bail", 5: None, 6: "rien"}


def score(query, texts=TEXTS, k1=1.5, b=0.75):
    def toks(t):
        return [w for w in "".join(c if "a" <= c <= "z" else " " for c in (t or "").lower()).split() if len(w) > 1 and w not in STOPWORDS]

    docs = {i: Counter(toks(t)) for i, t in texts.items()}
    n, avg = len(docs), sum(sum(d.values()) for d in docs.values()) / len(docs)
    out = {}
    for t in toks(query):
        df = sum(t in d for d in docs.values())
        for i, d in docs.items():
            if t in d:
                tf = d[t]
                out[i] = out.get(i, 0) + math.log((n - df + 0.5) / (df + 0.5) + 1) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * sum(d.values()) / avg))
    return out


@pytest.mark.parametrize("query", ["contrat bail", "bail bail contrat", "concurrence", "de la", "inconnu", ""])
def test_bm25_of_the_formula(spark, query):
    docs = keyword.documents(spark.createDataFrame(list(TEXTS.items()), "id int, text string"))
    got = {r.id: r.score for r in keyword.bm25(docs, query).collect()}
    assert got == pytest.approx(score(query))


def test_bm25_restricted_keeps_the_statistics(spark):
    docs = keyword.documents(spark.createDataFrame(list(TEXTS.items()), "id int, text string"))
    got = {r.id: r.score for r in keyword.bm25(docs, "contrat bail", only=docs.where("id = 2")).collect()}
    assert got == pytest.approx({2: score("contrat bail")[2]})


def test_bm25_by_index(spark):
    rows = [(i, "x" if i < 4 else "y", t) for i, t in TEXTS.items()]
    docs = keyword.documents(spark.createDataFrame(rows, "id int, index_name string, text string"), carry=["index_name"])
    queries = spark.createDataFrame([(1, "x", "contrat bail"), (2, "y", "bail"), (3, "z", "bail"), (4, "x", None)], "query_id int, index_name string, text string")
    got = {(r.query_id, r.id): r.score for r in keyword.bm25_batch(docs, queries, by="index_name").collect()}
    first = score("contrat bail", {i: t for i, t in TEXTS.items() if i < 4})
    second = score("bail", {i: t for i, t in TEXTS.items() if i >= 4})
    assert got == pytest.approx({(1, i): s for i, s in first.items()} | {(2, i): s for i, s in second.items()})


def test_minmax(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 4.0), (3, 3.0)], "id int, score double")
    assert [r.normalized for r in hybrid.minmax(df).orderBy("id").collect()] == [0, 1, 0.5]
    assert [r.normalized for r in hybrid.minmax(df.withColumn("score", F.lit(7.0))).collect()] == [1, 1, 1]
    assert hybrid.minmax(df.where("false")).count() == 0


@pytest.mark.parametrize("alpha", [0.0, 0.4, 1.0])
def test_hybrid_of_brute_force(spark, alpha):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((6, 3))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, x[i - 1].tolist(), t) for i, t in TEXTS.items()], "id int, values array<double>, text string")
    q = x[0]
    vs = {i: float(x[i - 1] @ q) for i in TEXTS}
    bs = score("bail contrat")

    def norm(d):
        lo, hi = min(d.values()), max(d.values())
        return {k: 1.0 if hi - lo < 1e-9 else (v - lo) / (hi - lo) for k, v in d.items()}

    v, b = norm(vs), norm(bs)
    want = sorted(((alpha * v[i] + (1 - alpha) * b.get(i, 0.0), i) for i in TEXTS), key=lambda s: (-s[0], s[1]))
    got = hybrid.hybrid(rows, keyword.documents(rows), q.tolist(), "bail contrat", 4, alpha).collect()
    assert [r.score for r in got] == pytest.approx([s for s, _ in want[:4]], abs=1e-6)
    only = hybrid.hybrid(rows, keyword.documents(rows), q.tolist(), "bail contrat", 4, alpha, F.col("id") > 2).collect()
    assert [r.score for r in only] == pytest.approx([s for s, i in want if i > 2][:4], abs=1e-6)
    with pytest.raises(ValueError):
        hybrid.hybrid(rows, keyword.documents(rows), q.tolist(), "", 4)


def test_upsert_and_delete(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, "c", "x")], "seq int, id string, v string")
    new = spark.createDataFrame([(4, "b", "y"), (5, "d", "y"), (6, "b", "z")], "seq int, id string, v string")
    assert {(r.id, r.v) for r in merge.upsert(old, new).collect()} == {("a", "x"), ("b", "z"), ("c", "x"), ("d", "y")}
    assert {r.id for r in merge.delete(old, new.select("id")).collect()} == {"a", "c"}
    assert {r.id for r in merge.delete(old, where=F.col("v") == F.lit(None)).collect()} == {"a", "b", "c"}
    assert merge.upsert(old, new.where("false")).count() == 3


def test_recall(spark):
    truth = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "q int, id string")
    found = spark.createDataFrame([(1, "a"), (1, "x")], "q int, id string")
    assert {(r.q, r.recall) for r in search.recall(found, truth, ["q"]).collect()} == {(1, 0.5), (2, 0.0)}
