import json
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tamarack.llm import common, knn, rank, split

VECTORS = "seq long, index_name string, id string, vector array<float>, metadata string, extra string"


def brute(rows, k=5):
    """Neighbours by cosine to 12 decimals, then the smaller id."""
    out = {}
    for name in {r[0] for r in rows}:
        part = sorted((r for r in rows if r[0] == name), key=lambda r: r[1])
        x = np.array([r[2] for r in part], float)
        x = np.array([np.float32(v) for v in x], float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        s = np.round(x @ x.T, 12)
        for i, r in enumerate(part):
            order = sorted((j for j in range(len(part)) if j != i), key=lambda j: (-s[i, j], part[j][1]))
            out[r[1]] = [part[j][1] for j in order[:k]]
    return out


def clustered(n, dim=64, seed=1, name="x"):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((max(1, n // 12), dim))
    return [(name, f"{name}{i:05d}", (centres[i % len(centres)] + 0.15 * rng.standard_normal(dim)).astype(np.float32).tolist()) for i in range(n)]


def found(spark, rows, **options):
    df = spark.createDataFrame(rows, "index_name string, id string, vector array<float>")
    got = {}
    for r in sorted(knn.nearest(df, **options).collect(), key=lambda r: (-round(r.cosine, 12), r.other)):
        got.setdefault(r.id, []).append(r.other)
    return got


def share(got, want):
    return sum(len(set(got.get(i, [])) & set(w)) for i, w in want.items()) / sum(map(len, want.values()))


def test_recall_in_small_and_large_indexes(spark):
    rows = clustered(900) + clustered(40, seed=2, name="y") + [("z", "alone", [1.0] * 64)]
    want = brute(rows)
    assert share(found(spark, rows), want) >= 0.97
    routed = found(spark, rows, block=200)
    assert share(routed, want) >= 0.9
    assert all(len(v) <= 5 and i not in v for i, v in routed.items()) and "alone" not in routed


def test_equal_vectors_in_a_large_index(spark):
    same = [0.5] * 64
    rows = clustered(150) + [("x", f"copy{i:03d}", [v * (1 + i % 2) for v in same]) for i in range(120)]
    for block in (knn.BLOCK, 100):
        got = found(spark, rows, block=block)
        assert got["copy119"] == [f"copy{i:03d}" for i in range(5)]
        assert got["copy002"] == ["copy000", "copy001", "copy003", "copy004", "copy005"]


def test_usable_and_live(spark):
    v = [1.0] + [0.0] * 63
    rows = [
        (1, "x", "a", v, None, ""), (2, "x", "a", None, None, ""), (3, "x", "b", v, "{}", ""), (4, "x", "c", [0.0] * 64, "", ""), (5, "x", "d", [float("nan")] + v[1:], "", ""),
        (6, "x", "e", v[:32], "", ""), (7, None, "f", v, "", ""), (None, "x", "g", v, "", ""), (8, "x", None, v, "", ""), (9, "x", "h", [float("inf")] + v[1:], "", ""), (10, "x", "i", v, "", ""), (10, "x", "i", v, "", ""), (11, "x", "j", [None] + v[1:], "", ""),
    ]
    df = spark.createDataFrame(rows, VECTORS)
    assert sorted(r.id for r in knn.usable(df).collect()) == ["b", "i"]
    pairs = knn.neighbour_pairs(knn.nearest(knn.usable(df)))
    assert [tuple(r) for r in pairs.collect()] == [("b", "i")]
    assert knn.nearest(knn.usable(df.where("false"))).count() == 0


def test_perturbations_exclude_opposite_walls():
    for k in (4, 7, 10):
        sets = knn.perturbations(k, 24)
        assert len(set(sets)) == 24 and sets[0] == (0,)
        assert not any(2 * k - 1 - r in s for s in sets for r in s)


def test_probes_are_keys_of_neighbouring_buckets():
    rng = np.random.default_rng(3)
    t = knn.Table(8, 5, 1.0, 10, 1)
    x = rng.standard_normal((4, 8)).astype(np.float32)
    cell = np.floor((x @ t.a + t.b) / t.width).astype(np.int64)
    probes = t.probes(x)
    for i in range(4):
        near = {int(((cell[i] + np.array(d)).view(np.uint64) * t.mix).sum(dtype=np.uint64)) for d in np.ndindex(*[3] * 5) for d in [np.array(d) - 1]}
        assert {int(p) for p in probes[i]} <= near and len(set(probes[i].tolist())) == 11


def test_live_texts(spark):
    rows = [(1, "a", '{"text": "old"}'), (2, "a", '{"text": "new", "lang": "fr"}'), (3, "b", '{"text": 1}'), (4, "c", '{"text": null}'), (5, "d", "{}"), (6, "e", "nonsense"), (7, "f", None), (8, "g", '["text"]'), (9, "h", '{"text": ""}'), (10, "i", '{"text": "\\u00e9\\n"}')]
    df = spark.createDataFrame(rows, "seq long, id string, metadata string")
    got = {r.id: (r.text, r.label) for r in common.live_texts(df, common.string_field("metadata", "lang").alias("label")).collect()}
    assert got == {"a": ("new", "fr"), "h": ("", None), "i": ("é\n", None)}


def test_plain_tokens():
    assert common.plain_tokens("Ça ﬁt Straße 2a é") == ["ca", "fit", "stra", "e", "a", "e"]
    assert common.plain_tokens("a1 B-2", digits=True) == ["a1", "b", "2"]


WORDS = st.lists(st.sampled_from(["a", "b,", "c.", "d;", "e\n\n", "f\n", "g!", "—"]), min_size=0, max_size=90)


@settings(max_examples=120, deadline=None)
@given(WORDS, st.integers(2, 20), st.integers(0, 12))
def test_pieces_cover_the_words(words, most, overlap):
    text = " ".join(words)
    every = text.split()
    parts = split.cut(text, most, overlap)
    shared = max(0, min(overlap, most - 1))
    assert [len(text[a:b].split()) for a, b, _, _ in parts] == [n for _, _, n, _ in parts]
    assert all(n <= most for _, _, n, _ in parts)
    pieces = [text[a:b].split() for a, b, _, _ in parts]
    assert (pieces[0] + [w for p in pieces[1:] for w in p[shared:]] if pieces else []) == every
    for a, b in zip(pieces, pieces[1:]):
        assert a[len(a) - shared :] == b[:shared]


def test_cuts_at_the_strongest_boundary():
    text = "one two three. four five, six\n\nseven eight nine. ten eleven twelve thirteen"
    a = split.cut(text, 8, 2)
    assert text[a[0][0] : a[0][1]].endswith("six") and a[0][3] == 5
    assert text[a[1][0] :].startswith("five, six\n\nseven")
    assert split.cut("w " * 10, 4, 1)[0][2] == 4  # no boundary: the last place
    with pytest.raises(ValueError):
        split.cut("a", 0)


def test_range_maximum_takes_the_last_of_equals():
    rng = random.Random(1)
    values = [rng.randrange(4) for _ in range(70)]
    query = split.RangeMaximum(np.array(values))
    for lo in range(70):
        for hi in range(lo + 1, 71):
            assert query(lo, hi) == max(range(lo, hi), key=lambda i: (values[i], i))


def test_pieces_of_rows(spark):
    rows = [("a", " ".join(f"w{i}." for i in range(900)), 1), ("b", None, 2), ("c", "", 3), ("d", "short text", 4), ("e", "x" * 100_000, 5), ("f", " ".join(["y"] * 401), 6)]
    df = spark.createDataFrame(rows, "id string, text string, piece int")
    got = split.pieces(df).collect()
    assert {(r.id, r.piece) for r in got} == {("a", 0), ("a", 1), ("a", 2), ("f", 0), ("f", 1)} and all(r.n_words <= 400 for r in got)
    assert split.pieces(df.where("false")).count() == 0


def shares(scores, items):
    """Share of the other items that an item beats in one channel, ties half."""
    out = {}
    for i in items:
        if i not in scores:
            out[i] = 0.0
            continue
        below = sum(j not in scores or scores[j] < scores[i] for j in items if j != i)
        ties = sum(j in scores and scores[j] == scores[i] for j in items if j != i)
        out[i] = (below + ties / 2) / max(1, len(items) - 1)
    return out


def best_first(scores, weight):
    """Items, best first, by the definition: weakest percentile first, weights as exponents."""
    items = sorted({i for d in scores.values() for i in d})
    p = {c: shares(scores.get(c, {}), items) for c in weight}
    top = max(weight.values())
    own = {i: sorted(round(p[c][i] ** (weight[c] / top), 9) for c in weight) for i in items}
    return sorted(items, key=lambda i: ([-v for v in own[i]], i))


@pytest.mark.parametrize("block", [rank.BLOCK, 5])
def test_ranking_of_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(rank.leximin, "__defaults__", ("id", block))
    rng = random.Random(4)
    requests, matches, want = [], [], []
    for q in range(30):
        alpha = rng.choice([None, 0.0, 0.3, 1.0])
        requests.append((q, True, alpha, "x"))
        scores = {c: {f"i{j}": round(rng.gauss(0, s), 1) for j in range(30 if q == 3 else 8 if q % 4 else 2) if rng.random() < 0.7} for c, s in (("vector", 1), ("bm25", 30), ("rerank", 5))}
        for c, d in scores.items():
            matches += [(q, c, i, s, None) for i, s in d.items()]
        matches += matches[-2:]
        a = 0.5 if alpha is None else alpha
        weight = {"vector": a, "bm25": (1 - a) / 2, "rerank": (1 - a) / 2}
        want += [(q, i, n + 1) for n, i in enumerate(best_first(scores, weight))]
    requests += [(100, False, 0.5, "x"), (101, True, float("nan"), "x"), (102, True, -0.1, "x"), (103, None, 0.5, "x"), (104, True, 0.5, "no items")]
    matches += [(q, "vector", "i1", 1.0, None) for q in (100, 101, 102, 103)] + [(0, "vector", "bad", float("nan"), None), (0, "bm25", "bad2", None, None), (0, "other", "bad3", 1.0, None), (0, "bm25", None, 1.0, None), (None, "bm25", "i", 1.0, None)]
    r = spark.createDataFrame(requests, "query_id long, hybrid boolean, alpha double, id string")
    m = spark.createDataFrame(matches, "query_id long, channel string, id string, score double, alpha double")
    got = [(x.query_id, x.id, x["rank"]) for x in rank.request_ranking(r, m).collect()]
    assert sorted(got) == sorted(want)
    assert rank.request_ranking(r, m.where("false")).count() == 0


def test_the_weakest_channel_decides_not_the_mean(spark):
    """The item that leads by the mean of its percentiles has one weak channel; leximin gives the even one."""
    scores = {"vector": {"strong": 9, "even": 7, "c": 5, "d": 3, "e": 1}, "bm25": {"strong": 90, "even": 70, "c": 50, "d": 30, "e": 10}, "rerank": {"strong": 0.3, "even": 0.5, "c": 0.9, "d": 0.7, "e": 0.1}}
    p = {c: shares(scores[c], sorted(scores["vector"])) for c in scores}
    mean = {i: sum(p[c][i] for c in scores) / 3 for i in scores["vector"]}
    assert max(mean, key=mean.get) == "strong"
    rows = [(1, c, i, float(s)) for c, d in scores.items() for i, s in d.items()]
    df = spark.createDataFrame(rows, "q int, channel string, id string, score double")
    best = rank.leximin(df, {c: F.lit(1 / 3) for c in scores}, ["q"]).where("rank = 1").first()
    assert best.id == "even" and best.lexi == [0.5, 0.75, 0.75]
    # a weight of 0 takes the weak channel away
    best = rank.leximin(df, {"vector": F.lit(0.5), "bm25": F.lit(0.5), "rerank": F.lit(0.0)}, ["q"]).where("rank = 1").first()
    assert best.id == "strong"


def test_no_channel_wins_by_its_range(spark):
    rows = [("vector", "a", 0.9), ("vector", "b", 0.8), ("vector", "c", 0.1), ("bm25", "a", 10.0), ("bm25", "b", 9.0), ("bm25", "c", 1e6)]
    df = spark.createDataFrame([(1, *r) for r in rows], "q int, channel string, id string, score double")
    best = rank.leximin(df, {"vector": F.lit(0.5), "bm25": F.lit(0.5)}, ["q"]).where("rank = 1").first()
    assert best.id == "a" and list(best.lexi) == [0.5, 1.0]
    plan = rank.leximin(df, {"vector": F.lit(0.5), "bm25": F.lit(0.5)}, ["q"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 5
