import json
import math
import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tamarack.functions import filters, text, vector
from tamarack.sources.ingest import cut


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")


def plain(s):
    return "".join(c for c in unicodedata.normalize("NFKD", s.lower()) if not unicodedata.combining(c))


def test_tokens_follow_the_rules(spark):
    texts = ["Généralités du contrat", "cœur non-concurrence", "être été TRÈS à où", "x 1a2b", None, "", "étude"]
    got = [r.t for r in column(spark, texts).select(text.tokens(F.col("x")).alias("t"), "i").orderBy("i").collect()]
    assert got == [["generalites", "contrat"], ["ur", "non", "concurrence"], ["etre", "ete", "tres"], [], [], [], ["etude"]]


def test_exact_fold_takes_ligatures_apart(spark):
    got = [r.t for r in column(spark, ["ﬁche", "Ａ"]).select(text.tokens(F.concat("x", F.lit("e")), exact=True).alias("t"), "i").orderBy("i").collect()]
    assert got == [["fichee"], ["ae"]]


def test_fold_is_nfkd_without_marks(spark):
    texts = ["ÀÉÎõü ñ Ç", "Straße", "Ωμέγα", "áb"]
    native = [r.t for r in column(spark, texts).select(text.fold(F.col("x")).alias("t"), "i").orderBy("i").collect()]
    assert [n for n in native[:2]] == [plain(t) for t in texts[:2]]
    exact = [r.t for r in column(spark, texts).select(text.fold_exact(F.col("x")).alias("t"), "i").orderBy("i").collect()]
    assert exact == [plain(t) for t in texts]


def test_words_split_where_python_splits(spark):
    spaces = [chr(c) for c in range(0x3001) if chr(c).isspace()] + ["​", "﻿"]
    texts = [f"a{s}b" for s in spaces]
    got = [list(r.w) for r in column(spark, texts).select(text.words(F.col("x")).alias("w"), "i").orderBy("i").collect()]
    assert got == [t.split() for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 60), st.integers(1, 12), st.integers(-2, 15))
def test_cut_covers_all_words_with_the_overlap(n, most, overlap):
    words = [str(i) for i in range(n)]
    parts = [p.split() for p in cut(" ".join(words), most, overlap)]
    shared = max(0, min(overlap, most - 1))
    assert all(1 <= len(p) <= most for p in parts)
    assert (parts[0] + [w for p in parts[1:] for w in p[shared:]] if parts else []) == words
    assert all(a[-shared:] == b[:shared] for a, b in zip(parts, parts[1:]) if shared)


def test_chunks_equal_the_driver_form(spark):
    texts = [" ".join(map(str, range(n))) for n in (0, 1, 4, 5, 10, 23)] + [None, "  \t"]
    got = [list(r.c) for r in column(spark, texts).select(text.chunks(F.col("x"), 4, 1).alias("c"), "i").orderBy("i").collect()]
    assert got == [cut(t or "", 4, 1) for t in texts]
    assert got[4] == ["0 1 2 3", "3 4 5 6", "6 7 8 9"]
    with pytest.raises(ValueError):
        text.chunks(F.col("x"), 0)


def test_normalise(spark):
    df = column(spark, [[3.0, 4.0], [0.0, 0.0]], "array<double>")
    store = [r.v for r in df.select(vector.l2_normalize(F.col("x")).alias("v"), "i").orderBy("i").collect()]
    embed = [r.v for r in df.select(vector.l2_normalize(F.col("x"), "embed").alias("v"), "i").orderBy("i").collect()]
    assert store[0] == pytest.approx([0.6, 0.8], abs=1e-6) and store[1] == [0, 0]
    assert embed[0] == pytest.approx([0.6, 0.8], abs=1e-12) and embed[1] == [0, 0]


CASES = [1, 1.0, True, "1", None, [1, 2], {"a": 1}, 0, False, "", 2.5, "x"]


@pytest.mark.parametrize("value", [1, "1", True, None, 2.5, [1, "x"], [[1, 2]], [None, 2.5], [], {"a": 1}, 0])
def test_filter_has_python_equality(spark, value):
    metas = [json.dumps({"k": c}) for c in CASES] + ["{}", '{"other": 1}']
    got = [r.i for r in column(spark, metas).where(filters.compile_filter({"k": value}, "x")).orderBy("i").collect()]

    def holds(meta):
        actual = json.loads(meta).get("k")
        return actual in value if isinstance(value, list) else actual == value

    assert got == [i for i, m in enumerate(metas) if holds(m)]


def test_filter_conjunction_dotted_keys_and_bad_json(spark):
    metas = ['{"a.b": 1, "c": "x"}', '{"a.b": 1, "c": "y"}', "not json", None]
    df = column(spark, metas)
    assert [r.i for r in df.where(filters.compile_filter({"a.b": 1, "c": "x"}, "x")).collect()] == [0]
    assert df.where(filters.compile_filter({}, "x")).count() == 4
    assert df.where(filters.compile_filter(None, "x")).count() == 4


def test_typed_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(10).selectExpr("id", "if(id % 2 = 0, 'a', null) as lang").write.parquet(path)
    df = spark.read.parquet(path).where(filters.compile_filter({"lang": ["a", "b"]}, typed={"lang": "lang"}))
    assert df.count() == 5
    assert "PushedFilters: [" in df._jdf.queryExecution().toString() and "In(lang" in df._jdf.queryExecution().toString()
    assert spark.read.parquet(path).where(filters.compile_filter({"lang": None}, typed={"lang": "lang"})).count() == 5


def test_cosine_of_numpy(spark):
    rng = np.random.default_rng(1)
    a, b = rng.standard_normal(16), rng.standard_normal(16)
    got = spark.createDataFrame([(a.tolist(), b.tolist())], "a array<double>, b array<double>").select(vector.cosine(F.col("a"), F.col("b"))).first()[0]
    assert math.isclose(got, a @ b / np.linalg.norm(a) / np.linalg.norm(b), rel_tol=1e-12)


def test_functions_in_sql(spark):
    from tamarack.functions.register import register

    register(spark, 8)
    r = spark.sql("select search_terms(fold_exact('Le Contrat ÉTÉ de bail')) as t, search_terms(null) as n, size(hash_embed('x')) as d, extract_text(encode(' a ', 'UTF-8'), 'a.txt') as e").first()
    assert (list(r.t), list(r.n), r.d, r.e) == (["contrat", "ete", "bail"], [], 8, "a")
