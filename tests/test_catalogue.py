import os

import pytest

from tamarack.plans import catalogue, oracle

from oracle import DATA, same

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
SQL = oracle.sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    same(spark, catalogue.QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    assert catalogue.QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert set(oracle.sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0


def test_rendered_documents(spark):
    pages = {r.doc_id: r.text for r in catalogue.html_extract(spark, DATA).collect()}
    assert pages and all("var x" not in t.split("\n")[1:2] and "color:red" not in t.split("\n")[0] for t in pages.values())
    lines = [r.text for r in catalogue.csv_render(spark, DATA).collect()]
    assert all(" | " in line and ": " in line for line in lines)


def test_all_suffixes_are_extracted(spark):
    import hashlib

    from tamarack.sources.extract import extract_text

    texts = {r.doc_id: (r.filename, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = {r.doc_id: r.digest for r in catalogue.extract_all(spark, DATA).collect()}
    assert set(got) == set(texts)
    read = {}
    for i, (name, text) in texts.items():
        if text is not None and name is not None and os.path.splitext(name)[1].lower() in (".txt", ".md", ".markdown", ".html", ".htm", ".csv"):
            read[i] = extract_text(text.encode(), name)
    assert {os.path.splitext(texts[i][0])[1] for i in read} >= {".html", ".csv"}
    assert {i: d for i, d in got.items() if d is not None} == {i: hashlib.md5(t.encode()).hexdigest() for i, t in read.items()}
    words = {texts[i][0]: len(t.split()) for i, t in read.items()}
    want = sorted(f"{name}#{k}" for name, n in words.items() for k in range(0 if n == 0 else 1 + max(0, -(-(n - 400) // 360))))
    assert sorted(r.id for r in catalogue.ingest_pipeline(spark, DATA).collect()) == want
