import os

import pytest

from tamarack.llm import entry

from oracle import DATA, same

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
SQL, QUERIES = entry.oracle_sql(), entry.queries()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    same(spark, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    df = QUERIES[name](spark, DATA)
    assert df.count() >= 0
    if name.endswith("_found"):
        assert df.count() == df.distinct().count()


def test_redaction_takes_exactly_the_mentions(spark):
    """Each text with its mentions cut out is the redacted text with its placeholders cut out."""
    from tamarack.llm import common, pii

    texts = common.live_texts(common.table(spark, DATA, "vectors")).cache()
    found = pii.finder(spark, common.table(spark, DATA, "name_parts"))
    spans = {}
    for r in pii.mentions(texts, found).collect():
        spans.setdefault(r.id, []).append((r.start, r.stop, r.kind))
    before = {r.id: r.text for r in texts.collect()}
    after = {r.id: r.text for r in pii.redacted(texts, found).collect()}
    for i, text in before.items():
        out, at = "", 0
        for a, b, kind in sorted(spans.get(i, [])):
            out += text[at:a] + pii.PLACEHOLDER[kind]
            at = b
        assert after[i] == out + text[at:]
