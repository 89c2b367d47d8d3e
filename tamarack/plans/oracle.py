"""SQL for the queries of ``catalogue`` that SQL can express."""

from __future__ import annotations

import re

from tamarack.functions.text import STOPWORDS
from tamarack.plans.catalogue import K, LANG, QUERY_ID, TEXT

_STOP = ", ".join(f"'{w}'" for w in STOPWORDS if re.fullmatch("[a-z]{2,}", w))
_TOKS = "list_filter(regexp_extract_all(strip_accents(lower(coalesce({c}, ''))), '[a-z]+'), lambda t: length(t) > 1 AND t NOT IN (" + _STOP + "))"
_SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_EMB = "emb AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings)"
_Q = f"q AS (SELECT embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id = {QUERY_ID})"
_NORM = "list_transform({v}, lambda x: x / (sqrt(list_inner_product({v}, {v})) + 1e-9))"
_COS = f"list_inner_product({_NORM.format(v='v')}, {_NORM.format(v='qv')})"
_COLL = "coll AS (SELECT d.doc_id AS id, d.text, d.lang, d.source, e.embedding::DOUBLE[] AS v FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id)"
_LIVE = "live AS (SELECT * FROM vectors WHERE id IS NOT NULL AND seq IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1)"
_DOCS = f"docs AS (SELECT doc_id AS id, lang, {_TOKS.format(c='text')} AS toks FROM documents)"


def _string(key: str) -> str:
    return f"CASE WHEN json_valid(metadata) AND json_type(metadata::JSON, '$.{key}') = 'VARCHAR' THEN metadata::JSON ->> '$.{key}' END"


def _bm25(docs: str, text: str) -> str:
    """CTEs from ``docs`` (id, toks) to ``scores`` (id, score)."""
    query = _TOKS.format(c="'" + text + "'")
    return f"""stats AS (SELECT count(*)::DOUBLE AS n, avg(len(toks)) AS avgdl FROM {docs}),
qt AS (SELECT token, count(*) AS qtf FROM (SELECT unnest({query}) AS token) GROUP BY token),
tf AS (SELECT id, token, count(*) AS tf FROM (SELECT id, unnest(toks) AS token FROM {docs}) GROUP BY id, token),
df AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
scores AS (SELECT tf.id, sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1.0) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(toks) / avgdl))) AS score
           FROM tf JOIN qt USING (token) JOIN df USING (token) JOIN {docs} x ON x.id = tf.id CROSS JOIN stats GROUP BY tf.id)"""


def _hybrid(alpha: float, where: str = "") -> str:
    return f"""
WITH {_COLL}, {_Q}, docs AS (SELECT id, {_TOKS.format(c='text')} AS toks FROM coll), {_bm25('docs', TEXT)},
vs AS (SELECT id, lang, {_COS} AS s FROM coll CROSS JOIN q),
vn AS (SELECT id, lang, CASE WHEN max(s) OVER () - min(s) OVER () < 1e-9 THEN 1.0 ELSE (s - min(s) OVER ()) / (max(s) OVER () - min(s) OVER ()) END AS v FROM vs),
bk AS (SELECT id, score AS s FROM scores ORDER BY s DESC, id LIMIT 50),
bn AS (SELECT id, CASE WHEN max(s) OVER () - min(s) OVER () < 1e-9 THEN 1.0 ELSE (s - min(s) OVER ()) / (max(s) OVER () - min(s) OVER ()) END AS b FROM bk)
SELECT id, round({alpha}::DOUBLE * v + (1 - {alpha}::DOUBLE) * coalesce(b, 0), 6) AS score FROM vn LEFT JOIN bn USING (id) {where}
ORDER BY {alpha}::DOUBLE * v + (1 - {alpha}::DOUBLE) * coalesce(b, 0) DESC, id LIMIT 5"""


def _keyword(text: str, where: str = "") -> str:
    return f"WITH {_DOCS}, {_bm25('docs', text)} SELECT id, round(score, 6) AS score FROM scores JOIN docs USING (id) {where} ORDER BY 2 DESC, id LIMIT {K}"


def _batch(data: str) -> str:
    return f"""SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, id) AS rank
FROM (SELECT q.id AS query_id, e.id, list_inner_product(e.u, q.u) AS score FROM unit q, {data} e WHERE q.id % 20 = 0) QUALIFY rank <= {K}"""


def _quantized() -> str:
    return f"""
WITH {_EMB}, {_Q}, unit AS (SELECT id, v, {_NORM.format(v='v')} AS u FROM emb), qu AS (SELECT qv, {_NORM.format(v='qv')} AS uq FROM q),
edge AS (SELECT *, list_min(u) AS lo, list_max(u) AS hi FROM unit),
coded AS (SELECT *, list_transform(u, lambda x: floor((x - lo) / greatest(hi - lo, 1e-12) * 15 + 0.5)) AS codes FROM edge),
rough AS (SELECT id, v, round(list_inner_product(list_transform(codes, lambda c: lo + c / 15 * greatest(hi - lo, 1e-12)), uq), 9) AS r FROM coded CROSS JOIN qu
          ORDER BY r DESC, id LIMIT 50)
SELECT id, round({_COS}, 6) AS score FROM rough CROSS JOIN q ORDER BY {_COS} DESC, id LIMIT {K}"""


def sql() -> dict[str, str]:
    ranked = f"{_COS} DESC, id"
    near = f"SELECT id, round({_COS}, 6) AS score"
    unit = f"unit AS (SELECT id, {_NORM.format(v='v')} AS u FROM emb)"
    requests = f"""
WITH {_LIVE}, docs AS (SELECT id, index_name, {_TOKS.format(c='(' + _string('text') + ')')} AS toks FROM live),
stats AS (SELECT index_name, count(*)::DOUBLE AS n, avg(len(toks)) AS avgdl FROM docs GROUP BY index_name),
qt AS (SELECT query_id, index_name, top_k, token, count(*) AS qtf FROM (SELECT query_id, index_name, top_k, unnest({_TOKS.format(c='text')}) AS token FROM query_requests WHERE text IS NOT NULL AND top_k > 0) GROUP BY ALL),
tf AS (SELECT index_name, id, token, count(*) AS tf FROM (SELECT index_name, id, unnest(toks) AS token FROM docs) GROUP BY ALL),
df AS (SELECT index_name, token, count(*) AS df FROM tf GROUP BY ALL),
scores AS (SELECT query_id, any_value(top_k) AS top_k, tf.id, sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1.0) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(toks) / avgdl))) AS score
           FROM qt JOIN tf USING (index_name, token) JOIN df USING (index_name, token) JOIN stats USING (index_name) JOIN docs ON docs.id = tf.id GROUP BY query_id, tf.id)
SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM scores QUALIFY rank <= top_k"""
    words = f"list_filter(regexp_split_to_array(coalesce(text, ''), '{_SPACE}+'), lambda w: w <> '')"
    return {
        "l2_normalize_store": f"WITH s AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x * 3.5::DOUBLE) AS v FROM embeddings) SELECT vec_id, unnest(range(len(v)))::BIGINT AS pos, round(unnest({_NORM.format(v='v')}), 6) AS x FROM s",
        "knn_exact": f"WITH {_EMB}, {_Q} {near} FROM emb CROSS JOIN q ORDER BY {ranked} LIMIT {K}",
        "knn_batch": f"WITH {_EMB}, {unit} SELECT query_id, id, round(score, 6) AS score, rank FROM ({_batch('unit')})",
        "knn_prefilter": f"WITH {_COLL}, {_Q} {near} FROM coll CROSS JOIN q WHERE lang = '{LANG}' ORDER BY {ranked} LIMIT 5",
        "knn_postfilter": f"WITH {_COLL}, {_Q}, near AS (SELECT * FROM coll CROSS JOIN q ORDER BY {ranked} LIMIT 20) {near} FROM near WHERE lang = '{LANG}' ORDER BY {ranked} LIMIT 5",
        "knn_quantized": _quantized(),
        "recall_at_k": f"WITH {_EMB}, {unit}, subset AS (SELECT * FROM unit WHERE id % 2 = 0 OR id % 3 = 0), truth AS ({_batch('unit')}), found AS ({_batch('subset')}) SELECT query_id, round(avg(CASE WHEN f.id IS NULL THEN 0.0::DOUBLE ELSE 1.0 END), 6) AS recall FROM truth t LEFT JOIN found f USING (query_id, id) GROUP BY query_id",
        "filter_eq": "SELECT event_id, props FROM events WHERE json_type(props::JSON, '$.k') IN ('BIGINT', 'UBIGINT', 'DOUBLE') AND (props::JSON ->> '$.k')::DOUBLE = 42",
        "filter_in": f"WITH {_LIVE} SELECT id FROM live WHERE ({_string('dept')}) IN ('it', 'hr')",
        "filter_and": f"WITH {_LIVE} SELECT id FROM live WHERE ({_string('dept')}) = 'it' AND ({_string('lang')}) IN ('fr', 'de')",
        "filter_missing": f"WITH {_LIVE} SELECT id FROM live WHERE CASE WHEN json_valid(metadata) THEN coalesce(json_type(metadata::JSON, '$.lang'), 'NULL') = 'NULL' ELSE false END",
        "accent_fold": "SELECT doc_id, md5(array_to_string(regexp_extract_all(strip_accents(lower(text)), '[a-z0-9]+'), ' ')) AS folded FROM documents WHERE text IS NOT NULL",
        "tokenize": f"WITH {_DOCS} SELECT token, count(*) AS n FROM (SELECT unnest(toks) AS token FROM docs) GROUP BY token",
        "term_frequency": f"WITH {_DOCS} SELECT id AS doc_id, token, count(*) AS tf FROM (SELECT id, unnest(toks) AS token FROM docs) GROUP BY id, token",
        "document_frequency": f"WITH {_DOCS} SELECT token, count(DISTINCT id) AS df FROM (SELECT id, unnest(toks) AS token FROM docs) GROUP BY token",
        "corpus_stats": f"WITH {_DOCS} SELECT count(*) AS n, round(avg(len(toks)), 6) AS avgdl FROM docs",
        "bm25_topk": _keyword(TEXT),
        "bm25_dup_terms": _keyword("radiology maintenance maintenance maintenance"),
        "bm25_restricted": _keyword(TEXT, "WHERE lang = 'en'"),
        "bm25_requests": requests,
        "minmax_normalize": "SELECT event_id AS id, round((value - min(value) OVER ()) / (max(value) OVER () - min(value) OVER ()), 6) AS normalized, 1.0::DOUBLE AS flat FROM events",
        "hybrid_topk": _hybrid(0.5),
        "hybrid_filtered": _hybrid(0.5, f"WHERE lang = '{LANG}'"),
        "hybrid_alpha_sweep": " UNION ALL ".join(f"SELECT id, score, {a}::DOUBLE AS alpha FROM ({_hybrid(a)})" for a in (0.0, 0.3, 1.0)),
        "chunk_windows": f"""
WITH w AS (SELECT filename, {words} AS w FROM documents),
n AS (SELECT *, CASE WHEN len(w) = 0 THEN 0 WHEN len(w) <= 400 THEN 1 ELSE 1 + ceil((len(w) - 400) / 360.0)::BIGINT END AS c FROM w),
parts AS (SELECT filename, w, unnest(range(c)) AS chunk FROM n),
cuts AS (SELECT filename, chunk, w[chunk * 360 + 1 : chunk * 360 + 400] AS part FROM parts)
SELECT concat_ws('#', filename, chunk::VARCHAR) AS id, chunk::BIGINT AS chunk, len(part)::BIGINT AS n_words, md5(array_to_string(part, ' ')) AS digest FROM cuts""",
        "extract_dispatch": f"SELECT doc_id, md5(regexp_replace(regexp_replace(text, '^{_SPACE}+', ''), '{_SPACE}+$', '')) AS digest FROM documents WHERE text IS NOT NULL AND (filename LIKE '%.txt' OR filename LIKE '%.md')",
        "upsert_merge": """
WITH log AS (SELECT seq, index_name, id FROM vectors WHERE id IS NOT NULL AND seq IS NOT NULL),
old AS (SELECT * FROM log WHERE seq % 2 = 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1),
new AS (SELECT * FROM log WHERE seq % 2 = 1 QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1)
SELECT * FROM old WHERE id NOT IN (SELECT id FROM new) UNION ALL SELECT * FROM new""",
        "delete_by_ids": f"WITH {_LIVE} SELECT id, index_name, seq FROM live WHERE id NOT IN (SELECT id FROM query_matches WHERE id IS NOT NULL)",
        "delete_by_filter": f"WITH {_LIVE} SELECT id FROM live WHERE NOT coalesce(({_string('dept')}) IN ('care', 'hr'), false)",
        "export_all": f"WITH {_LIVE}, u AS (SELECT seq, id, {_NORM.format(v='v')} AS n FROM (SELECT seq, id, vector::DOUBLE[] AS v FROM live WHERE len(vector) = 64)) SELECT seq, id, round(n[1], 5) AS first, round(n[64], 5) AS last FROM u",
        "stat_count": f"WITH {_LIVE}, n AS (SELECT index_name, count(*) AS n FROM live GROUP BY index_name) SELECT index_name, dimension, metric, coalesce(n, 0) AS n FROM index_catalog LEFT JOIN n USING (index_name)",
    }
