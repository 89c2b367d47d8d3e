"""Queries over the given tables, one for each operator, and the SQL that says the same.

The collection of most queries is ``documents`` joined to ``embeddings`` (id, values, text, lang,
source); those on many indexes use the upsert log ``vectors``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.functions.filters import compile_filter
from tamarack.functions.text import fold, tokens, words
from tamarack.functions.vector import l2_normalize, norm
from tamarack.operators import keyword, merge, search
from tamarack.operators.hybrid import hybrid, minmax
from tamarack.sources import ingest
from tamarack.sources.embed import embed_column
from tamarack.sources.extract import extract_column
from tamarack.session import spread

QUERY_ID, K, TEXT, LANG = 7, 10, "register of maintenance and radiology protocol", "es"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name in ("documents", "vectors") else rows


def collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "lang", "source")
    e = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("values"), "label")
    return d.join(e, "id").withColumn("metadata", F.to_json(F.struct("lang", "source", "label")))


def _vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return list(_table(spark, sf_dir, "embeddings").where(F.col("vec_id") == QUERY_ID).select("embedding").first()[0])


def live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of all indexes: of each id the row with the greatest ``seq``."""
    rows = _table(spark, sf_dir, "vectors").where(F.col("id").isNotNull() & F.col("seq").isNotNull())
    return merge.last_wins(rows)


def _meta(key: str) -> F.Column:
    one = F.try_variant_get(F.try_parse_json("metadata"), f"$.{key}", "variant")
    return F.when(F.schema_of_variant(one) == "STRING", F.try_variant_get(one, "$", "string"))


# vectors --------------------------------------------------------------------------------


def l2_normalize_store(spark, sf_dir):
    e = _table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * 3.5).alias("v"))
    return e.select("vec_id", F.posexplode(l2_normalize(F.col("v"))).alias("pos", "x")).select("vec_id", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x"))


def knn_exact(spark, sf_dir):
    e = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("values"))
    return search.knn(e, _vector(spark, sf_dir), K).select("id", F.round("score", 6).alias("score"))


def knn_batch(spark, sf_dir):
    e = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("values"))
    q = e.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("values").alias("vector"))
    return search.knn_batch(e, q, K).select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def knn_prefilter(spark, sf_dir):
    rows = collection(spark, sf_dir)
    return search.knn(rows, _vector(spark, sf_dir), 5, F.col("lang") == LANG).select("id", F.round("score", 6).alias("score"))


def knn_postfilter(spark, sf_dir):
    rows = collection(spark, sf_dir)
    return search.knn(rows, _vector(spark, sf_dir), 5, F.col("lang") == LANG, "post").select("id", F.round("score", 6).alias("score"))


def knn_quantized(spark, sf_dir):
    e = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("values"))
    return search.knn_quantized(e, _vector(spark, sf_dir), K).select("id", F.round("score", 6).alias("score"))


def recall_at_k(spark, sf_dir):
    e = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("values"))
    q = e.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("values").alias("vector"))
    truth = search.knn_batch(e, q, K)
    found = search.knn_batch(e.where("id % 2 = 0 or id % 3 = 0"), q, K)
    return search.recall(found, truth, ["query_id"]).select("query_id", F.round("recall", 6).alias("recall"))


def recall_quantized(spark, sf_dir):
    """The share of the true nearest, over the whole table, that the quantised search finds."""
    e = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("values"))
    q = e.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("values").alias("vector"))
    return search.recall(search.knn_quantized_batch(e, q, K), search.knn_batch(e, q, K), ["query_id"]).select("query_id", F.round("recall", 6).alias("recall"))


# filters --------------------------------------------------------------------------------


def filter_eq(spark, sf_dir):
    return _table(spark, sf_dir, "events").where(compile_filter({"k": 42}, "props")).select("event_id", "props")


def filter_in(spark, sf_dir):
    return live(spark, sf_dir).where(compile_filter({"dept": ["it", "hr"]})).select("id")


def filter_and(spark, sf_dir):
    return live(spark, sf_dir).where(compile_filter({"dept": "it", "lang": ["fr", "de"]})).select("id")


def filter_missing(spark, sf_dir):
    return live(spark, sf_dir).where(F.try_parse_json("metadata").isNotNull() & compile_filter({"lang": None})).select("id")


# texts ----------------------------------------------------------------------------------


def accent_fold(spark, sf_dir):
    return _table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.md5(F.array_join(F.regexp_extract_all(fold(F.col("text")), F.lit("[a-z0-9]+"), F.lit(0)), " ")).alias("folded"))


def tokenize(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").select("doc_id", F.explode_outer(tokens(F.col("text"))).alias("token")).where("token is not null")
    return d.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def _docs(spark, sf_dir) -> DataFrame:
    return keyword.documents(_table(spark, sf_dir, "documents"), key="doc_id")


def term_frequency(spark, sf_dir):
    return keyword.postings(_docs(spark, sf_dir), "doc_id").select("doc_id", "token", "tf")


def document_frequency(spark, sf_dir):
    return keyword.document_frequency(_docs(spark, sf_dir), "doc_id")


def corpus_stats(spark, sf_dir):
    return keyword.corpus_stats(_docs(spark, sf_dir)).select("n", F.round("avgdl", 6).alias("avgdl"))


def _bm25(spark, sf_dir, text, only=None):
    docs = keyword.documents(_table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "id"))
    return search.top(keyword.bm25(docs, text, only=only).withColumn("score", F.round("score", 6)), K)


def bm25_topk(spark, sf_dir):
    return _bm25(spark, sf_dir, TEXT)


def bm25_dup_terms(spark, sf_dir):
    return _bm25(spark, sf_dir, "radiology maintenance maintenance maintenance")


def bm25_restricted(spark, sf_dir):
    only = _table(spark, sf_dir, "documents").where(F.col("lang") == "en").select(F.col("doc_id").alias("id"))
    return _bm25(spark, sf_dir, TEXT, only)


def bm25_requests(spark, sf_dir):
    """The keyword side of every request with a text, in its own index."""
    docs = keyword.documents(live(spark, sf_dir).withColumn("text", _meta("text")), carry=["index_name"])
    asked = _table(spark, sf_dir, "query_requests").where("text is not null and top_k > 0").select("query_id", "index_name", "text", "top_k")
    scores = keyword.bm25_batch(docs, asked, by="index_name").join(asked.select("query_id", "top_k"), "query_id")
    best = keyword.best(scores, F.col("top_k"), ["query_id"], most=asked.agg(F.max("top_k")).first()[0] or 0)
    return best.select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def minmax_normalize(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("value").alias("score"))
    flat = minmax(rows.withColumn("score", F.lit(2.5)), name="flat").select("id", "flat")
    return minmax(rows).join(flat, "id").select("id", F.round("normalized", 6).alias("normalized"), "flat")


def _hybrid(spark, sf_dir, alpha, where=None):
    rows = collection(spark, sf_dir)
    return hybrid(rows, keyword.documents(rows), _vector(spark, sf_dir), TEXT, 5, alpha, where).select("id", F.round("score", 6).alias("score"))


def hybrid_topk(spark, sf_dir):
    return _hybrid(spark, sf_dir, 0.5)


def hybrid_filtered(spark, sf_dir):
    return _hybrid(spark, sf_dir, 0.5, F.col("lang") == LANG)


def hybrid_alpha_sweep(spark, sf_dir):
    parts = [_hybrid(spark, sf_dir, a).withColumn("alpha", F.lit(a)) for a in (0.0, 0.3, 1.0)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# documents ------------------------------------------------------------------------------


def chunk_windows(spark, sf_dir):
    parts = ingest.chunk_rows(_table(spark, sf_dir, "documents"))
    return parts.select("id", F.col("chunk").cast("long").alias("chunk"), F.size(words(F.col("text"))).cast("long").alias("n_words"), F.md5("text").alias("digest"))


def extract_dispatch(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").where("text is not null and (filename like '%.txt' or filename like '%.md')")
    return d.select("doc_id", F.md5(extract_column(F.encode("text", "UTF-8"), "filename")).alias("digest"))


def extract_all(spark, sf_dir):
    """Every document through the extractor of its suffix; null where the stored text can't be read as such a file."""
    d = _table(spark, sf_dir, "documents")
    return d.select("doc_id", "filename", F.md5(extract_column(F.encode("text", "UTF-8"), "filename")).alias("digest"))


def html_extract(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").where("text is not null")
    page = F.concat(F.lit("<html><head><title>"), "filename", F.lit("</title><style>p{color:red}</style></head><body><script>var x = 1</script><p>"), F.col("text"), F.lit("</p></body></html>"))
    return d.select("doc_id", extract_column(F.encode(page, "UTF-8"), F.lit("page.html")).alias("text"))


def csv_render(spark, sf_dir):
    s = _table(spark, sf_dir, "supplier")
    head = F.lit(",".join(s.columns) + "\n")
    line = F.concat_ws(",", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in s.columns))
    return s.select(s.columns[0], extract_column(F.encode(F.concat(head, line), "UTF-8"), F.lit("row.csv")).alias("text"))


def hash_embed(spark, sf_dir):
    embed = embed_column("hash", dimension=16)
    d = _table(spark, sf_dir, "documents").where("text is not null").select("doc_id", embed(F.col("text")).alias("v"))
    return d.select("doc_id", F.round(norm(F.col("v")), 5).alias("norm"))


def ingest_pipeline(spark, sf_dir):
    files = _table(spark, sf_dir, "documents").select(F.concat(F.lit("/in/"), "filename").alias("path"), F.encode("text", "UTF-8").alias("content"))
    rows = ingest.records(files, embed_column("hash", dimension=32))
    return rows.select("id", F.size("values").alias("dim"), F.length("metadata").alias("metadata_chars"))


# writes ---------------------------------------------------------------------------------


def upsert_merge(spark, sf_dir):
    """The older half of the log with the newer half upserted into it."""
    log = _table(spark, sf_dir, "vectors").where("id is not null and seq is not null").select("seq", "index_name", "id", "metadata")
    old = merge.last_wins(log.where("seq % 2 = 0"))
    return merge.upsert(old, log.where("seq % 2 = 1")).select("seq", "index_name", "id")


def delete_by_ids(spark, sf_dir):
    rows = live(spark, sf_dir).select("id", "index_name", "seq")
    return merge.delete(rows, _table(spark, sf_dir, "query_matches").select("id").distinct()).select("id", "index_name", "seq")


def delete_by_filter(spark, sf_dir):
    return merge.delete(live(spark, sf_dir).select("id", "metadata"), where=compile_filter({"dept": ["care", "hr"]})).select("id")


def export_all(spark, sf_dir):
    rows = live(spark, sf_dir).where(F.size("vector") == 64).select("seq", "id", l2_normalize(F.col("vector")).alias("v"))
    return rows.orderBy("seq").select("seq", "id", F.round(F.element_at("v", 1), 5).alias("first"), F.round(F.element_at("v", 64), 5).alias("last"))


def stat_count(spark, sf_dir):
    """Dimension, metric and count of every index, empty ones too."""
    n = live(spark, sf_dir).groupBy("index_name").agg(F.count(F.lit(1)).alias("n"))
    c = _table(spark, sf_dir, "index_catalog")
    return c.join(n, "index_name", "left").select("index_name", "dimension", "metric", F.coalesce("n", F.lit(0)).alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        l2_normalize_store, knn_exact, knn_batch, knn_prefilter, knn_postfilter, knn_quantized, recall_at_k, recall_quantized, filter_eq, filter_in, filter_and, filter_missing, accent_fold, tokenize, term_frequency, document_frequency, corpus_stats, bm25_topk, bm25_dup_terms, bm25_restricted, bm25_requests, minmax_normalize, hybrid_topk, hybrid_filtered, hybrid_alpha_sweep, chunk_windows, extract_dispatch, extract_all, html_extract, csv_render, hash_embed, ingest_pipeline, upsert_merge, delete_by_ids, delete_by_filter, export_all, stat_count,
    )
}
