"""Okapi BM25 over a collection's texts, for one query or many."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tamarack.functions.text import tokens

K1, B = 1.5, 0.75


def documents(rows: DataFrame, text: str = "text", key: str = "id", carry: list[str] | None = None, exact: bool = False) -> DataFrame:
    """(``key``, ``carry``, ``toks``, ``dl``): terms and length of each text; null texts are empty."""
    toks = tokens(F.col(text), exact)
    return rows.select(key, *(carry or []), toks.alias("toks")).withColumn("dl", F.size("toks").cast("long"))


def _exploded(docs: DataFrame, toks: Column, *columns: str) -> DataFrame:
    """A row for each term. Not ``explode``: for it the optimizer adds a filter that finds all terms a second time."""
    return docs.select(*columns, F.explode_outer(toks).alias("token")).where(F.col("token").isNotNull())


def postings(docs: DataFrame, key: str = "id", carry: list[str] | None = None) -> DataFrame:
    """(``key``, ``carry``, ``dl``, ``token``, ``tf``); a text's terms are added up before the shuffle."""
    return _exploded(docs, F.col("toks"), key, *(carry or []), "dl").groupBy(key, *(carry or []), "dl", "token").agg(F.count(F.lit(1)).alias("tf"))


def document_frequency(docs: DataFrame, key: str = "id") -> DataFrame:
    """(``token``, ``df``)."""
    return _exploded(docs, F.array_distinct("toks"), key).groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def corpus_stats(docs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(``by``, ``n``, ``avgdl``): empty texts count."""
    return docs.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))


def _weight(tf: Column, df: Column, n: Column, dl: Column, avgdl: Column, k1: float, b: float) -> Column:
    idf = F.log((n - df + 0.5) / (df + 0.5) + 1.0)
    return idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))


def bm25_batch(docs: DataFrame, queries: DataFrame, key: str = "id", query_key: str = "query_id", text: str = "text", by: str | None = None, only: DataFrame | None = None, k1: float = K1, b: float = B) -> DataFrame:
    """(``query_key``, ``key``, ``score``) of all texts that hold a term of the query.

    A term that a query repeats counts each time. With ``by`` a query looks only at the texts
    with the same value of that column (its index), and frequencies and lengths are those of the
    index. ``only`` (``key``) restricts what comes out, not the statistics. Terms that no query
    asks for are dropped before anything is shuffled.
    """
    group = [by] if by else []
    asked = _exploded(queries, tokens(F.col(text)), query_key, *group).groupBy(query_key, *group, "token").agg(F.count(F.lit(1)).alias("qtf"))
    wanted = asked.select("token", *group).distinct()
    hits = _exploded(docs, F.col("toks"), key, *group, "dl").join(wanted, ["token", *group], "left_semi").groupBy(key, *group, "dl", "token").agg(F.count(F.lit(1)).alias("tf"))
    # a sum over tf, not a count: so this branch needs the same columns and the shuffle of the hits is used again
    df = hits.groupBy("token", *group).agg(F.sum((F.col("tf") > 0).cast("long")).alias("df"))
    stats = corpus_stats(docs, group)
    if only is not None:
        hits = hits.join(only.select(key).distinct(), key, "left_semi")
    rows = hits.join(df, ["token", *group]).join(asked, ["token", *group])
    rows = rows.join(stats, by) if by else rows.crossJoin(F.broadcast(stats))  # one row
    weight = F.col("qtf") * _weight(F.col("tf"), F.col("df"), F.col("n"), F.col("dl"), F.col("avgdl"), k1, b)
    return rows.groupBy(query_key, *group, key).agg(F.sum(weight).alias("score")).select(query_key, key, "score")


def bm25(docs: DataFrame, query: str, key: str = "id", only: DataFrame | None = None, k1: float = K1, b: float = B) -> DataFrame:
    """(``key``, ``score``) for one query text; none for an empty collection or a query without terms."""
    one = docs.sparkSession.range(1).select(F.lit(query).alias("text"), F.lit(0).alias("query_id"))
    return bm25_batch(docs, one, key=key, only=only, k1=k1, b=b).drop("query_id")


def best(scores: DataFrame, k: int | Column, by: list[str], key: str = "id", most: int | None = None) -> DataFrame:
    """The k best of each group with ``rank``; k may be a column, ``most`` then its greatest value.

    With a number for k or ``most`` each partition gives out so many rows a group only.
    """
    order = Window.partitionBy(*by).orderBy(F.desc(F.round("score", 9)), F.asc(key))
    ranked = scores.withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= (k if most is None else most)).where(F.col("rank") <= k)
