"""Blend of vector and keyword scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarack.operators.keyword import bm25
from tamarack.operators.search import scored, top

EPS = 1e-9


def minmax(scores: DataFrame, score: str = "score", name: str = "normalized") -> DataFrame:
    """``scores`` with ``name``: to 0..1 over all rows; equal scores all give 1. Empty stays empty."""
    # the extremes are one row
    edge = F.broadcast(scores.agg(F.min(score).alias("_lo"), F.max(score).alias("_hi")))
    span = F.col("_hi") - F.col("_lo")
    value = F.when(span < EPS, 1.0).otherwise((F.col(score) - F.col("_lo")) / span)
    return scores.crossJoin(edge).withColumn(name, value).drop("_lo", "_hi")


def hybrid(rows: DataFrame, docs: DataFrame, vector: Sequence[float], text: str, k: int = 5, alpha: float = 0.5, where: Column | None = None, values: str = "values", key: str = "id", candidates: DataFrame | None = None) -> DataFrame:
    """The k best rows by alpha * vector + (1 - alpha) * keyword, each normalised within its candidates.

    The vector side has every row (or ``candidates``: key and score, of an approximate search), the
    keyword side the max(4k, 50) best; a missing score is 0. ``where`` applies after the blend.
    """
    if not text:
        raise ValueError("hybrid search needs a text")
    near = (candidates if candidates is not None else scored(rows, vector, values)).select(key, "score")
    near = minmax(near, name="v").select(key, "v")
    # at most max(4k, 50) rows, so it may be broadcast
    said = minmax(top(bm25(docs, text, key), max(4 * k, 50), key=key), name="b").select(key, "b")
    if candidates is None:
        blend = near.join(F.broadcast(said), key, "left")
    else:
        blend = near.join(said, key, "full")
    blend = blend.select(key, (alpha * F.coalesce("v", F.lit(0.0)) + (1 - alpha) * F.coalesce("b", F.lit(0.0))).alias("score"))
    if where is not None:
        blend = blend.join(rows.where(where).select(key), key, "left_semi")
    return top(blend, k, key=key)
