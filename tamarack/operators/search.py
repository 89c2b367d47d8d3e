"""Exact and quantised nearest neighbours of given query vectors."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tamarack.functions.vector import EPS, dot, l2_normalize, norm, unit_literal

#: Bytes of query vectors that are sent to all executors at once; more queries go in further passes.
QUERY_BYTES = 32_000_000


def scored(rows: DataFrame, vector: Sequence[float], values: str = "values") -> DataFrame:
    """``rows`` with ``score``, the cosine to ``vector`` in double precision; JVM only."""
    return rows.withColumn("score", dot(F.col(values), unit_literal(vector)) / (norm(F.col(values)) + EPS))


def top(rows: DataFrame, k: int, score: str = "score", key: str = "id") -> DataFrame:
    """The k best: score descending, then key ascending. k of 0 or less: none."""
    return rows.orderBy(F.desc(score), F.asc(key)).limit(max(k, 0))


def knn(rows: DataFrame, vector: Sequence[float], k: int = 5, where: Column | None = None, mode: str = "pre", values: str = "values", key: str = "id") -> DataFrame:
    """The k nearest rows. ``where`` before scoring (``pre``: exact), or on the 4k best (``post``)."""
    if where is not None and mode == "pre":
        rows, where = rows.where(where), None
    ranked = scored(rows, vector, values)
    if where is None:
        return top(ranked, k, key=key)
    return top(top(ranked, 4 * k, key=key).where(where), k, key=key)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-9)


def knn_batch(rows: DataFrame, queries: DataFrame, k: int = 5, values: str = "values", key: str = "id", query_key: str = "query_id", query_values: str = "vector", normalize: bool = True) -> DataFrame:
    """(``query_key``, ``key``, ``score``, ``rank``): the k nearest rows of each of many queries.

    Without ``normalize`` the rows are taken as they are; queries are always normalised.

    Queries go to the executors in slices of at most QUERY_BYTES; a slice is one pass over
    the rows, matrix products batch by batch. A partition gives out k rows a query only,
    so what is shuffled doesn't depend on the number of rows in it.
    """
    some = queries.select(query_values).where(F.col(query_values).isNotNull()).first()
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields + queries.schema.fields}
    schema = f"`{query_key}` {types[query_key]}, `{key}` {types[key]}, score double"
    if some is None or k <= 0:
        return rows.sparkSession.createDataFrame([], schema + ", rank int")
    dim = len(some[0])
    slices = max(1, -(-queries.count() * dim * 8 // QUERY_BYTES))
    context = rows.sparkSession.sparkContext
    parts = []
    for i in range(slices):
        chosen = queries.where(F.pmod(F.xxhash64(query_key), F.lit(slices)) == i) if slices > 1 else queries
        got = chosen.select(query_key, query_values).where(F.col(query_values).isNotNull()).toArrow()
        matrix = _unit(np.array(got.column(query_values).to_pylist(), np.float64).reshape(-1, dim))
        shared = context.broadcast((got.column(query_key).to_pylist(), matrix))

        def run(batches, shared=shared):
            names, q = shared.value
            best_s, best_k = np.empty((len(q), 0)), np.empty((len(q), 0), object)
            for batch in batches:
                column = batch.column(values)
                x = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)
                x = _unit(x) if normalize else x
                keys = np.array(batch.column(key).to_pylist(), object)
                for lo in range(0, len(x), 8192):
                    block = q @ x[lo : lo + 8192].T
                    own = keys[lo : lo + 8192]
                    s = np.concatenate([best_s, block], axis=1)
                    kk = np.concatenate([best_k, np.broadcast_to(own, block.shape)], axis=1)
                    if s.shape[1] > k:
                        at = np.argpartition(-s, k - 1, axis=1)[:, :k]
                        kept = np.take_along_axis(s, at, 1)
                        edge = kept.min(1, keepdims=True) - 1e-12
                        # where more than k reach the edge the smaller keys are taken
                        for r in np.flatnonzero((s >= edge).sum(1) > k):
                            near = np.flatnonzero(s[r] >= edge[r])
                            at[r] = sorted(near, key=lambda j: (-round(s[r, j], 12), kk[r, j]))[:k]
                        s, kk = np.take_along_axis(s, at, 1), np.take_along_axis(kk, at, 1)
                    best_s, best_k = s, kk
            n = best_s.shape[1]
            if n:
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(names, object), n).tolist(), q_type), pa.array(best_k.ravel().tolist(), k_type), pa.array(best_s.ravel())], [query_key, key, "score"])

        q_type, k_type = got.schema.field(query_key).type, pa.int64() if types[key] == "bigint" else pa.int32() if types[key] == "int" else pa.string()
        good = rows.where(F.size(values) == dim).select(key, values)
        parts.append(good.mapInArrow(run, schema))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    best = Window.partitionBy(query_key).orderBy(F.desc(F.round("score", 12)), F.asc(key))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def quantize(rows: DataFrame, bits: int = 4, values: str = "values") -> DataFrame:
    """``rows`` with ``lo``, ``hi`` and ``codes``: each vector's elements on 2^bits steps between its least and greatest."""
    unit = l2_normalize(F.col(values))
    levels = float(2**bits - 1)
    rows = rows.withColumn("_u", unit).withColumn("lo", F.array_min("_u")).withColumn("hi", F.array_max("_u"))
    span = F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-12))
    return rows.withColumn("codes", F.transform("_u", lambda x: F.floor((x - F.col("lo")) / span * levels + 0.5).cast("tinyint"))).drop("_u")


def knn_quantized(rows: DataFrame, vector: Sequence[float], k: int = 5, bits: int = 4, where: Column | None = None, values: str = "values", key: str = "id") -> DataFrame:
    """Nearest rows by quantised vectors: the max(4k, 50) best of these, ranked again by the exact cosine."""
    levels = float(2**bits - 1)
    coded = quantize(rows, bits, values)
    span = F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-12))
    about = F.transform("codes", lambda c: F.col("lo") + c.cast("double") / levels * span)
    coded = coded.withColumn("rough", F.round(dot(about, unit_literal(vector)), 9))
    candidates = top(coded, max(4 * k, 50), "rough", key).drop("lo", "hi", "codes", "rough")
    ranked = scored(candidates, vector, values)
    return top(ranked if where is None else ranked.where(where), k, key=key)


def knn_quantized_batch(rows: DataFrame, queries: DataFrame, k: int = 5, bits: int = 4) -> DataFrame:
    """``knn_quantized`` of many ``queries`` (``query_id``, ``vector``) over ``rows`` (``id``, ``values``): (``query_id``, ``id``, ``score``, ``rank``)."""
    coded = quantize(rows.select("id", "values"), bits)
    span = F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-12))
    about = F.transform("codes", lambda c: F.col("lo") + c.cast("double") / float(2**bits - 1) * span)
    near = knn_batch(coded.select("id", about.alias("values")), queries, max(4 * k, 50) if k > 0 else 0, normalize=False).select("query_id", "id")
    both = near.join(rows.select("id", "values"), "id").join(queries.select("query_id", "vector"), "query_id")
    cosine = dot(F.col("values"), F.col("vector")) / ((norm(F.col("values")) + EPS) * (norm(F.col("vector")) + EPS))
    ranked = both.select("query_id", "id", cosine.alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), F.asc("id"))
    return ranked.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


class Strategy(Protocol):
    """How a collection is searched: the best rows, and the candidates a blend starts from."""

    def search(self, rows: DataFrame, vector: Sequence[float], k: int, where: Column | None, mode: str) -> DataFrame: ...

    def candidates(self, rows: DataFrame, vector: Sequence[float], k: int) -> DataFrame | None: ...


class Exact:
    """Every row is scored; ``candidates`` of None stands for all rows."""

    def __init__(self, bits: int = 4):
        pass

    def search(self, rows, vector, k, where, mode):
        return knn(rows, vector, k, where, mode)

    def candidates(self, rows, vector, k):
        return None


class Quantized:
    """Rough scores of quantised vectors, the best ranked again."""

    def __init__(self, bits: int = 4):
        self.bits = bits

    def search(self, rows, vector, k, where, mode):
        return knn_quantized(rows, vector, k, self.bits, where)

    def candidates(self, rows, vector, k):
        return knn_quantized(rows, vector, max(4 * k, 50), self.bits)


STRATEGIES = {"exact": Exact, "quantized": Quantized}


def recall(found: DataFrame, truth: DataFrame, by: list[str], key: str = "id") -> DataFrame:
    """(``by``, ``recall``): the share of the true keys of each query that were found."""
    hit = truth.join(found.select(*by, key, F.lit(1).alias("_hit")).distinct(), [*by, key], "left")
    return hit.groupBy(*by).agg(F.avg(F.coalesce("_hit", F.lit(0)).cast("double")).alias("recall"))
