"""Problem 1: the most similar vectors of every vector.

Multiprobe p-stable hashing. Vectors are normalised; a table hashes with K
functions ``floor((a.x + b) / w)`` (a: Gaussian, so 2-stable). A query looks into
its own bucket of each table and into perturbed ones, in the order of the
estimated chance to hold a neighbour: perturbation sets are ranked by the expected
squared distances to the bucket walls, and a query applies them to its own walls,
nearest first. The candidates of all tables are merged and ranked by exact cosine.

Placement: the vectors of an index with at most ``block`` rows are one group. A
larger index is first cut into cells by a coarse table of the same kind; its vectors
are stored once for each coarse table, its queries go to their own and the perturbed
cells. What is sent is so in proportion to the rows, at any size. A cell that is still
larger than ``block`` is cut by a hash of the id, and queries go to every part.
Equal vectors: of more than k + 1 in such an index only those with the k + 1 smallest
ids are stored; the neighbours of the others are just these.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tamarack.functions.vector import l2_normalize

BLOCK = 65_536
TABLES, PROBES, WIDTH, SEED = 4, 24, 1.6, 17
COARSE_TABLES, COARSE_PROBES, COARSE_WIDTH = 2, 6, 1.6
MIN_CANDIDATES = 2  # a query with fewer than this times k candidates is compared with the whole block


def functions_for(n: int) -> int:
    """Hash functions of a table: so many that a bucket holds a few unrelated rows."""
    return max(4, min(16, round(math.log(max(n, 2)) / math.log(2.6))))


def perturbations(k: int, probes: int) -> list[tuple[int, ...]]:
    """Sets of ranks (0: the nearest of the 2k walls), best first.

    The rank r and its opposite 2k-1-r are the two walls of one function and exclude
    each other. Expected squared distance of rank r as for uniform positions.
    """

    def cost(j: int) -> float:
        j += 1
        if j <= k:
            return j * (j + 1) / (4 * (k + 1) * (k + 2))
        m = 2 * k + 1 - j
        return 1 - m / (k + 1) + m * (m + 1) / (4 * (k + 1) * (k + 2))

    near = range(min(2 * k, 12))
    sets = [s for size in (1, 2, 3, 4) for s in itertools.combinations(near, size) if not any(2 * k - 1 - r in s for r in s)]
    return sorted(sets, key=lambda s: (sum(map(cost, s)), s))[:probes]


class Table:
    """K functions and the perturbation order; the same for a seed wherever it is made."""

    def __init__(self, dim: int, k: int, width: float, probes: int, seed: int):
        rng = np.random.default_rng(seed)
        self.k, self.width = k, width
        self.a = rng.standard_normal((dim, k)).astype(np.float32)
        self.b = (rng.random(k) * width).astype(np.float32)
        self.mix = rng.integers(1, 2**63, k, dtype=np.uint64) | np.uint64(1)
        self.sets = perturbations(k, probes)

    def keys(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the own buckets, and positions inside them."""
        at = (x @ self.a + self.b) / self.width
        cell = np.floor(at)
        return (cell.astype(np.int64).view(np.uint64) * self.mix).sum(1, dtype=np.uint64), at - cell

    def probes(self, x: np.ndarray) -> np.ndarray:
        """Keys to visit, n x (1 + perturbed buckets), best first."""
        own, inside = self.keys(x)
        walls = np.concatenate([inside, 1 - inside], axis=1)
        order = np.argsort(walls, axis=1, kind="stable")
        # a step below takes the function's factor off the key, a step above adds it
        step = np.concatenate([np.uint64(0) - self.mix, self.mix])[order]
        out = [own]
        for s in self.sets:
            out.append(own + step[:, list(s)].sum(1, dtype=np.uint64))
        return np.stack(out, axis=1)


def unit(flat: np.ndarray, dim: int) -> np.ndarray:
    x = flat.reshape(-1, dim).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """All positions of the ranges, one after the other."""
    total = int(length.sum())
    if not total:
        return np.empty(0, np.int64)
    first = np.cumsum(length) - length
    return np.arange(total) - np.repeat(first, length) + np.repeat(start, length)


def search(data: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int, tables: int = TABLES, probes: int = PROBES, width: float = WIDTH, seed: int = SEED, whole: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query position, data position, cosine) of the k nearest found, other ids only.

    ``ids`` are in ascending order, so that a smaller position is a smaller id. ``whole``: which
    queries are compared with all of ``data`` if their candidates are few; all if not given.
    """
    n, dim = data.shape
    small, small_q = data.astype(np.float32), queries.astype(np.float32)
    made = [Table(dim, functions_for(n), width, probes, seed + t) for t in range(tables)]
    sorted_tables = []
    for t in made:
        keys, _ = t.keys(small)
        order = np.argsort(keys, kind="stable")
        sorted_tables.append((keys[order], order))
    out = []
    step = 2048
    for lo in range(0, len(queries), step):
        part = small_q[lo : lo + step]
        m = len(part)
        pairs = []
        for t, (keys, order) in zip(made, sorted_tables):
            want = t.probes(part)
            flat = want.ravel()
            start = np.searchsorted(keys, flat, "left")
            length = np.searchsorted(keys, flat, "right") - start
            hit = np.flatnonzero(length)
            cand = order[_ranges(start[hit], length[hit])]
            q = np.repeat(hit // want.shape[1], length[hit])
            pairs.append(q * n + cand)
        pair = np.unique(np.concatenate(pairs))
        few = np.bincount(pair // n, minlength=m) <= MIN_CANDIDATES * k
        few = np.flatnonzero(few if whole is None else few & whole[lo : lo + m])
        if len(few):  # too few candidates: the whole block, by float32 first
            size = max(1, 20_000_000 // n)
            more = [pair]
            for f in range(0, len(few), size):
                rows = few[f : f + size]
                dots = part[rows] @ small.T
                keep = min(n, 4 * k + 8)
                best = np.argpartition(-dots, keep - 1, axis=1)[:, :keep] if keep < n else np.broadcast_to(np.arange(n), dots.shape)
                more.append((rows[:, None] * n + best).ravel())
            pair = np.unique(np.concatenate(more))
        q, c = pair // n, pair % n
        other = query_ids[lo + q] != ids[c]
        q, c = q[other], c[other]
        rough = np.einsum("ij,ij->i", part[q], small[c])
        order = np.lexsort((-rough, q))
        q, c = q[order], c[order]
        place = np.arange(len(q)) - np.searchsorted(q, q, "left")
        kept = place < 4 * k + 8
        q, c = q[kept], c[kept]
        cosine = np.einsum("ij,ij->i", queries[lo + q], data[c])
        order = np.lexsort((c, -np.round(cosine, 12), q))
        q, c, cosine = q[order], c[order], cosine[order]
        kept = np.arange(len(q)) - np.searchsorted(q, q, "left") < k
        out.append((lo + q[kept], c[kept], cosine[kept]))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    return tuple(np.concatenate(x) for x in zip(*out))


def usable(vectors: DataFrame, dim: int = 64) -> DataFrame:
    """(``id``, ``index_name``, ``vector``) of the live records of an index that can be compared.

    Not usable: null, another length than ``dim``, a null, NaN or infinite element, norm 0.
    """
    from tamarack.llm.common import live

    norm = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    good = (F.size("vector") == dim) & F.coalesce((norm > 0) & (norm < float("inf")) & ~F.isnan(norm), F.lit(False))
    return live(vectors, "index_name", "vector").where(good & F.col("index_name").isNotNull())


_ROUTED = "index_name string, cell long, part int, role int, id string, vector array<float>"
_FOUND = "index_name string, id string, other string, cosine double"


def _matrix(batch: pa.RecordBatch | pa.Table, dim: int) -> np.ndarray:
    column = batch.column("vector")
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return unit(column.flatten().to_numpy(zero_copy_only=False), dim)


def _search_group(dim: int, k: int):
    def run(group: pa.Table) -> pa.Table:
        group = group.take(pc.sort_indices(group.column("id")))
        x, role = _matrix(group, dim), group.column("role").to_numpy()
        ids = group.column("id").to_numpy(zero_copy_only=False)
        stored, asked = role < 2, role != 1
        q, c, cosine = search(x[stored], ids[stored], x[asked], ids[asked], k, whole=role[asked] != 2) if stored.any() and asked.any() else ([], [], [])
        q, c = ids[asked][np.asarray(q, int)], ids[stored][np.asarray(c, int)]
        names = pa.repeat(group.column("index_name")[0], len(q))
        return pa.table({"index_name": names, "id": pa.array(q, pa.string()), "other": pa.array(c, pa.string()), "cosine": pa.array(cosine, pa.float64())})

    return run


def _route(dim: int, block: int):
    """Rows of large indexes: stored in one cell of each coarse table (role 1), asked there (3) and in the probed ones (2)."""

    def run(batches):
        for batch in batches:
            x = _matrix(batch, dim).astype(np.float32)
            names, ids, vectors = batch.column("index_name"), batch.column("id"), batch.column("vector")
            cells = np.array([max(2, round(math.log(4 * n / block) / math.log(1.8)) + 2) for n in batch.column("n").to_pylist()])
            for k in np.unique(cells):
                rows = np.flatnonzero(cells == k)
                for t in range(COARSE_TABLES):
                    keys = Table(dim, int(k), COARSE_WIDTH, COARSE_PROBES, 1000 + t).probes(x[rows])
                    salt = np.uint64(t + 1)
                    for role, rr, kk in ((1, rows, keys[:, 0]), (3, rows, keys[:, 0]), (2, np.repeat(rows, keys.shape[1] - 1), keys[:, 1:].ravel())):
                        m = len(rr)
                        take = pa.array(rr)
                        cell = (kk ^ salt).view(np.int64)
                        yield pa.RecordBatch.from_arrays([names.take(take), pa.array(cell), pa.array(np.zeros(m, np.int32)), pa.array(np.full(m, role, np.int32)), ids.take(take), vectors.take(take)], ["index_name", "cell", "part", "role", "id", "vector"])

    return run


def nearest(rows: DataFrame, k: int = 5, dim: int = 64, block: int = BLOCK) -> DataFrame:
    """(``index_name``, ``id``, ``other``, ``cosine``): up to k nearest others of each row in its index.

    ``rows``: ``index_name``, ``id`` (unique), ``vector`` (``dim`` finite numbers, norm above
    0); more columns are ignored. By cosine to 12 decimals, then the smaller id. An index
    of one row gives none; an empty table none.
    """
    spark = rows.sparkSession
    rows = rows.select("index_name", "id", "vector")
    # at most (rows / block) names: an index is large if it has more than `block` rows
    large = [r["index_name"] for r in rows.groupBy("index_name").count().where(F.col("count") > block).collect()] if block else []
    whole = rows.where(~F.col("index_name").isin(large)) if large else rows
    whole = whole.select("index_name", F.lit(0).cast("long").alias("cell"), F.lit(0).alias("part"), F.lit(0).alias("role"), "id", "vector")
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = ["index_name", "cell", "part"]

    def grouped(df: DataFrame) -> DataFrame:
        return df.repartition(parts, *keys).groupBy(*keys).applyInArrow(_search_group(dim, k), _FOUND)

    found = grouped(whole)
    if not large:
        return found
    counts = F.broadcast(rows.groupBy("index_name").count().where(F.col("count") > block).withColumnRenamed("count", "n"))
    hot = rows.join(counts, "index_name")
    hot = hot.withColumn("same", F.xxhash64(F.transform(l2_normalize(F.col("vector")), lambda x: F.round(x, 9))))
    # groups of equal vectors with more than k + 1 members; the limit works before the shuffle, too
    rank = Window.partitionBy("index_name", "same").orderBy("id")
    first = hot.select("index_name", "same", "id").withColumn("_n", F.row_number().over(rank)).where(F.col("_n") <= k + 1)
    copies = first.groupBy("index_name", "same").agg(F.sort_array(F.collect_list("id")).alias("ids")).where(F.size("ids") > k)
    hot = hot.join(copies, ["index_name", "same"], "left")
    later = F.col("ids").isNotNull() & (F.col("id") > F.element_at("ids", -1))
    closed = hot.where(later).select("index_name", "id", F.explode(F.slice("ids", 1, k)).alias("other"), F.lit(1.0).alias("cosine"))
    routed = hot.where(~F.coalesce(later, F.lit(False))).select("index_name", "id", "vector", "n").mapInArrow(_route(dim, block), _ROUTED)
    # cells above `block` rows: at most (rows * coarse tables / block) of them
    full = routed.where("role = 1").groupBy("index_name", "cell").count().where(F.col("count") > block).select("index_name", "cell", F.ceil(F.col("count") / block).cast("int").alias("m"))
    routed = routed.join(F.broadcast(full), ["index_name", "cell"], "left").withColumn("m", F.coalesce("m", F.lit(1)))
    stored = routed.where("role = 1").withColumn("part", F.pmod(F.xxhash64("id"), F.col("m")).cast("int"))
    asked = routed.where("role > 1").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    merged = grouped(stored.unionByName(asked).drop("m")).distinct()
    best = Window.partitionBy("index_name", "id").orderBy(F.round("cosine", 12).desc(), "other")
    merged = merged.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k).drop("_n")
    return found.unionByName(merged).unionByName(closed)


def neighbour_pairs(found: DataFrame) -> DataFrame:
    """(``id_a``, ``id_b``): the pairs of which one is a neighbour of the other, each once."""
    return found.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()
