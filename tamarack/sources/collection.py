"""A collection of records (id, unit vector, JSON metadata) in Parquet segments.

An upsert writes one segment and a manifest that names it; nothing else is rewritten, so its
cost is that of the batch. A record's row with the greatest ``seq`` is the one that counts.
Manifests are numbered and never changed; the greatest number is the state, and two writers
can't create the same one. A delete rewrites the segments that hold such records and
removes the old files, so what is deleted is gone. When ``COMPACT`` segments have come
together they are merged into one.
"""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamarack.functions.filters import compile_filter
from tamarack.functions.vector import l2_normalize
from tamarack.operators import keyword
from tamarack.operators.hybrid import hybrid as hybrid_search
from tamarack.operators.merge import last_wins
from tamarack.operators.search import STRATEGIES, quantize
from tamarack.sources.storage import Files

METRICS = ("cosine",)
#: The two backends, and the names under which they are known, too (fixed values).
BACKENDS = {"exact": "exact", "bruteforce": "exact", "quantized": "quantized", "turbovec": "quantized"}
COMPACT = 16

SCHEMA = T.StructType([T.StructField("seq", T.LongType()), T.StructField("id", T.StringType()), T.StructField("values", T.ArrayType(T.FloatType())), T.StructField("metadata", T.StringType())])


@dataclass
class Match:
    """One hit of a query."""

    id: str
    score: float
    metadata: dict


def _text() -> F.Column:
    one = F.try_variant_get(F.try_parse_json("metadata"), "$.text", "variant")
    return F.when(F.schema_of_variant(one) == "STRING", F.try_variant_get(one, "$", "string"))


class Collection:
    """Use ``Collection.create`` or open an existing folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.files = spark, Files(spark, path)
        if not self.files.exists("meta.json"):
            raise FileNotFoundError(f"No collection at {path}")
        meta = self.files.read("meta.json")
        self.dimension, self.metric = meta["dimension"], meta["metric"]
        self.backend, self.bit_width = meta.get("backend", "exact"), int(meta.get("bit_width", 4))
        self._lock = threading.RLock()
        self._kept: DataFrame | None = None

    @classmethod
    def create(cls, spark: SparkSession, path: str, dimension: int, metric: str = "cosine", backend: str = "exact", bit_width: int = 4) -> Collection:
        """New properties in ``path``; records that are there already stay."""
        if metric not in METRICS:
            raise ValueError(f"Unsupported metric {metric!r}; supported: {list(METRICS)}")
        if backend not in BACKENDS:
            raise ValueError(f"Unknown backend {backend!r}; known: {sorted(BACKENDS)}")
        files = Files(spark, path)
        files.mkdirs()
        files.remove("meta.json")
        files.write_new("meta.json", {"dimension": int(dimension), "metric": metric, "backend": BACKENDS[backend], "bit_width": int(bit_width)})
        return cls(spark, path)

    @classmethod
    def stat(cls, spark: SparkSession, path: str) -> dict:
        """Dimension, metric and count, without reading vectors."""
        one = cls(spark, path)
        return {"dimension": one.dimension, "metric": one.metric, "count": one.count()}

    # state ------------------------------------------------------------------------------

    def _manifest(self) -> tuple[int, dict]:
        numbers = [int(n[9:-5]) for n in self.files.list() if n.startswith("manifest-") and n.endswith(".json")]
        if not numbers:
            return 0, {"segments": [], "next": 0}
        return max(numbers), self.files.read(f"manifest-{max(numbers):012d}.json")

    def _commit(self, number: int, manifest: dict) -> bool:
        done = self.files.write_new(f"manifest-{number + 1:012d}.json", manifest)
        if done:
            self._forget()
        return done

    def _forget(self) -> None:
        if self._kept is not None:
            self._kept.unpersist()
            self._kept = None

    def _rows(self, segments: list[str]) -> DataFrame:
        if not segments:
            return self.spark.createDataFrame([], SCHEMA)
        rows = self.spark.read.schema(SCHEMA).parquet(*(self.files.url(s) for s in segments))
        return rows if len(segments) == 1 else last_wins(rows)

    def records(self) -> DataFrame:
        """(``seq``, ``id``, ``values``, ``metadata``) of the records, as a DataFrame to go on with."""
        with self._lock:
            return self._rows(self._manifest()[1]["segments"])

    def cached(self) -> DataFrame:
        """``records``, kept in memory until the next write or ``close``."""
        with self._lock:
            if self._kept is None:
                self._kept = self.records().persist()
            return self._kept

    def count(self) -> int:
        with self._lock:
            segments = self._manifest()[1]["segments"]
            rows = self._rows(segments)
            return (rows if len(segments) <= 1 else rows.select("id")).count()

    def close(self) -> None:
        with self._lock:
            self._forget()

    # writes -----------------------------------------------------------------------------

    def upsert(self, items: Sequence[dict]) -> int:
        """``items``: id, values, metadata (may be missing). One bad item and nothing is written.

        The last of several items with an id counts. Gives the number of items.
        """
        if not items:
            return 0
        rows = []
        for n, item in enumerate(items):
            values = [float(x) for x in item["values"]]
            if len(values) != self.dimension:
                raise ValueError(f"Vector for id={item['id']!r} has dim {len(values)}, expected {self.dimension}")
            rows.append((n, item["id"], values, json.dumps(item.get("metadata") or {}, ensure_ascii=False)))
        frame = self.spark.createDataFrame(rows, T.StructType([T.StructField("seq", T.LongType()), T.StructField("id", T.StringType()), T.StructField("values", T.ArrayType(T.DoubleType())), T.StructField("metadata", T.StringType())]))
        self._append(frame, len(rows))
        return len(rows)

    def upsert_frame(self, rows: DataFrame) -> int:
        """Upsert of any size: ``id``, ``values``, ``metadata`` and ``seq`` (0 and up, unique, the order of arrival)."""
        wrong = F.size("values") != self.dimension
        total, bad, last = rows.agg(F.count(F.lit(1)), F.sum(F.coalesce(wrong, F.lit(True)).cast("int")), F.max("seq")).first()
        if not total:
            return 0
        if bad:
            one = rows.where(F.coalesce(wrong, F.lit(True))).select("id", F.size("values").alias("n")).first()
            raise ValueError(f"Vector for id={one['id']!r} has dim {one['n']}, expected {self.dimension}")
        self._append(rows, last + 1)
        return total

    def _append(self, rows: DataFrame, width: int) -> None:
        rows = last_wins(rows.select("seq", "id", "values", F.coalesce("metadata", F.lit("{}")).alias("metadata")))
        unit = F.transform(l2_normalize(F.col("values")), lambda x: x.cast("float"))
        with self._lock:
            while True:
                number, manifest = self._manifest()
                name = f"segment-{uuid.uuid4().hex}"
                shifted = rows.select((F.col("seq") + manifest["next"]).alias("seq"), "id", unit.alias("values"), "metadata")
                shifted.coalesce(max(1, width // 100_000)).write.parquet(self.files.url(name)) if width < 1_000_000 else shifted.write.parquet(self.files.url(name))
                new = {"segments": [*manifest["segments"], name], "next": manifest["next"] + width}
                if self._commit(number, new):
                    break
                self.files.remove(name)  # another writer was first
            if len(new["segments"]) > COMPACT:
                self.compact()

    def compact(self) -> None:
        """Merge all segments; the old files go."""
        with self._lock:
            number, manifest = self._manifest()
            name = f"segment-{uuid.uuid4().hex}"
            self._rows(manifest["segments"]).write.parquet(self.files.url(name))
            if self._commit(number, manifest | {"segments": [name]}):
                for old in manifest["segments"]:
                    self.files.remove(old)
                self._purge_manifests()
            else:
                self.files.remove(name)

    def _purge_manifests(self) -> None:
        names = [n for n in self.files.list() if n.startswith("manifest-")]
        for n in names[:-1]:
            self.files.remove(n)

    def delete(self, ids: Sequence[str] | None = None, filter: dict | None = None) -> int:
        """Remove records by id or by filter; the number of those that were there.

        Neither given, or an empty filter: nothing happens. Files that held them are removed.
        """
        if not ids and not filter:
            return 0
        with self._lock:
            while True:
                number, manifest = self._manifest()
                current = self._rows(manifest["segments"])
                hit = F.lit(False)
                if ids:
                    hit = hit | F.col("id").isin(list(ids))
                if filter:
                    hit = hit | compile_filter(filter)
                gone = current.where(hit).select("id").persist()
                n = gone.count()
                if not n:
                    gone.unpersist()
                    return 0
                kept, removed, made = [], [], []
                for s in manifest["segments"]:
                    rows = self.spark.read.schema(SCHEMA).parquet(self.files.url(s))
                    if rows.join(gone, "id", "left_semi").isEmpty():
                        kept.append(s)
                        continue
                    removed.append(s)
                    name = f"segment-{uuid.uuid4().hex}"
                    rows.join(gone, "id", "left_anti").write.parquet(self.files.url(name))
                    kept.append(name)
                    made.append(name)
                gone.unpersist()
                if self._commit(number, manifest | {"segments": kept}):
                    for s in removed:
                        self.files.remove(s)
                    self._purge_manifests()
                    return n
                for s in made:
                    self.files.remove(s)

    # reads ------------------------------------------------------------------------------

    def search(self, vector: Sequence[float], top_k: int = 5, filter: dict | None = None, hybrid: bool = False, alpha: float = 0.5, text: str | None = None, filter_mode: str = "pre", rows: DataFrame | None = None) -> DataFrame:
        """(``id``, ``score``, ``metadata``) of the best records as one lazy plan.

        ``filter_mode`` ``post`` filters the 4k best only and may give fewer than k.
        """
        if hybrid and not text:
            raise ValueError("hybrid=True requires a 'text' argument for BM25")
        if len(vector) != self.dimension:
            raise ValueError(f"Query vector has dim {len(vector)}, expected {self.dimension}")
        rows = self.records() if rows is None else rows
        where = compile_filter(filter) if filter else None
        strategy = STRATEGIES[self.backend](self.bit_width)
        if hybrid:
            docs = keyword.documents(rows.withColumn("text", _text()))
            best = hybrid_search(rows, docs, vector, text, top_k, alpha, where, candidates=strategy.candidates(rows, vector, top_k))
            return best.join(rows.select("id", "metadata"), "id").select("id", "score", "metadata").orderBy(F.desc("score"), "id")
        return strategy.search(rows, vector, top_k, where, filter_mode).select("id", "score", "metadata")

    def query(self, vector: Sequence[float], top_k: int = 5, filter: dict | None = None, hybrid: bool = False, alpha: float = 0.5, text: str | None = None, filter_mode: str = "pre") -> list[Match]:
        """The best records, best first."""
        if hybrid and not text:
            raise ValueError("hybrid=True requires a 'text' argument for BM25")
        with self._lock:
            if self.count() == 0:
                return []
            found = self.search(vector, top_k, filter, hybrid, alpha, text, filter_mode, self.cached())
            return [Match(r["id"], r["score"], json.loads(r["metadata"])) for r in found.collect()]

    def export_frame(self) -> DataFrame:
        """(``id``, ``values``, ``metadata``) in the order of the last writes; values are unit vectors."""
        return self.records().orderBy("seq").select("id", "values", "metadata")

    def export(self) -> dict:
        """The whole collection as a dict, for small ones."""
        with self._lock:
            rows = self.export_frame().toLocalIterator()
            return {"dimension": self.dimension, "metric": self.metric, "vectors": [{"id": r["id"], "values": list(r["values"]), "metadata": json.loads(r["metadata"])} for r in rows]}

    def codes(self) -> DataFrame:
        """The records with their quantised vectors."""
        return quantize(self.records(), self.bit_width)
