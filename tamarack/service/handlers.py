"""Requests as plain calls that give (status, body)."""

from __future__ import annotations

import os
import threading
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from tamarack.sources.catalog import Catalog
from tamarack.sources.embed import Embedder, embedder_from_env, make_embedder
from tamarack.sources.ingest import Ingestor

Answer = tuple[int, dict]


@dataclass
class Settings:
    """What isn't given comes from the environment."""

    data_dir: str | None = None
    api_key: str | None = None
    cors_origins: list[str] | None = None
    max_upload_mb: float | None = None
    env: dict = field(default_factory=lambda: dict(os.environ))

    def __post_init__(self):
        self.data_dir = self.data_dir if self.data_dir is not None else self.env.get("VK_DATA_DIR", "./data")
        self.api_key = self.api_key if self.api_key is not None else self.env.get("VK_API_KEY")
        if self.cors_origins is None:
            self.cors_origins = [o.strip() for o in self.env.get("VK_CORS_ORIGINS", "").split(",") if o.strip()]
        if self.max_upload_mb is None:
            self.max_upload_mb = float(self.env.get("VK_MAX_UPLOAD_MB", "20"))


class Refused(Exception):
    """Ends a request with a status."""

    def __init__(self, status: int, detail: str):
        super().__init__(detail)
        self.status, self.detail = status, detail


def _field(body: dict, name: str, kind, default=None, needed: bool = False):
    if name not in body or body[name] is None:
        if needed:
            raise Refused(422, f"Field {name!r} is missing")
        return default
    value = body[name]
    if kind is float and isinstance(value, int) and not isinstance(value, bool):
        value = float(value)
    if not isinstance(value, kind) or (kind in (int, float) and isinstance(value, bool)):
        raise Refused(422, f"Field {name!r} isn't of type {kind.__name__}")
    return value


class Service:
    def __init__(self, spark: SparkSession, settings: Settings | None = None, embedder: Embedder | None = None):
        self.settings = settings or Settings()
        self.catalog = Catalog(spark, self.settings.data_dir)
        self._embedder, self._lock = embedder, threading.Lock()

    @property
    def embedder(self) -> Embedder:
        """Made at the first text query or upload, so that plain vectors need no model."""
        with self._lock:
            if self._embedder is None:
                backend, options = embedder_from_env(self.settings.env)
                self._embedder = make_embedder(backend, **options)
            return self._embedder

    def allowed(self, authorization: str | None) -> bool:
        return not self.settings.api_key or authorization == f"Bearer {self.settings.api_key}"

    def _collection(self, name: str):
        try:
            return self.catalog.get(name)
        except KeyError:
            raise Refused(404, f"Collection {name!r} not found") from None

    def health(self) -> Answer:
        return 200, {"status": "ok", "indexes": len(self.catalog.list())}

    def create(self, body: dict) -> Answer:
        name, dimension = _field(body, "name", str, needed=True), _field(body, "dimension", int, needed=True)
        metric = _field(body, "metric", str, "cosine")
        if dimension <= 0:
            raise Refused(422, "Field 'dimension' must be above 0")
        try:
            self.catalog.create(name, dimension, metric)
        except ValueError as e:
            raise Refused(409 if "already exists" in str(e) else 400, str(e)) from None
        return 201, {"name": name, "dimension": dimension, "metric": metric}

    def list(self) -> Answer:
        return 200, {"indexes": self.catalog.list()}

    def drop(self, name: str) -> Answer:
        try:
            self.catalog.drop(name)
        except KeyError:
            raise Refused(404, f"Collection {name!r} not found") from None
        return 200, {"deleted": name}

    def upsert(self, name: str, body: dict) -> Answer:
        collection, vectors = self._collection(name), _field(body, "vectors", list, needed=True)
        items = [{"id": _field(v, "id", str, needed=True), "values": _field(v, "values", list, needed=True), "metadata": _field(v, "metadata", dict, {})} for v in vectors]
        return 200, {"upserted": collection.upsert(items)}

    def query(self, name: str, body: dict) -> Answer:
        collection = self._collection(name)
        vector, text = _field(body, "vector", list), _field(body, "text", str)
        top_k, alpha = _field(body, "top_k", int, 5), _field(body, "alpha", float, 0.5)
        if vector is None:
            if not text:
                raise Refused(400, "Provide either 'vector' or 'text'")
            vector = self.embedder.embed_query(text).tolist()
        found = collection.query(vector, top_k, _field(body, "filter", dict), _field(body, "hybrid", bool, False), alpha, text)
        return 200, {"matches": [{"id": m.id, "score": m.score, "metadata": m.metadata} for m in found]}

    def ingest(self, name: str, filename: str, data: bytes, max_words: int = 400, overlap: int = 40) -> Answer:
        collection = self._collection(name)
        if len(data) > self.settings.max_upload_mb * 1024 * 1024:
            raise Refused(413, f"File exceeds the {self.settings.max_upload_mb} MB upload limit")
        if not data:
            raise Refused(400, "Empty file")
        return 200, Ingestor(self.embedder).ingest(data, filename or "upload", collection, max_words=max_words, overlap=overlap)

    def delete(self, name: str, body: dict) -> Answer:
        return 200, {"deleted": self._collection(name).delete(_field(body, "ids", list), _field(body, "filter", dict))}

    def export(self, name: str) -> Answer:
        return 200, self._collection(name).export()

    def handle(self, method: str, path: str, body: dict | None = None, authorization: str | None = None, options: dict | None = None, upload: tuple[str, bytes] | None = None) -> Answer:
        """Route a request; bad values give 400, unknown names 404."""
        parts, options = [p for p in path.split("/") if p], options or {}
        try:
            if (method, parts) == ("GET", ["health"]):
                return self.health()
            if parts[:1] == ["v1"] and not self.allowed(authorization):
                raise Refused(401, "Missing or invalid API key")
            if parts[:2] == ["v1", "indexes"]:
                rest = parts[2:]
                if not rest and method in ("GET", "POST"):
                    return self.list() if method == "GET" else self.create(body or {})
                if len(rest) == 1 and method == "DELETE":
                    return self.drop(rest[0])
                if len(rest) == 2 and method == "GET" and rest[1] == "export":
                    return self.export(rest[0])
                if len(rest) == 2 and method == "POST":
                    name, what = rest
                    if what == "ingest":
                        if upload is None:
                            raise Refused(422, "Field 'file' is missing")
                        return self.ingest(name, *upload, int(options.get("max_words", 400)), int(options.get("overlap", 40)))
                    if what in ("upsert", "query", "delete"):
                        return getattr(self, what)(name, body or {})
            raise Refused(404, "Not found")
        except Refused as e:
            return e.status, {"detail": e.detail}
        except ValueError as e:
            return 400, {"detail": str(e)}
