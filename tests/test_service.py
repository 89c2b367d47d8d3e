import json
import threading
import urllib.error
import urllib.request

import pytest

from tamarack.service import cli
from tamarack.service.handlers import Service, Settings
from tamarack.service.server import make_server, parse_upload
from tamarack.sources.embed import HashEmbedder


@pytest.fixture(scope="module")
def service(spark, tmp_path_factory):
    settings = Settings(data_dir=str(tmp_path_factory.mktemp("data")), api_key="key", cors_origins=["http://a.example"], max_upload_mb=0.001, env={})
    return Service(spark, settings, HashEmbedder(8))


def call(service, method, path, body=None, key="Bearer key", **more):
    return service.handle(method, path, body, key, **more)


def test_requests(service):
    assert call(service, "GET", "/health", key=None) == (200, {"status": "ok", "indexes": 0})
    assert call(service, "GET", "/v1/indexes", key=None)[0] == 401
    assert call(service, "GET", "/v1/indexes", key="Bearer other")[0] == 401
    assert call(service, "POST", "/v1/indexes", {"name": "d", "dimension": 8}) == (201, {"name": "d", "dimension": 8, "metric": "cosine"})
    assert call(service, "POST", "/v1/indexes", {"name": "d", "dimension": 8})[0] == 409
    assert call(service, "POST", "/v1/indexes", {"name": "../x", "dimension": 8})[0] == 400
    assert call(service, "POST", "/v1/indexes", {"name": "e", "dimension": 8, "metric": "l2"})[0] == 400
    for body in ({"name": "e", "dimension": 0}, {"name": "e"}, {"name": 3, "dimension": 2}, {"name": "e", "dimension": True}):
        assert call(service, "POST", "/v1/indexes", body)[0] == 422
    vectors = [{"id": "a", "values": [1] + [0] * 7, "metadata": {"text": "bail", "k": 1}}, {"id": "b", "values": [0, 1] + [0] * 6}]
    assert call(service, "POST", "/v1/indexes/d/upsert", {"vectors": vectors}) == (200, {"upserted": 2})
    assert call(service, "POST", "/v1/indexes/d/upsert", {"vectors": [{"id": "a", "values": [1]}]})[0] == 400
    assert call(service, "POST", "/v1/indexes/ghost/upsert", {"vectors": []})[0] == 404
    status, body = call(service, "POST", "/v1/indexes/d/query", {"vector": [1] + [0] * 7, "top_k": 1})
    assert status == 200 and body["matches"][0]["id"] == "a" and body["matches"][0]["metadata"] == {"text": "bail", "k": 1}
    assert call(service, "POST", "/v1/indexes/d/query", {})[0] == 400
    assert call(service, "POST", "/v1/indexes/d/query", {"vector": [1.0] * 8, "hybrid": True})[0] == 400
    assert len(call(service, "POST", "/v1/indexes/d/query", {"text": "bail", "hybrid": True, "alpha": 0})[1]["matches"]) == 2
    assert call(service, "GET", "/v1/indexes")[1]["indexes"] == [{"name": "d", "dimension": 8, "metric": "cosine", "count": 2}]
    assert call(service, "POST", "/v1/indexes/d/delete", {"ids": ["b", "ghost"]}) == (200, {"deleted": 1})
    assert [v["id"] for v in call(service, "GET", "/v1/indexes/d/export")[1]["vectors"]] == ["a"]
    assert call(service, "POST", "/v1/indexes/d/ingest", upload=("a.txt", b"some text"))[1] == {"source": "a.txt", "chunks": 1, "upserted": 1}
    assert call(service, "POST", "/v1/indexes/d/ingest", upload=("a.txt", b""))[0] == 400
    assert call(service, "POST", "/v1/indexes/d/ingest", upload=("a.xyz", b"x"))[0] == 400
    assert call(service, "POST", "/v1/indexes/d/ingest", upload=("a.txt", b"x" * 2000))[0] == 413
    assert call(service, "POST", "/v1/indexes/d/ingest")[0] == 422
    assert call(service, "DELETE", "/v1/indexes/d") == (200, {"deleted": "d"})
    assert call(service, "DELETE", "/v1/indexes/d")[0] == 404
    assert call(service, "DELETE", "/v1/indexes/a b")[0] == 400
    assert call(service, "GET", "/nothing")[0] == 404


def test_http(service):
    server = make_server(service, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"

    def fetch(path, data=None, **headers):
        try:
            with urllib.request.urlopen(urllib.request.Request(base + path, data, {"Authorization": "Bearer key"} | headers), timeout=60) as r:
                return r.status, r.read(), r.headers
        except urllib.error.HTTPError as e:
            return e.code, e.read(), e.headers

    try:
        assert b"Collections" in fetch("/dashboard")[1]
        status, body, headers = fetch("/health", Origin="http://a.example")
        assert status == 200 and json.loads(body)["status"] == "ok" and headers["Access-Control-Allow-Origin"] == "http://a.example"
        assert fetch("/health", Origin="http://b.example")[2]["Access-Control-Allow-Origin"] is None
        assert fetch("/v1/indexes", json.dumps({"name": "h", "dimension": 8}).encode())[0] == 201
        assert fetch("/v1/indexes", b"[1]")[0] == 422 and fetch("/v1/indexes", b"{")[0] == 422
        form = b'--x\r\nContent-Disposition: form-data; name="file"; filename="n.md"\r\n\r\n# Hello there\r\n--x--\r\n'
        status, body, _ = fetch("/v1/indexes/h/ingest?max_words=2&overlap=0", form, **{"Content-Type": "multipart/form-data; boundary=x"})
        assert (status, json.loads(body)) == (200, {"source": "n.md", "chunks": 2, "upserted": 2})
        assert fetch("/v1/indexes/h/ingest", b"x" * 200_000)[0] == 413
    finally:
        server.shutdown()
        server.server_close()


def test_parse_upload_and_settings():
    assert parse_upload("multipart/form-data; boundary=x", b"--x--\r\n") is None
    s = Settings(env={"VK_DATA_DIR": "d", "VK_API_KEY": "k", "VK_CORS_ORIGINS": "a, b,", "VK_MAX_UPLOAD_MB": "2"})
    assert (s.data_dir, s.api_key, s.cors_origins, s.max_upload_mb) == ("d", "k", ["a", "b"], 2.0)
    assert Settings(data_dir="x", env={"VK_DATA_DIR": "d"}).data_dir == "x"
    assert Settings(env={}).data_dir == "./data"
    assert cli.parser().parse_args(["serve", "--port", "9"]).port == 9
