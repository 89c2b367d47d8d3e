import io
import threading
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tamarack.sources import embed, extract, ingest
from tamarack.sources.catalog import Catalog
from tamarack.sources.collection import Collection
from tamarack.streaming.upserts import stream_upserts, upsert_rates


def item(i, values, **metadata):
    return {"id": i, "values": values, "metadata": metadata}


@pytest.fixture
def small(spark, tmp_path):
    return Collection.create(spark, str(tmp_path / "c"), 3)


def test_nearest_first_filters_and_empty(small):
    assert small.query([1, 0, 0]) == []
    assert small.upsert([]) == 0
    assert small.upsert([item("x", [1, 0, 0], source="doc1"), item("y", [0, 1, 0], source="doc2"), item("z", [0.9, 0.1, 0], source="doc3")]) == 3
    found = small.query([1, 0, 0], top_k=2)
    assert [m.id for m in found] == ["x", "z"] and found[0].score > found[1].score
    assert [m.id for m in small.query([1, 0, 0], filter={"source": "doc2"})] == ["y"]
    assert {m.id for m in small.query([1, 0, 0], filter={"source": ["doc1", "doc3"]})} == {"x", "z"}
    assert small.query([1, 0, 0], top_k=0) == []
    with pytest.raises(ValueError):
        small.query([1, 0])
    with pytest.raises(ValueError):
        small.query([1, 0, 0], hybrid=True)


def test_replace_last_wins_and_bad_batch(small):
    assert small.upsert([item("a", [1, 0, 0], text="old"), item("a", [0, 3, 4], text="new", v=[1, 2])]) == 2
    with pytest.raises(ValueError):
        small.upsert([item("b", [1, 0, 0]), item("c", [1, 0])])
    out = small.export()
    assert out["dimension"] == 3 and out["metric"] == "cosine" and len(out["vectors"]) == 1
    assert out["vectors"][0]["values"] == pytest.approx([0, 0.6, 0.8], abs=1e-6)
    assert out["vectors"][0]["metadata"] == {"text": "new", "v": [1, 2]}
    small.upsert([item("b", [1, 0, 0]), {"id": "a", "values": [1, 0, 0]}])
    assert [v["id"] for v in small.export()["vectors"]] == ["b", "a"]
    assert small.export()["vectors"][1]["metadata"] == {}


def test_delete_erases_files(small, tmp_path):
    small.upsert([item("a", [1, 0, 0], source="d1", text="secret words")])
    small.upsert([item("b", [0, 1, 0], source="d1"), item("c", [0, 0, 1], source="d2")])
    assert small.delete(ids=["ghost"]) == 0 and small.delete() == 0 and small.delete(filter={}) == 0
    assert small.delete(ids=["a", "ghost"]) == 1 and small.count() == 2
    assert small.delete(filter={"source": "d1"}) == 1
    assert [v["id"] for v in small.export()["vectors"]] == ["c"]
    segments = [p for p in (tmp_path / "c").iterdir() if p.name.startswith("segment-")]
    assert len(segments) == 2


def test_hybrid_breaks_the_tie(small):
    small.upsert([item("a", [1, 0, 0], text="contrat de bail"), item("b", [1, 0, 0], text="clause de non-concurrence"), item("n", [0, 1, 0], text=7)])
    assert small.query([1, 0, 0], hybrid=True, text="non-concurrence", alpha=0.5)[0].id == "b"


def test_quantised_backend(spark, tmp_path):
    c = Collection.create(spark, str(tmp_path / "q"), 16, backend="turbovec")
    x = np.random.default_rng(1).standard_normal((40, 16))
    c.upsert([item(f"v{i}", x[i].tolist(), src="a" if i % 2 else "b", text=f"word{i}") for i in range(40)])
    assert c.query(x[7].tolist(), top_k=3)[0].id == "v7"
    assert all(m.metadata["src"] == "b" for m in c.query(x[7].tolist(), filter={"src": "b"}))
    assert c.query(x[7].tolist(), hybrid=True, text="word7")[0].id == "v7"
    assert c.codes().count() == 40


def test_create_checks_and_reopen(spark, tmp_path):
    with pytest.raises(ValueError):
        Collection.create(spark, str(tmp_path / "e"), 3, metric="euclidean")
    with pytest.raises(ValueError):
        Collection.create(spark, str(tmp_path / "e"), 3, backend="other")
    with pytest.raises(FileNotFoundError):
        Collection(spark, str(tmp_path / "none"))
    Collection.create(spark, str(tmp_path / "e"), 2).upsert([item("a", [1, 0])])
    again = Collection.create(spark, str(tmp_path / "e"), 2, bit_width=3)
    assert again.count() == 1 and again.bit_width == 3
    assert Collection.stat(spark, str(tmp_path / "e")) == {"dimension": 2, "metric": "cosine", "count": 1}


def test_many_writes_are_compacted(spark, tmp_path, monkeypatch):
    from tamarack.sources import collection

    monkeypatch.setattr(collection, "COMPACT", 3)
    c = Collection.create(spark, str(tmp_path / "m"), 2)
    for i in range(6):
        c.upsert([item(f"a{i % 2}", [1, i], n=i)])
    assert c.count() == 2 and {v["metadata"]["n"] for v in c.export()["vectors"]} == {4, 5}
    assert len([p for p in (tmp_path / "m").iterdir() if p.name.startswith("segment-")]) <= 4


def test_writers_and_readers_together(spark, tmp_path):
    path = str(tmp_path / "t")
    c, errors = Collection.create(spark, path, 2), []
    other = Collection(spark, path)  # as another process would have it

    def write(where, name):
        try:
            for i in range(4):
                where.upsert([item(f"{name}{i}", [1, i], text="hello world")])
        except Exception as e:
            errors.append(e)

    def read():
        try:
            for _ in range(3):
                c.query([1, 0], hybrid=True, text="hello")
                c.query([1, 0])
        except Exception as e:
            errors.append(e)

    threads = [threading.Thread(target=write, args=(c, "a")), threading.Thread(target=write, args=(other, "b")), threading.Thread(target=read)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not errors and Collection(spark, path).count() == 8


def test_catalog(spark, tmp_path):
    cat = Catalog(spark, str(tmp_path / "root"), cache_size=2)
    for n in ("docs", "notes", "i1"):
        cat.create(n, 2)
    with pytest.raises(ValueError, match="already exists"):
        cat.create("docs", 2)
    for bad in ("../escape", "a/b", "", ".", "abc\n", None):
        with pytest.raises(ValueError):
            cat.create(bad, 2)
    for n in ("docs", "notes", "i1"):
        cat.get(n)
    assert cat.opened() == ["notes", "i1"]
    cat.get("docs").upsert([item("a", [1, 0])])
    assert cat.list() == [{"name": n, "dimension": 2, "metric": "cosine", "count": int(n == "docs")} for n in ("docs", "i1", "notes")]
    cat.drop("docs")
    for call in (cat.get, cat.drop):
        with pytest.raises(KeyError):
            call("docs")


def test_extract():
    assert extract.extract_text(b" hello world\n", "a.TXT") == "hello world"
    assert extract.extract_text(b"# Title", "a.md") == "# Title"
    assert extract.extract_text(b"a\xffb", "a.txt") == "a�b"
    assert extract.extract_text(b"name,age,city\nAlice,30,Paris\nBob,25\n,,\nEve,1,Rome,extra", "a.csv") == "name: Alice | age: 30 | city: Paris\nname: Bob | age: 25\nname: Eve | age: 1 | city: Rome"
    assert extract.extract_text(b'x,y\n"a\nb","c, d"', "a.csv") == "x: a\nb | y: c, d"
    assert extract.extract_text(b"", "a.csv") == ""
    html = b"<title>T</title><style>p{}</style><h1>Hi &amp; ho</h1><script>var x=1<2</script><p>Para</p>tail AT&T"
    assert extract.extract_text(html, "a.htm") == "T\nHi & ho\nPara\ntail AT&T"
    with pytest.raises(ValueError):
        extract.extract_text(b"", "a.xyz")


def docx(*paragraphs):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}<w:tbl><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tbl></w:body></w:document>')
    return out.getvalue()


def test_extract_docx_and_column(spark):
    assert extract.extract_text(docx("One", " ", "Two"), "a.docx") == "One\nTwo"
    rows = [(docx("One"), "a.docx"), (b"broken", "b.docx"), (b"x", "c.unknown"), (None, "d.txt"), (b"x", None), (b" y ", "e.txt")]
    got = [r.t for r in spark.createDataFrame(rows, "content binary, name string").coalesce(1).select(extract.extract_column("content", "name").alias("t")).collect()]
    assert got == ["One", None, None, None, None, "y"]


def test_hash_embedder(spark):
    a, b = embed.HashEmbedder(32), embed.make_embedder("hash", dimension=32)
    x = a.embed_documents(["clause", "autre"])
    assert x.dtype == np.float32 and np.allclose(np.linalg.norm(x, axis=1), 1, atol=1e-6)
    assert np.array_equal(x[0], b.embed_query("clause")) and not np.allclose(x[0], x[1])
    assert a.embed_documents([]).shape == (0, 32) and isinstance(a, embed.Embedder)
    with pytest.raises(ValueError):
        embed.make_embedder("none")
    assert embed.embedder_from_env({"VK_EMBED_BACKEND": "hash", "VK_EMBED_DIM": "8"}) == ("hash", {"dimension": 8})
    assert embed.embedder_from_env({}) == ("sentence-transformers", {})
    df = spark.createDataFrame([("clause",), (None,)], "t string").coalesce(1)
    got = [r.v for r in df.select(embed.embed_column("hash", dimension=32)(F.col("t")).alias("v")).collect()]
    assert np.allclose(got[0], x[0]) and got[1] is None


def test_ingest(spark, tmp_path):
    c = Collection.create(spark, str(tmp_path / "i"), 32)
    ing = ingest.Ingestor(embed.HashEmbedder(32))
    text = " ".join(f"word{i}" for i in range(120)).encode()
    assert ing.ingest(text, "a.txt", c, max_words=50, overlap=10) == {"source": "a.txt", "chunks": 3, "upserted": 3}
    top = c.query(embed.HashEmbedder(32).embed_query(ingest.cut(text.decode(), 50, 10)[1]).tolist(), 1)[0]
    assert top.id == "a.txt#1" and set(top.metadata) == {"text", "source", "chunk"}
    assert ing.ingest(b"short", "a.txt", c, replace_source=True)["chunks"] == 1 and c.count() == 1
    assert ing.ingest(b"  ", "b.txt", c) == {"source": "b.txt", "chunks": 0, "upserted": 0}
    with pytest.raises(ValueError):
        ing.ingest(text, "a.txt", Collection.create(spark, str(tmp_path / "j"), 8))


def test_ingest_of_a_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text(" ".join(f"w{i}" for i in range(900)))
    (tmp_path / "in" / "b.html").write_text("<p>hello</p>")
    (tmp_path / "in" / "c.bin").write_text("x")
    files = spark.read.format("binaryFile").load(str(tmp_path / "in")).select("path", "content")
    c = Collection.create(spark, str(tmp_path / "f"), 16)
    assert c.upsert_frame(ingest.records(files, embed.embed_column("hash", dimension=16)).withColumn("seq", F.row_number().over(__import__("pyspark").sql.Window.orderBy("id")).cast("long"))) == 4
    assert [v["id"] for v in c.export()["vectors"]] == ["a.txt#0", "a.txt#1", "a.txt#2", "b.html#0"]


def test_streams(spark, tmp_path):
    rows = [("a", [1.0, 0.0], "{}", 0), ("b", [0.0, 1.0], None, 1), ("a", [0.0, 2.0], "{}", 2)]
    spark.createDataFrame(rows, "id string, values array<double>, metadata string, seq long").coalesce(1).write.parquet(str(tmp_path / "s"))
    c = Collection.create(spark, str(tmp_path / "sc"), 2)
    stream = spark.readStream.schema("id string, values array<double>, metadata string, seq long").parquet(str(tmp_path / "s"))
    stream_upserts(stream, c, str(tmp_path / "check")).awaitTermination()
    assert {v["id"]: v["values"] for v in c.export()["vectors"]} == {"a": [0.0, 1.0], "b": [0.0, 1.0]}
    spark.sql("select timestamp'2024-01-01 00:10:00' upserted_at, 'x' index_name union all select timestamp'2024-01-01 00:20:00', 'x' union all select timestamp'2024-02-01 00:00:00', 'y'").write.parquet(str(tmp_path / "t"))
    stream = spark.readStream.schema("upserted_at timestamp, index_name string").parquet(str(tmp_path / "t"))
    q = upsert_rates(stream).writeStream.format("memory").queryName("rates").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.index_name, r.n) for r in spark.table("rates").collect()} == {("x", 2), ("y", 1)}
