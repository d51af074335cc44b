"""The engine from end to end on a store of its own."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwork.operators.answers import NOTHING_FOUND
from loomwork.plans.engine import BlankQuestion, Engine, NotAPdf, judged
from loomwork.session import table
from loomwork.sources.pdf import pdf_pages, text_pages
from loomwork.sources.store import ChunkStore, DuplicateIds
from loomwork.streaming.incremental import ingest_stream, page_stream


@pytest.fixture()
def engine(spark, tmp_path):
    return Engine(spark, str(tmp_path / "store"), str(tmp_path / "data"))


@pytest.fixture(scope="module")
def pages(spark, sf):
    return text_pages(table(spark, sf, "documents")).limit(40).persist()


def test_ingest_twice_adds_nothing_and_query_finds(engine, pages):
    assert engine.status().first().document_count == 0
    added = engine.ingest(pages)
    assert added == engine.store.count() > 40
    assert engine.ingest(pages) == 0
    row = engine.store.read().where("length(text) > 300").orderBy("id").first()
    told = engine.query(row.text)
    assert told.answer == row.text and told.sources[0] == row.id and len(told.sources) == 5
    assert engine.status().first().asDict() == {"document_count": added, "chroma_path": engine.store.path, "data_path": engine.data_path}


def test_empty_store_blank_question_and_reset(engine, pages):
    assert engine.query("anything?") .answer == NOTHING_FOUND and engine.query("x").sources == []
    for blank in ("", " ", "\t\n"):
        with pytest.raises(BlankQuestion):
            engine.query(blank)
    engine.ingest(pages.limit(3))
    assert engine.store.count() > 0
    engine.reset()
    engine.reset()
    assert engine.store.count() == 0
    assert engine.ingest(pages.limit(2), reset=True) == engine.store.count() > 0
    assert engine.health()["status"] == "ok"


def test_changed_text_is_not_updated_and_repeats_fail(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "s"))
    schema = "id string, source string, page string, chunk int, pos long, text string"
    vector = lambda t: F.array(F.length(t).cast("float"))
    assert store.add(spark.createDataFrame([("a:0:0", "a", "0", 0, 0, "old")], schema), vector) == 1
    assert store.add(spark.createDataFrame([("a:0:0", "a", "0", 0, 0, "changed"), ("a:0:1", "a", "0", 1, 0, "x")], schema), vector) == 1
    assert {r.id: r.text for r in store.read().collect()} == {"a:0:0": "old", "a:0:1": "x"}
    with pytest.raises(DuplicateIds):
        store.add(spark.createDataFrame([("b", "a", "0", 0, 0, "1"), ("b", "a", "0", 1, 0, "2")], schema), vector)


def test_only_new_chunks_are_embedded(spark, pages, tmp_path):
    class Picky:
        def embed(self, texts):
            assert all("forbidden" not in (t or "") for t in texts)
            return np.ones((len(texts), 2))

    schema = "source string, page int, pos long, text string"
    first = spark.createDataFrame([("s", 0, 0, "forbidden words")], schema)
    plain = Engine(spark, str(tmp_path / "s"))
    assert plain.ingest(first) == 1
    picky = Engine(spark, str(tmp_path / "s"), embedder=Picky())
    assert picky.ingest(first.union(spark.createDataFrame([("s", 1, 1, "fine")], schema))) == 1


def test_pdf_source(spark, tmp_path, engine):
    data = tmp_path / "data"
    data.mkdir()
    for name in ("a.pdf", "B.PDF", "c.txt"):
        (data / name).write_bytes(f"page one of {name}\fpage two".encode())
    rows = pdf_pages(spark, str(data), parse=lambda b: b.decode().split("\f")).orderBy("page").collect()
    assert [(r.page, r.text) for r in rows] == [(0, "page one of a.pdf"), (1, "page two")]
    for name in ("x.txt", "x.PDF", "../x.pdf"):
        with pytest.raises(NotAPdf):
            engine.upload(name, b"")


def test_failed_upload_restores_the_file(spark, tmp_path, engine, monkeypatch):
    data = tmp_path / "data"
    data.mkdir()
    (data / "a.pdf").write_bytes(b"old")
    def fail(*_):
        raise RuntimeError("no")

    monkeypatch.setattr(engine, "ingest", fail)
    with pytest.raises(RuntimeError):
        engine.upload("a.pdf", b"new")
    assert (data / "a.pdf").read_bytes() == b"old" and [p.name for p in data.glob("[!.]*")] == ["a.pdf"]
    monkeypatch.setattr(engine, "ingest", lambda: 3)
    assert engine.upload("a.pdf", b"new") == 3 and (data / "a.pdf").read_bytes() == b"new"


def test_stream_restart_adds_nothing(spark, engine, pages, tmp_path):
    folder = str(tmp_path / "in")
    part = pages.select("source", F.col("page").cast("int"), "pos", "text")
    part.limit(10).write.parquet(folder)
    run = lambda: ingest_stream(engine, page_stream(engine, folder), str(tmp_path / "ck")).awaitTermination()
    run()
    first = engine.store.count()
    run()
    assert engine.store.count() == first > 0
    part.write.mode("append").parquet(folder)
    run()
    assert engine.store.read().select("source", "page").distinct().count() == 40


def test_judge(spark, engine, pages):
    engine.ingest(pages.limit(5))
    text = engine.store.read().orderBy("id").first().text
    cases = spark.createDataFrame([(1, text, text), (2, text, "other")], "query_id long, question string, expected string")
    got = judged(engine, cases, lambda a, b: (a == b).cast("string"))
    assert {r.query_id: r.passed for r in got.collect()} == {1: True, 2: False}
