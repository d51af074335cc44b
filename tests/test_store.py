"""Snapshots, killed and concurrent writers, and the filters of the chunk store."""

import pytest
from pyspark.sql import functions as F

from loomwork.sources import store as stores
from loomwork.sources.store import ChunkStore, ConcurrentWrite

SCHEMA = "id string, source string, page string, chunk int, pos long, text string"


def chunks(spark, name, n, start=0):
    return spark.createDataFrame([(f"{name}:{i}:0", name, str(i), 0, i, f"text {name} {i}") for i in range(start, start + n)], SCHEMA)


def vector(text):
    return F.array(F.length(text).cast("float"))


class Killed(Exception):
    pass


def die(*_):
    raise Killed


@pytest.fixture
def store(spark, tmp_path):
    return ChunkStore(spark, str(tmp_path / "store"))


def test_snapshots(spark, store):
    assert store.snapshot() == (0, []) and store.count() == 0
    store.reset()
    assert store.snapshot() == (0, [])
    assert store.add(chunks(spark, "a", 30), vector) == 30
    assert store.add(chunks(spark, "a", 40), vector) == 10
    assert store.add(chunks(spark, "a", 40), vector) == 0
    assert store.snapshot()[0] == 2 and store.count() == 40
    store.reset()
    assert store.snapshot() == (3, []) and store.count() == 0 and store._names("batches") == {}
    assert store.add(chunks(spark, "b", 5), vector) == 5 == store.count()


@pytest.mark.parametrize("step", ["_write", "_commit"])
def test_a_killed_add_leaves_the_store_as_it_was(spark, store, monkeypatch, step):
    store.add(chunks(spark, "a", 30), vector)
    before = store.snapshot()
    monkeypatch.setattr(stores, "drop", lambda *_: None)  # a killed driver deletes nothing
    if step == "_write":  # killed with the data written, but not the filters
        write = ChunkStore._write
        monkeypatch.setattr(ChunkStore, "_write", lambda *a: (write(*a), die()))
    else:
        monkeypatch.setattr(ChunkStore, step, die)
    with pytest.raises(Killed):
        store.add(chunks(spark, "b", 20), vector)
    monkeypatch.undo()
    assert store.snapshot() == before and store.count() == 30 and len(store._names("batches")) == 2
    assert store.vacuum() == 0 and store.vacuum(older_than=0) == 1 and store.count() == 30
    assert store.add(chunks(spark, "b", 20), vector) == 20


def test_a_killed_reset_is_before_or_after(spark, store, monkeypatch):
    store.add(chunks(spark, "a", 30), vector)
    monkeypatch.setattr(ChunkStore, "_commit", die)
    with pytest.raises(Killed):
        store.reset()
    monkeypatch.undo()
    assert store.count() == 30
    monkeypatch.setattr(stores, "drop", die)
    with pytest.raises(Killed):
        store.reset()
    monkeypatch.undo()
    assert store.count() == 0 and len(store._names("batches")) == 1
    assert store.add(chunks(spark, "a", 3), vector) == 3 and store.vacuum(older_than=0) == 1 and store.count() == 3


def test_a_second_writer_is_refused(spark, store, tmp_path, monkeypatch):
    store.add(chunks(spark, "a", 10), vector)
    write = ChunkStore._write

    def meanwhile(self, *args):
        monkeypatch.undo()
        ChunkStore(spark, store.path).add(chunks(spark, "b", 7), vector)
        return write(self, *args)

    monkeypatch.setattr(ChunkStore, "_write", meanwhile)
    with pytest.raises(ConcurrentWrite):
        store.add(chunks(spark, "c", 5), vector)
    assert store.count() == 17 and store.read().where("source = 'c'").count() == 0
    assert len(store._names("batches")) == 2 and not [n for n in store._names("log") if n.startswith(".") and not n.endswith(".crc")]


def test_unrelated_files_are_not_opened(spark, store, monkeypatch):
    monkeypatch.setattr(stores, "FILE_ROWS", 50)
    monkeypatch.setattr(stores, "PART", 40)
    for name in ("a", "b", "c"):
        store.add(chunks(spark, name, 200), vector)
    batches = store.snapshot()[1]
    files = [f"{b}/data/{n}" for b in batches for n in store._names("batches", b, "data") if n.endswith(".parquet")]
    assert len(files) >= 9
    assert len(store.may_hold(chunks(spark, "new", 30), batches)) <= 0.5 * len(files)  # one in a hundred ids is let through
    [one] = {f.split("/")[0] for f in store.may_hold(chunks(spark, "b", 1), batches)} & {batches[1]}
    assert one == batches[1]
    opened = []
    known = ChunkStore.known
    monkeypatch.setattr(ChunkStore, "known", lambda self, rows: opened.append(known(self, rows)) or opened[-1])
    assert store.add(chunks(spark, "b", 3, start=199), vector) == 2
    assert 0 < opened[0].count() < 200
    everything = {r.id for r in store.ids().collect()}
    for name in ("a", "b", "c"):  # a filter never misses an id
        held = chunks(spark, name, 200)
        assert {r.id for r in store.known(held).join(held, "id", "left_semi").collect()} == {r.id for r in held.collect()} <= everything


def test_ids_may_be_null(spark, store):
    rows = spark.createDataFrame([(None, "s", "0", 0, 0, "x"), ("a", "s", "1", 0, 1, None)], SCHEMA)
    assert store.add(rows, vector) == 2
    assert store.add(rows, vector) == 1  # a row without an id counts as absent
    assert store.count() == 3


def test_old_snapshots_go(spark, store, monkeypatch):
    monkeypatch.setattr(stores, "KEPT", 2)
    for i in range(4):
        store.add(chunks(spark, "a", 1, start=i), vector)
    assert store._log() == [3, 4] and store.count() == 4


def test_only_new_texts_move(spark, store, monkeypatch):
    """A batch that is all new, or all there, isn't joined with the store: its texts would be shuffled for it."""
    joined, write = [], ChunkStore._write

    def seen(self, rows, *args):
        joined.append("Join" in rows._jdf.queryExecution().optimizedPlan().toString())
        return write(self, rows, *args)

    monkeypatch.setattr(ChunkStore, "_write", seen)
    assert store.add(chunks(spark, "a", 30), vector) == 30 and joined == [False]
    assert store.add(chunks(spark, "a", 30), vector) == 0 and joined == [False]  # nothing is written
    assert store.add(chunks(spark, "b", 30), vector) == 30
    assert store.add(chunks(spark, "b", 40), vector) == 10 and joined[-1] and store.count() == 70


def test_a_large_batch_is_written_in_rounds(spark, store, monkeypatch):
    dealt, deal = [], type(spark.range(1)).repartitionById
    monkeypatch.setattr(stores, "FILE_ROWS", 10)
    monkeypatch.setattr(type(spark.range(1)), "repartitionById", lambda self, n, by: dealt.append((n, self.count())) or deal(self, n, by))
    assert store.add(chunks(spark, "a", 300), vector) == 300
    assert [n for n, _ in dealt] == [10, 10, 10] and sum(rows for _, rows in dealt) == 300 and max(rows for _, rows in dealt) < 200
    assert {r.id for r in store.ids().collect()} == {f"a:{i}:0" for i in range(300)}
    assert store.add(chunks(spark, "a", 300), vector) == 0 and len(dealt) == 3
