"""Registered queries against their SQL, and the driver's entry points."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from loomwork.functions.models import TermEmbedder, embed_column
from loomwork.plans import queries
from loomwork.sources.store import ChunkStore


def frames(spark, sf, name):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"create view {f[:-8]} as select * from '{sf}/{f}'")
    got, want = entry.queries()[name](spark, sf).toPandas(), con.execute(entry.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns and len(got) == len(want)
    a, b = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, want))
    return a, b.astype(a.dtypes.to_dict())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, sf, name):
    got, want = frames(spark, sf, name)
    assert got.equals(want)


def test_entry(spark):
    assert entry.entry(spark).count() == 200


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["existing_ids", "store_count", "ingest_new_chunks"])
def test_store_queries_write_a_store(spark, sf, monkeypatch, name):
    added, add = [], ChunkStore.add
    monkeypatch.setattr(ChunkStore, "add", lambda self, *a: added.append(add(self, *a)) or added[-1])
    rows = entry.queries()[name](spark, sf).count()
    [n] = added
    chunks = queries._chunks(spark, sf).count()
    assert n == chunks if name != "ingest_new_chunks" else n + rows == chunks


def test_store_takes_all_chunks(spark, sf, tmp_path):
    chunks = queries._chunks(spark, sf)
    store = ChunkStore(spark, str(tmp_path / "store"))
    assert store.add(chunks, lambda text: embed_column(text, TermEmbedder())) == store.count() == chunks.count()
    assert sorted(r.id for r in store.ids().collect()) == sorted(r.id for r in chunks.select("id").collect())
