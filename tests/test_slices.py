"""Steps that make no more than they must: texts embedded by slices, pages numbered where they are, a search run once."""

import numpy as np
from pyspark.sql import functions as F

from loomwork.functions.models import embed_column
from loomwork.functions.text import SLICE
from loomwork.operators import chunking, embedding, summary


def test_texts_are_embedded_by_slices(spark):
    class Few:
        def embed(self, texts):
            assert len(texts) <= 512
            return np.array([[len(t or ""), 1.0] for t in texts])

    rows = spark.range(3 * SLICE + 7, numPartitions=1).select("id", embed_column(F.repeat(F.lit("x"), (F.col("id") % 5).cast("int")), Few()).alias("v"))
    assert [list(r.v) for r in rows.orderBy("id").collect()] == [[i % 5, 1.0] for i in range(3 * SLICE + 7)]


def test_pages_of_one_row_are_numbered_where_they_are(spark, tmp_path):
    pages = [("a", 1, 0, "x" * 2_000), ("a", 2, 1, "y" * 900), (None, 1, 2, "z"), ("b", None, 3, "")]
    one = chunking.stride_chunks(spark.createDataFrame(pages, "source string, page int, pos long, text string"))
    found = chunking.numbered(one, f"{tmp_path}/1")
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()
    ids = lambda rows: sorted((r.id, r.text) for r in rows.collect())
    assert ids(found) == ids(chunking.repeated_page_ids(one))
    for more in (("a", 1, 9, "again"), ("b", None, 9, "again")):
        two = chunking.stride_chunks(spark.createDataFrame([*pages, more], "source string, page int, pos long, text string"))
        assert ids(chunking.numbered(two, f"{tmp_path}/{more[0]}")) == ids(chunking.repeated_page_ids(two))


def test_hits_are_searched_once_for_sentences(spark):
    seen = spark.sparkContext.accumulator(0)

    def search(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    rows = [(i, f"what is {i}", [f"This is {i}. That is not.", "Other words."]) for i in range(3)]
    schema = "query_id long, question string, texts array<string>"
    ready = spark.createDataFrame(rows, schema).mapInPandas(search, schema)
    chunks = spark.createDataFrame([(t,) for r in rows for t in r[2]], "text string")
    assert summary.summaries(ready, chunks).count() == 3 and seen.value == 3


def test_terms_are_added_up_together():
    names = ["a", "b", "c"]
    model = embedding.TermVectors(names, np.eye(3, 8), np.array([1.0, 0.5, 0.25]), np.zeros(8))
    texts = ["a b a", None, "c unknown", ""] * 40
    want = np.array([sum((model.whole(t) for t in embedding.terms(x)), np.zeros(8)) for x in texts])
    norm = np.linalg.norm(want, axis=1, keepdims=True)
    assert np.allclose(model.embed(texts), want / np.where(norm > 0, norm, 1))
