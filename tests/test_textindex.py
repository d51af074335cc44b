"""The text index: the rows of a full scan, from part of the blocks."""

import numpy as np
import pytest

from loomwork.functions.text import BUCKETS, term_matrix
from loomwork.operators import retrieval, textindex
from loomwork.operators.textindex import TextIndex, packed_counts, unpacked_counts

WORDS = [f"{a}{b}{c}" for a in "kmrstpln" for b in "aeiou" for c in "xyz"]


def corpus(n=600):
    rng = np.random.default_rng(7)
    topics = [rng.permutation(WORDS)[:12] for _ in range(8)]
    texts = [" ".join(rng.choice(topics[i % 8], rng.integers(5, 40))) for i in range(n)]
    return [(f"c{i:04d}", t) for i, t in enumerate(texts)] + [("blank1", "?!"), ("blank2", None), ("copy", texts[3]), ("copy", texts[3])]


def scan(rows, questions, k=5):
    counts, ids, out = term_matrix([t for _, t in rows]), [i for i, _ in rows], []
    near = np.round(retrieval.unit_distances(counts, term_matrix([t for _, t in questions])), 6)
    for j, (q, _) in enumerate(questions):
        best = sorted(zip(near[:, j].tolist(), ids))[:k]
        out += [(q, r, i, d) for r, (d, i) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize("wave, group", [(1_024, 256), (3, 2)])
def test_rows_of_a_full_scan(spark, tmp_path, monkeypatch, wave, group):
    monkeypatch.setattr(textindex, "WAVE", wave)
    monkeypatch.setattr(textindex, "GROUP", group)
    rows = corpus()
    questions = [(i, rows[i * 37][1]) for i in range(14)] + [(90, ""), (91, None), (92, "never seen words"), (93, "?"), (94, rows[3][1] + " kax")]
    index = TextIndex.build(spark.createDataFrame(rows, "id string, text string").repartition(4), str(tmp_path / "index"))
    got = index.search(spark.createDataFrame(questions, "query_id long, text string"))
    assert sorted(tuple(r) for r in got.collect()) == scan(rows, questions)
    assert 0 < index.looked_at < index.of and index.of == index._postings().count() * len(questions)
    some = [q for q in questions if q[0] < 14]
    assert sorted(tuple(r) for r in index.search(spark.createDataFrame(some, "query_id long, text string"), k=2).collect()) == scan(rows, some, 2)
    assert index.looked_at < 0.6 * index.of  # of questions with terms, most blocks are passed over


def test_small_tables(spark, tmp_path):
    rows = corpus()[:3]
    index = TextIndex.build(spark.createDataFrame(rows, "id string, text string"), str(tmp_path / "few"))
    asked = spark.createDataFrame([(1, rows[0][1])], "query_id long, text string")
    assert sorted(tuple(r) for r in index.search(asked).collect()) == scan(rows, [(1, rows[0][1])])
    assert index.search(asked.limit(0)).count() == 0
    empty = TextIndex.build(spark.createDataFrame([], "id string, text string"), str(tmp_path / "none"))
    assert empty.search(asked).count() == 0 and empty.of == 0


def test_packed_counts():
    counts = term_matrix(["a b b c", None, "x"])
    assert (unpacked_counts(packed_counts(counts), 3) == counts).all() and counts.shape == (3, BUCKETS)
