"""The approximate index against brute force."""

import numpy as np
import pytest

from loomwork.operators import vectorindex
from loomwork.operators.vectorindex import VectorIndex

SCHEMA = "id long, vector array<float>"


def exact(rows, queries, k=5):
    out = {}
    for q, v in queries:
        near = sorted((round(sum((float(np.float32(a)) - float(np.float32(b))) ** 2 for a, b in zip(v, w)), 6), i) for i, w in rows)
        out[q] = [i for _, i in near[:k]]
    return out


def hits(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append(r.id)
    return out


def recall(got, want):
    return sum(len(set(got.get(q, [])) & set(w)) for q, w in want.items()) / sum(map(len, want.values()))


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 18))
    vectors = centres[rng.integers(0, 12, 1_500)] + 0.3 * rng.normal(size=(1_500, 18))
    return [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]


def test_recall_and_reopening(spark, rows, tmp_path, monkeypatch):
    monkeypatch.setattr(vectorindex, "PART", 50)  # cells of several parts and query blocks
    monkeypatch.setattr(vectorindex, "BLOCK", 7)
    queries = rows[::20]
    frame, asked = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(queries, "query_id long, vector array<float>")
    index = VectorIndex.build(frame, str(tmp_path / "index"))
    assert index.codes().count() == len(rows) and 1 <= index.probed < len(index.model.cells)
    want = exact(rows, queries)
    got = hits(index.search(asked))
    assert {len(x) for x in got.values()} == {5} and recall(got, want) >= 0.95
    again = VectorIndex.open(spark, str(tmp_path / "index"))
    assert hits(again.search(asked)) == got
    assert hits(again.search(asked, probes=len(again.model.cells), shortlist=len(rows))) == want  # all of it is exact
    few = hits(again.search(asked, k=400, probes=1))  # cells too small for k: searched exactly
    assert few == exact(rows, queries, 400)


def test_odd_rows(spark, rows, tmp_path):
    same = [(10_000 + i, rows[3][1]) for i in range(200)]
    odd = [(20_000, None), (20_001, []), (20_002, [float("nan")] * 18), (20_003, [None] * 18), (None, rows[0][1]), (3, rows[3][1])]
    frame = spark.createDataFrame(rows[:100] + same + odd, SCHEMA)
    index = VectorIndex.build(frame, str(tmp_path / "odd"))
    assert index.codes().count() == 301
    asked = spark.createDataFrame([(1, rows[3][1]), (2, None), (3, [float("inf")] * 18)], "query_id long, vector array<float>")
    got = hits(index.search(asked, shortlist=400))
    assert got == {1: [3, 3, 10_000, 10_001, 10_002]}
    empty = VectorIndex.build(frame.limit(0), str(tmp_path / "empty"))
    assert empty.search(asked).count() == 0
    with pytest.raises(ValueError, match="lengths from 2 to 18"):
        VectorIndex.build(spark.createDataFrame([*rows[:2], (5, [1.0, 2.0])], SCHEMA), str(tmp_path / "bad"))


def test_string_ids_and_few_rows(spark, tmp_path):
    rows = [("a", [0.0, 1.0]), ("b", [1.0, 0.0]), ("c", [1.0, 1.0])]
    index = VectorIndex.build(spark.createDataFrame(rows, "id string, vector array<double>"), str(tmp_path / "few"))
    got = hits(index.search(spark.createDataFrame([(7, [0.9, 0.1])], "query_id long, vector array<double>")))
    assert got == {7: ["b", "c", "a"]}


def test_codes_are_near_their_rows(rows):
    vectors = np.array([v for _, v in rows])
    model = vectorindex.Model.fit(vectors, 30)
    cells = model.nearest_cells(vectors, 1)[:, 0]
    codes = model.encode(vectors, cells)
    true = ((vectors[:50, None] - vectors[None]) ** 2).sum(-1)
    told = np.stack([[model.distances(q, c, code[None])[0] for c, code in zip(cells, codes)] for q in vectors[:50]])
    assert np.corrcoef(true.ravel(), told.ravel())[0, 1] > 0.95
    back = vectorindex.Model.unpacked(model.packed())
    assert (back.cells == model.cells).all() and all((a == b).all() for a, b in zip(back.books, model.books))
