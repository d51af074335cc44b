"""What workers of the retrieval operators hold stays bounded, whatever a batch holds."""

import tracemalloc

import numpy as np
import pandas as pd

from loomwork.operators import retrieval, vectorindex


def peak(make) -> int:
    tracemalloc.start()
    make()
    found = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return found


def test_distances_to_many_queries_are_made_in_parts():
    rng = np.random.default_rng(1)
    rows, queries = pd.DataFrame({"id": np.arange(4_096), "vector": list(rng.normal(size=(4_096, 8)))}), rng.normal(size=(4_096, 8))
    assert peak(lambda: retrieval._best(rows, np.arange(4_096), queries, 5, retrieval.squared_distances, retrieval.stacked)) < 100 << 20


def test_distances_to_centres_are_made_in_parts():
    rows = np.random.default_rng(2).normal(size=(20_000, 16))
    assert peak(lambda: vectorindex.Model.fit(rows, 1_024)) < 80 << 20
    model = vectorindex.Model(rows[:1_024], [])
    assert peak(lambda: model.nearest_cells(rows, 4)) < 30 << 20
    near = vectorindex.squared(rows[:500], model.cells)
    assert (model.nearest_cells(rows[:500], 4) == np.argsort(near, axis=1, kind="stable")[:, :4]).all()
