"""Nearest chunks by squared distance, exactly: a set of queries against all rows, in blocks.

Up to QUERY_BLOCK queries are sent to every task, so what is broadcast has a fixed size. More are dealt in blocks of
that size against parts of ROW_PART rows by a join of both: each pair of a part and a block is one group of bounded
size, whatever the tables. Each task keeps k rows a query, and only those are shuffled to the last ranking. Distances
are rounded to 6 digits before they are ranked, and ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomwork.functions.text import SLICE
from loomwork.session import BROADCAST_ROWS

K, QUERY_BLOCK, ROW_BLOCK, ROW_PART = 5, 4_096, 4_096, 32_768
#: Queries whose distances to a block of rows a task holds at once: ROW_BLOCK x QUERIES numbers, a few times over.
QUERIES = 256


def unit_distances(counts: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Squared distances of vectors of counts scaled to unit length; whole numbers up to the last division."""
    a, b = (counts**2).sum(1), (queries**2).sum(1)
    root = np.sqrt(a)[:, None] * np.sqrt(b)[None]
    both = 2 - 2 * (counts @ queries.T) / np.where(root > 0, root, 1)
    return np.where(root > 0, both, ((a > 0)[:, None] != (b > 0)[None]).astype(float))


def squared_distances(rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    return np.stack([((rows - q) ** 2).sum(1) for q in queries], 1) if len(queries) else np.zeros((len(rows), 0))


def stacked(vectors: Sequence) -> np.ndarray:
    return np.stack([np.asarray(v, float) for v in vectors])


def nearest(rows: DataFrame, queries: DataFrame, *, k: int = K, distance=squared_distances, encode=stacked, id_type: str = "long") -> DataFrame:
    """(query_id, rank, id, dist) of the k nearest rows(id, vector) of each of queries(query_id, vector).

    encode makes a matrix of a sequence of vectors, which may be texts if it can embed them where it runs.
    Null vectors take no part; all vectors have one length. Repeated ids are rows of their own.
    """
    rows = rows.select("id", "vector").where("id is not null and vector is not null")
    asked = queries.select("query_id", "vector").where("vector is not null")
    first, schema = asked.limit(QUERY_BLOCK + 1).collect(), f"query_id long, id {id_type}, dist double"
    if len(first) <= QUERY_BLOCK:
        sent = rows.sparkSession.sparkContext.broadcast((np.array([r.query_id for r in first], np.int64), encode([r.vector for r in first]) if first else np.zeros((0, 1))))
        found = rows.mapInPandas(_search(sent, k, distance, encode), schema)
    else:
        parts, blocks = (max(1, -(-n // size)) for n, size in ((rows.count(), ROW_PART), (asked.count(), QUERY_BLOCK)))
        if encode is not stacked:  # embedded once, not for each block that they meet
            rows, asked = _embedded(rows, "id", encode), _embedded(asked, "query_id", encode)
            encode = stacked
        # Dealt by what is in a row, so a task that is run again deals alike.
        deal = lambda n, key: F.pmod(F.xxhash64(key, "vector"), F.lit(n)).cast("int")
        each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        left = rows.withColumn("part", deal(parts, "id")).withColumn("block", each(blocks))
        right = asked.withColumn("block", deal(blocks, "query_id")).withColumn("part", each(parts))
        found = left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInPandas(_pair(k, distance, encode), schema)
    best = F.row_number().over(Window.partitionBy("query_id").orderBy("dist", "id"))
    return found.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "id", "dist")


def _embedded(rows: DataFrame, key: str, encode) -> DataFrame:
    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in (whole.iloc[at : at + SLICE] for whole in batches for at in range(0, len(whole), SLICE)):
            yield pd.DataFrame({key: batch[key], "vector": list(encode(batch["vector"].to_numpy()))})

    return rows.select(key, "vector").mapInPandas(vectors, f"{key} {rows.schema[key].dataType.simpleString()}, vector array<double>")


def _best(rows: pd.DataFrame, query_ids: np.ndarray, queries: np.ndarray, k: int, distance, encode) -> pd.DataFrame:
    """The k best rows of each query, ROW_BLOCK rows at a time."""
    best = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "id": rows["id"].iloc[:0], "dist": pd.Series(dtype=float)})
    for at in range(0, len(rows) if len(query_ids) else 0, ROW_BLOCK):
        part = rows.iloc[at : at + ROW_BLOCK]
        ids = part["id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        vectors = encode(part["vector"].to_numpy()[order])
        found = [best]
        for q in range(0, len(query_ids), QUERIES):
            near = np.round(distance(vectors, queries[q : q + QUERIES]), 6)
            top = np.argsort(near, axis=0, kind="stable")[:k]  # ids ascend, so ties keep the smaller
            found.append(pd.DataFrame({"query_id": np.tile(query_ids[q : q + QUERIES], len(top)), "id": ids[order][top].ravel(), "dist": np.take_along_axis(near, top, 0).ravel()}))
        best = pd.concat(found).sort_values(["query_id", "dist", "id"], kind="stable").groupby("query_id").head(k)
    return best


def _search(sent, k: int, distance, encode):
    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            held.append(_best(batch, *sent.value, k, distance, encode))
            held = [pd.concat(held).sort_values(["query_id", "dist", "id"], kind="stable").groupby("query_id").head(k)]
        yield from held

    return search


def _pair(k: int, distance, encode):
    def search(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        vectors = encode(asked["vector"].tolist()) if len(asked) else np.zeros((0, 1))
        return _best(rows, asked["query_id"].to_numpy(np.int64), vectors, k, distance, encode)

    return search


def with_texts(hits: DataFrame, rows: DataFrame, most: int) -> DataFrame:
    """(query_id, rank, id, text) of hits, of which there are most at most, with the texts of rows(id, text)."""
    few = F.broadcast(hits) if most <= BROADCAST_ROWS else hits
    return rows.select("id", "text").join(few, "id").select("query_id", "rank", "id", "text")


def nearest_to_one(rows: DataFrame, vector: list[float], k: int = K) -> DataFrame:
    """(rank, id, dist) of the k nearest rows to one vector, in DataFrame functions: a top-k without a shuffle of rows."""
    query = F.array(*(F.lit(float(x)) for x in vector))
    each = F.zip_with(F.col("vector"), query, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y))
    dist = F.round(F.aggregate(each, F.lit(0.0), lambda a, x: a + x), 6)
    top = rows.where("vector is not null").select("id", dist.alias("dist")).orderBy("dist", "id").limit(k)
    return top.select(F.row_number().over(Window.orderBy("dist", "id")).alias("rank"), "id", "dist")
