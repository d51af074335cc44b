"""An approximate nearest-neighbour index: inverted cells with product-quantised residuals.

Cells and codebooks are fitted by k-means, in one task, on SAMPLE vectors at most, taken by a hash of the row; every
row is then indexed. The index has two tables: `codes` (cell, part, id, code), sorted by cell and part, a code being
one byte for each group of dimensions of the vector's difference from its cell's centre; and `vectors` (id, vector).

A search sends each query to its nearest cells. How many these are is measured when the index is built: the neighbours of
TRIED rows are searched exactly, and as many cells are probed as hold RECALL of them. Cells are split in parts of about PART
rows, and the queries of a cell in blocks of about BLOCK, so what a task joins has a bounded size whatever the cell or the query set. Codes give
SHORTLIST candidates a query; their vectors are fetched and ranked by exact distance. Queries whose cells hold fewer
than k rows are searched exactly, in all rows.

Defined cases: vectors that are null, empty, or hold null or non-finite components take no part; others must have one
length. Repeated ids are rows of their own. Distances are rounded to 6 digits, ties go to the smaller id. An index of no
rows gives no hits.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomwork.operators.retrieval import K, nearest
from loomwork.session import broadcast_if_small, saved, scratch, tidy_shuffles

#: Vectors that the index is fitted on, cells, and k-means rounds, at most; dimensions of a group, and codes for it.
SAMPLE, CELLS, ROUNDS, GROUP, CODES = 20_000, 1_024, 12, 4, 256
#: Rows whose neighbours tell how many cells to probe, and the share of these that must be there.
TRIED, RECALL = 256, 0.98
#: Rows of a part, queries of a block, candidates for each query, cells that bound these.
PART, BLOCK, SHORTLIST, FIRST = 32_768, 1_024, 128, 4
#: Distances to centres, and probes, that a task makes at once, about.
HELD = 1 << 18


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & sound, F.lit(False))


def squared(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """(rows, centres) squared distances, up to rounding."""
    return np.maximum((rows**2).sum(1)[:, None] + (centres**2).sum(1)[None] - 2 * rows @ centres.T, 0)


def nearest_centres(rows: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the nearest centre, and its squared distance."""
    own, dist, step = np.zeros(len(rows), np.int64), np.zeros(len(rows)), max(1, HELD // max(1, len(centres)))
    for at in range(0, len(rows), step):
        near = squared(rows[at : at + step], centres)
        own[at : at + step] = near.argmin(1)
        dist[at : at + step] = near.min(1)
    return own, dist


def kmeans(rows: np.ndarray, n: int, rounds: int = ROUNDS, seed: int = 0) -> np.ndarray:
    """n centres of rows, or fewer where fewer rows differ; a centre that loses its rows takes the row that lies worst."""
    rows = np.unique(rows, axis=0)
    if len(rows) <= n:
        return rows
    centres = rows[np.sort(np.random.default_rng(seed).choice(len(rows), n, replace=False))]
    for _ in range(rounds):
        own, dist = nearest_centres(rows, centres)
        sums, counts = np.zeros_like(centres), np.bincount(own, minlength=n)
        np.add.at(sums, own, rows)
        centres = sums / np.maximum(counts, 1)[:, None]
        far = np.argsort(-dist, kind="stable")
        empty = np.flatnonzero(counts == 0)
        centres[empty] = rows[far[: len(empty)]]
    return centres


@dataclass
class Model:
    """Centres of cells, and for each group of dimensions the codebook of differences from them."""

    cells: np.ndarray
    books: list[np.ndarray]

    @classmethod
    def fit(cls, rows: np.ndarray, cells: int, seed: int = 0, coded: bool = True) -> Model:
        centres = kmeans(rows, cells, seed=seed)
        if not coded:
            return cls(centres, [])
        rest = rows - centres[nearest_centres(rows, centres)[0]]
        return cls(centres, [kmeans(part, CODES, seed=seed) for part in cls.groups(rest)])

    @staticmethod
    def groups(rows: np.ndarray) -> list[np.ndarray]:
        return np.array_split(rows, max(1, rows.shape[1] // GROUP), axis=1)

    def nearest_cells(self, rows: np.ndarray, n: int) -> np.ndarray:
        step = max(1, HELD // max(1, len(self.cells)))
        found = [np.argsort(squared(rows[at : at + step], self.cells), axis=1, kind="stable")[:, :n].copy() for at in range(0, len(rows), step)]
        return np.concatenate(found) if found else np.zeros((0, min(n, len(self.cells))), np.int64)

    def encode(self, rows: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """(rows, groups) codes of the rows' differences from their cells."""
        return np.stack([nearest_centres(part, book)[0] for part, book in zip(self.groups(rows - self.cells[cells]), self.books)], 1).astype(np.uint8)

    def distances(self, query: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Approximate squared distances of coded rows of a cell to a query: table look-ups."""
        tables = [squared(part, book)[0] for part, book in zip(self.groups((query - self.cells[cell])[None]), self.books)]
        total = np.zeros(len(codes))
        for group, table in enumerate(tables):
            total += table[codes[:, group]]
        return total

    def packed(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, cells=self.cells, **{f"book{i:05d}": b for i, b in enumerate(self.books)})
        return out.getvalue()

    @classmethod
    def unpacked(cls, data: bytes) -> Model:
        held = np.load(io.BytesIO(data))
        return cls(held["cells"], [held[k] for k in sorted(held.files) if k != "cells"])


def fit(rows: DataFrame, n: int, cells: int | None = None, coded: bool = True) -> Model:
    """A model from SAMPLE of the n usable rows, those of smallest hash; about the root of n cells, CELLS at most. If not
    coded, of cells alone."""
    cells = cells or max(1, min(CELLS, round(n**0.5)))
    hashed = rows.select("vector", F.abs(F.xxhash64("id", "vector") / 2.0**63).alias("h")).where(F.col("h") <= min(1.0, 2 * SAMPLE / max(1, n)))
    sample = hashed.orderBy("h").limit(SAMPLE).coalesce(1)

    def train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [np.stack([np.asarray(v, float) for v in b["vector"]]) for b in batches if len(b)]
        yield pd.DataFrame({"model": [Model.fit(np.concatenate(held), cells, coded=coded).packed()] if held else []})

    found = sample.select("vector").mapInPandas(train, "model binary").collect()  # one row, some megabytes at most
    return Model.unpacked(bytes(found[0].model)) if found else Model(np.zeros((0, 1)), [])


@dataclass
class VectorIndex:
    spark: SparkSession
    folder: str
    id_type: str
    model: Model
    probed: int

    @classmethod
    def build(cls, rows: DataFrame, folder: str, cells: int | None = None) -> VectorIndex:
        """Indexes every usable row(id, vector) and writes the index to folder."""
        with tidy_shuffles(rows.sparkSession):
            return cls._build(rows, folder, cells)

    @classmethod
    def _build(cls, rows: DataFrame, folder: str, cells: int | None) -> VectorIndex:
        spark, id_type = rows.sparkSession, rows.schema["id"].dataType.simpleString()
        rows = saved(rows.select("id", F.col("vector").cast("array<double>").alias("vector")).where(F.col("id").isNotNull() & usable(F.col("vector"))), f"{folder}/vectors")
        n = rows.count()
        lengths = rows.agg(F.min(F.size("vector")), F.max(F.size("vector"))).first()
        if n and lengths[0] != lengths[1]:
            raise ValueError(f"vectors have lengths from {lengths[0]} to {lengths[1]}")
        model = fit(rows, n, cells)
        sent = spark.sparkContext.broadcast(model)

        def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in (b for b in batches if len(b)):
                vectors = np.stack([np.asarray(v, float) for v in batch["vector"]])
                cell = nearest_centres(vectors, sent.value.cells)[0]
                yield pd.DataFrame({"cell": cell.astype(np.int32), "id": batch["id"], "code": [c.tobytes() for c in sent.value.encode(vectors, cell)]})

        coded = saved(rows.mapInPandas(assign, f"cell int, id {id_type}, code binary"), f"{folder}/assigned")
        parts = broadcast_if_small(saved(coded.groupBy("cell").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts")), f"{folder}/cells"))
        dealt = coded.join(parts, "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("parts")
        dealt.repartitionByRange("cell", "part", "id").sortWithinPartitions("cell", "part").select("cell", "part", "id", "code").write.parquet(f"{folder}/codes")
        probed = cls._calibrate(rows, coded, model)
        spark.createDataFrame([(id_type, probed, model.packed())], "id_type string, probed int, model binary").coalesce(1).write.parquet(f"{folder}/model")
        return cls(spark, folder, id_type, model, probed)

    @staticmethod
    def _calibrate(rows: DataFrame, coded: DataFrame, model: Model, k: int = K) -> int:
        """The least number of cells that hold RECALL of the k nearest rows of TRIED rows, which are found exactly."""
        tried = rows.withColumn("h", F.xxhash64("vector", "id")).orderBy("h").limit(TRIED).collect()
        if not tried:
            return 1
        asked = rows.sparkSession.createDataFrame([(i, r.vector) for i, r in enumerate(tried)], "query_id long, vector array<double>")
        found = nearest(rows, asked, k=k + 1, id_type=rows.schema["id"].dataType.simpleString())
        near = coded.join(F.broadcast(found), "id").select("query_id", "id", "cell").collect()  # k + 1 for each row tried
        order = model.nearest_cells(np.stack([np.asarray(r.vector) for r in tried]), len(model.cells))
        at = sorted(int(np.flatnonzero(order[r.query_id] == r.cell)[0]) for r in near if r.id != tried[r.query_id].id)
        return 1 + at[min(len(at) - 1, int(RECALL * len(at)))] if at else 1

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> VectorIndex:
        [row] = spark.read.parquet(f"{folder}/model").collect()
        return cls(spark, folder, row.id_type, Model.unpacked(bytes(row.model)), row.probed)

    def vectors(self) -> DataFrame:
        return self.spark.read.schema(f"id {self.id_type}, vector array<double>").parquet(f"{self.folder}/vectors")

    def codes(self) -> DataFrame:
        return self.spark.read.schema(f"cell int, part int, id {self.id_type}, code binary").parquet(f"{self.folder}/codes")

    def probes(self, queries: DataFrame, n: int) -> DataFrame:
        """(cell, place, query_id, vector): each query with its n nearest cells, in their order."""
        sent = self.spark.sparkContext.broadcast(self.model)

        def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            step = max(1, HELD // 8 // max(1, min(n, len(sent.value.cells))))
            parts = (whole.iloc[at : at + step] for whole in batches for at in range(0, len(whole), step))
            for batch in (b for b in parts if len(sent.value.cells)):
                vectors = np.stack([np.asarray(v, float) for v in batch["vector"]])
                cells = sent.value.nearest_cells(vectors, n)
                rows, place = np.repeat(np.arange(len(batch)), cells.shape[1]), np.tile(np.arange(cells.shape[1], dtype=np.int32), len(batch))
                yield pd.DataFrame({"cell": cells.ravel().astype(np.int32), "place": place, "query_id": batch["query_id"].to_numpy()[rows], "vector": batch["vector"].to_numpy()[rows]})

        return queries.mapInPandas(near, "cell int, place int, query_id long, vector array<double>")

    def candidates(self, probes: DataFrame, shortlist: int, folder: str) -> DataFrame:
        """(query_id, id): the shortlist rows of the probed cells that their codes put nearest to each query.

        A query's FIRST cells give the distance of its last candidate so far; the others then give only what is nearer.
        """
        best = F.row_number().over(Window.partitionBy("query_id").orderBy("near", "id"))
        top = lambda rows: rows.withColumn("n", best).where(F.col("n") <= shortlist)
        first = probes.where(F.col("place") < FIRST).withColumn("limit", F.lit(float("inf")))
        first = saved(top(self._looked_up(first, shortlist)), f"{folder}/first")
        limits = saved(first.where(F.col("n") == shortlist).select("query_id", F.col("near").alias("limit")), f"{folder}/limits")
        more = probes.where(F.col("place") >= FIRST).join(broadcast_if_small(limits), "query_id", "left").fillna(float("inf"), ["limit"])
        return top(first.drop("n").union(self._looked_up(more, shortlist))).select("query_id", "id")

    def _looked_up(self, probes: DataFrame, shortlist: int) -> DataFrame:
        """(query_id, id, near) of each probe's shortlist rows, within its limit, part by part of a cell."""
        sent, schema = self.spark.sparkContext.broadcast(self.model), f"query_id long, id {self.id_type}, near double"
        cells = self.spark.read.schema("cell int, parts int").parquet(f"{self.folder}/cells")
        asked = probes.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        sizes = broadcast_if_small(saved(cells.join(asked, "cell"), f"{scratch(self.spark, 'probes')}/cells"))
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = self.codes().join(sizes, "cell").withColumn("block", each("blocks"))
        right = probes.join(sizes, "cell").withColumn("block", F.pmod(F.xxhash64("query_id", "vector"), F.col("blocks")).cast("int")).withColumn("part", each("parts"))

        def look(key, rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
            queries, places, distances = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
            if len(rows) and len(asked):
                codes = np.frombuffer(b"".join(rows["code"]), np.uint8).reshape(len(rows), -1)
                for query, vector, limit in zip(asked["query_id"], asked["vector"], asked["limit"]):
                    near = sent.value.distances(np.asarray(vector, float), key[0], codes)
                    at = np.flatnonzero(near <= limit)
                    if len(at) > shortlist:
                        at = at[np.argpartition(near[at], shortlist)[:shortlist]]
                    queries.append(np.full(len(at), query))
                    places.append(at)
                    distances.append(near[at])
            return pd.DataFrame({"query_id": np.concatenate(queries), "id": rows["id"].to_numpy()[np.concatenate(places)], "near": np.concatenate(distances)})

        keys = ("cell", "part", "block")
        return left.select(*keys, "id", "code").groupBy(*keys).cogroup(right.select(*keys, "query_id", "vector", "limit").groupBy(*keys)).applyInPandas(look, schema)

    def search(self, queries: DataFrame, k: int = K, probes: int | None = None, shortlist: int = SHORTLIST) -> DataFrame:
        """(query_id, rank, id, dist) of about the k nearest rows to each of queries(query_id, vector); query ids differ.

        probes is the number of cells for each query, by default as many as were measured to do.
        """
        with tidy_shuffles(self.spark):
            return self._search(queries, k, probes, shortlist)

    def _search(self, queries: DataFrame, k: int, probes: int | None, shortlist: int) -> DataFrame:
        folder = scratch(self.spark, "search")
        asked = queries.select(F.col("query_id").cast("long"), F.col("vector").cast("array<double>").alias("vector")).where(usable(F.col("vector")))
        asked = saved(asked, f"{folder}/asked")
        probed = saved(self.probes(asked, probes or self.probed), f"{folder}/probes")
        found = saved(self.candidates(probed, max(k, shortlist), folder).distinct(), f"{folder}/found")
        # Of the vectors, those of candidates are fetched: by a broadcast of (query_id, id) where these are few.
        with_vectors = self.vectors().join(broadcast_if_small(found), "id").join(broadcast_if_small(asked.withColumnRenamed("vector", "query")), "query_id")
        apart = F.zip_with("vector", "query", lambda x, y: (x - y) * (x - y))
        ranked = with_vectors.select("query_id", "id", F.round(F.aggregate(apart, F.lit(0.0), lambda a, x: a + x), 6).alias("dist"))
        best = F.row_number().over(Window.partitionBy("query_id").orderBy("dist", "id"))
        top = saved(ranked.withColumn("rank", best).where(F.col("rank") <= k), f"{folder}/top")
        enough = top.groupBy("query_id").count().where(F.col("count") >= k)
        short = saved(asked.join(enough, "query_id", "left_anti"), f"{folder}/short")
        near = top.join(broadcast_if_small(short.select("query_id")), "query_id", "left_anti").select("query_id", "rank", "id", "dist")
        return near if short.isEmpty() else near.union(nearest(self.vectors(), short, k=k, id_type=self.id_type))
