"""Exact text search over hashed terms with block maxima: the rows of a full scan, from part of the blocks.

Chunks become counts of terms by bucket, as in functions/text.py. They are ordered so that like ones stand together (cells
of a k-means model, fitted on a bounded sample; it bears on cost only) and packed in blocks of BLOCK. A block's bound is,
for each bucket, the largest share that a chunk of it has there; with it no chunk of the block can be nearer to a question
than the bound's product says. The index has two tables: `bounds`, small and read whole, and `postings`, the counts of
each block's chunks, of which only those of the blocks that matter are looked at:

1. each question takes the SEEDS blocks of the best bounds, and the distance of its k-th chunk there is a threshold;
2. all blocks whose bound reaches below a question's threshold are scored, exactly.

Questions go in waves of WAVE, so what is sent to tasks has a fixed size.

Defined cases: a chunk with a null text has no terms, and so is at distance 1 from a question with terms, 0 from one
without. Questions without terms look at every block. Distances are rounded to 6 digits, ties go to the smaller id.
Repeated ids are chunks of their own. An empty index has no hits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomwork.functions.text import BUCKETS, SLICE, term_matrix
from loomwork.operators import vectorindex
from loomwork.operators.retrieval import K, unit_distances
from loomwork.session import broadcast_if_small, saved, scratch, tidy_shuffles

#: Chunks of a block; blocks of a question that give its threshold; questions of a wave; blocks whose bounds are one row.
BLOCK, SEEDS, WAVE, GROUP = 8, 4, 1_024, 256
#: What distances may differ by through rounding.
SLACK = 2e-6
#: Distances that a task holds before it keeps the best of each question.
HELD = 50_000
POSTINGS = "block long, ids array<string>, counts binary"
HITS = "query_id long, id string, dist double"


def packed_counts(counts: np.ndarray) -> bytes:
    """Counts of chunks by bucket, as the cells that aren't zero: places, then numbers."""
    at = np.flatnonzero(counts)
    return at.astype("<u4").tobytes() + counts.ravel()[at].astype("<u4").tobytes()


def unpacked_counts(data: bytes, rows: int) -> np.ndarray:
    at, numbers = np.frombuffer(data, "<u4").reshape(2, -1)
    counts = np.zeros(rows * BUCKETS)
    counts[at] = numbers
    return counts.reshape(rows, BUCKETS)


def slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches in parts of SLICE rows."""
    for batch in batches:
        for at in range(0, len(batch), SLICE):
            yield batch.iloc[at : at + SLICE].reset_index(drop=True)


@dataclass
class TextIndex:
    spark: SparkSession
    folder: str
    #: Pairs of question and block that the last search scored, and all pairs there are.
    looked_at: int = 0
    of: int = 0

    @classmethod
    def build(cls, chunks: DataFrame, folder: str) -> TextIndex:
        """Indexes all chunks(id, text)."""
        with tidy_shuffles(chunks.sparkSession):
            return cls._build(chunks, folder)

    @classmethod
    def _build(cls, chunks: DataFrame, folder: str) -> TextIndex:
        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in slices(batches):
                counts = term_matrix(batch["text"])
                norm = np.sqrt((counts**2).sum(1, keepdims=True))
                yield pd.DataFrame({"id": batch["id"], "vector": list(counts / np.where(norm > 0, norm, 1)), "counts": [packed_counts(c) for c in counts]})

        spark = chunks.sparkSession
        counted = saved(chunks.select(F.col("id").cast("string"), "text").mapInPandas(count, "id string, vector array<double>, counts binary"), f"{folder}/counted")
        sent = spark.sparkContext.broadcast(vectorindex.fit(counted, counted.count(), coded=False))

        def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in slices(batches):
                own, far = vectorindex.nearest_centres(np.stack(batch["vector"]), sent.value.cells)
                yield pd.DataFrame({"cell": own.astype(np.int32), "far": np.round(far, 6), "id": batch["id"], "counts": batch["counts"]})

        placed = saved(counted.mapInPandas(place, "cell int, far double, id string, counts binary"), f"{folder}/placed")

        def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held = pd.DataFrame()
            for batch in slices(batches):
                held = pd.concat([held, batch])
                whole = len(held) // BLOCK * BLOCK
                yield blocks(held.iloc[:whole])
                held = held.iloc[whole:]
            yield blocks(held)

        def blocks(rows: pd.DataFrame) -> pd.DataFrame:
            parts = [rows.iloc[i : i + BLOCK] for i in range(0, len(rows), BLOCK)]
            found = [packed_counts(np.concatenate([unpacked_counts(c, 1) for c in p["counts"]])) for p in parts]
            return pd.DataFrame({"ids": pd.Series([p["id"].tolist() for p in parts], dtype=object), "counts": pd.Series(found, dtype=object)})

        ordered = placed.repartitionByRange("cell", "far", "id").sortWithinPartitions("cell", "far", "id")
        made = ordered.mapInPandas(pack, "ids array<string>, counts binary").withColumn("block", F.monotonically_increasing_id())
        postings = saved(made.select("block", "ids", "counts"), f"{folder}/postings")

        def bound(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for at in range(0, len(batch), GROUP):
                    part, most, blank = batch.iloc[at : at + GROUP], [], []
                    for ids, data in zip(part["ids"], part["counts"]):
                        counts = unpacked_counts(data, len(ids))
                        norm = np.sqrt((counts**2).sum(1, keepdims=True))
                        most.append((counts / np.where(norm > 0, norm, 1)).max(0))
                        blank.append((norm == 0).any())
                    numbers = part["block"].to_numpy(np.int64)
                    yield pd.DataFrame({"blocks": [numbers.tobytes()], "most": [np.array(most, "<f4").tobytes()], "blank": [np.array(blank, "u1").tobytes()]})

        saved(postings.mapInPandas(bound, "blocks binary, most binary, blank binary"), f"{folder}/bounds")
        return cls(spark, folder)

    def _bounds(self) -> DataFrame:
        return self.spark.read.schema("blocks binary, most binary, blank binary").parquet(f"{self.folder}/bounds")

    def _postings(self) -> DataFrame:
        return self.spark.read.schema(POSTINGS).parquet(f"{self.folder}/postings")

    def search(self, questions: DataFrame, k: int = K) -> DataFrame:
        """(query_id, rank, id, dist) of the k nearest chunks to each of questions(query_id, text); query ids differ."""
        folder = scratch(self.spark, "textsearch")
        asked = saved(questions.select(F.col("query_id").cast("long"), "text"), f"{folder}/asked")
        self.looked_at = self.of = 0
        waves = max(1, -(-asked.count() // WAVE))
        dealt = asked.withColumn("wave", F.pmod(F.xxhash64("query_id"), F.lit(waves)))
        found = [self._wave(dealt.where(F.col("wave") == w), f"{folder}/{w}", k) for w in range(waves)]
        hits = found[0]
        for more in found[1:]:
            hits = hits.union(more)
        best = F.row_number().over(Window.partitionBy("query_id").orderBy("dist", "id"))
        return hits.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "id", "dist")

    def _wave(self, asked: DataFrame, folder: str, k: int) -> DataFrame:
        with tidy_shuffles(self.spark):
            return self._searched(asked, folder, k)

    def _searched(self, asked: DataFrame, folder: str, k: int) -> DataFrame:
        rows = asked.select("query_id", "text").collect()  # about WAVE
        ids, counts = np.array([r.query_id for r in rows], np.int64), term_matrix([r.text for r in rows])
        sent = self.spark.sparkContext.broadcast((ids, counts))

        def least(most: np.ndarray, blank: np.ndarray) -> np.ndarray:
            """(blocks, questions) distances that no chunk of a block is below."""
            norm = np.sqrt((sent.value[1] ** 2).sum(1))
            near = 2 - 2 * (most.astype(float) @ sent.value[1].T) / np.where(norm > 0, norm, 1)
            near = np.where(blank[:, None] > 0, np.minimum(near, 1), near)
            return np.where(norm[None] > 0, near, 0) - SLACK

        def unpacked(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for batch in batches:
                for blocks, most, blank in zip(batch["blocks"], batch["most"], batch["blank"]):
                    numbers = np.frombuffer(blocks, np.int64)
                    yield numbers, least(np.frombuffer(most, "<f4").reshape(len(numbers), -1), np.frombuffer(blank, "u1"))

        def seeds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for numbers, near in unpacked(batches):
                top = np.argsort(near, axis=0, kind="stable")[:SEEDS]
                yield pd.DataFrame({"query": np.tile(np.arange(near.shape[1], dtype=np.int32), len(top)), "block": numbers[top].ravel(), "near": np.take_along_axis(near, top, 0).ravel()})

        first = F.row_number().over(Window.partitionBy("query").orderBy("near", "block"))
        some = self._bounds().mapInPandas(seeds, "query int, block long, near double").withColumn("n", first).where(F.col("n") <= SEEDS)
        chosen = saved(some.groupBy("block").agg(F.collect_list("query").alias("queries")), f"{folder}/seeds")
        ranked = F.row_number().over(Window.partitionBy("query_id").orderBy("dist"))
        held = self._scored(chosen, sent, k).withColumn("n", ranked).where(F.col("n") == k).select("query_id", "dist").collect()  # a row a question
        known = {r.query_id: r.dist for r in held}
        limits = self.spark.sparkContext.broadcast(np.array([known.get(i, np.inf) for i in ids.tolist()]))

        def needed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for numbers, near in unpacked(batches):
                there = near <= limits.value
                at = np.flatnonzero(there.any(1))
                yield pd.DataFrame({"block": numbers[at], "queries": pd.Series([np.flatnonzero(there[i]).astype(np.int32) for i in at], dtype=object)})

        wanted = saved(self._bounds().mapInPandas(needed, "block long, queries array<int>"), f"{folder}/needed")
        self.looked_at += wanted.agg(F.sum(F.size("queries"))).first()[0] or 0
        self.of += self._postings().count() * len(ids)
        return saved(self._scored(wanted, sent, k, limits), f"{folder}/hits")

    def _scored(self, wanted: DataFrame, sent, k: int, limits=None) -> DataFrame:
        """HITS of the chunks of wanted(block, queries): for each task, the k best of each question, no farther than its limit."""

        def best(found: list[pd.DataFrame]) -> pd.DataFrame:
            return pd.concat(found).sort_values(["query", "dist", "id"], kind="stable").groupby("query").head(k)

        def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            least = np.full(len(sent.value[0]), np.inf) if limits is None else limits.value.copy()
            none = pd.DataFrame({"query": pd.Series(dtype="int64"), "id": pd.Series(dtype=object), "dist": pd.Series(dtype=float)})
            found, n = [none], 0
            for batch in batches:
                for ids, data, queries in zip(batch["ids"], batch["counts"], batch["queries"]):
                    queries = np.asarray(queries, np.int64)
                    near = np.round(unit_distances(unpacked_counts(data, len(ids)), sent.value[1][queries]), 6)
                    row, col = np.nonzero(near <= least[queries])
                    found.append(pd.DataFrame({"query": queries[col], "id": np.asarray(ids, object)[row], "dist": near[row, col]}))
                    n += len(row)
                    if n >= HELD:
                        found = [best(found)]
                        full = found[0].groupby("query")["dist"].agg(["size", "max"])
                        full = full[full["size"] == k]
                        least[full.index] = np.minimum(least[full.index], full["max"])
                        n = 0
            kept = best(found)
            yield pd.DataFrame({"query_id": sent.value[0][kept["query"].to_numpy(np.int64)], "id": kept["id"], "dist": kept["dist"]})

        return self._postings().join(broadcast_if_small(wanted), "block").select("ids", "counts", "queries").mapInPandas(score, HITS)
