"""Exact top-k by integer inner product, over a bit-sliced index.

The index holds blocks of vectors in column-major bits: for each component, one bitmap per bit of the component
plus an offset that makes it non-negative (its slices). A query adds up a block's scores without looking at a
single vector: for every set bit of a component's weight, that component's slices are added to the sum's slices
with bitmap AND, XOR and OR; negative weights add complements, so that all sums stay non-negative. The top rows
are then selected from the most significant slice of the sums downward; rows that tie at the boundary are
resolved by their vec_id. The selected scores are exact, being read off all slices.

Queries are dealt in blocks against blocks of vectors: each pair of blocks is one row of work, and every query
keeps k rows of each block, which a last ranking over the blocks merges. A block of queries grows with their number
up to the size of an index block, so the index is sent on once for thousands of queries; all pairs of blocks are
still met, so work grows with the square of a table whose share of queries is fixed.

Defined cases: vectors that are null or hold a null, NaN or infinite component take no part, neither as query nor
as candidate; nor do rows without an id. Vectors must have one length; of a table with several, each query is
compared with those of its own length. Every row is a query and a candidate of its own, even if its id or all of it
repeats: a row never meets itself, but meets other rows of its id, and each query row of an id has its own ranks.
Components so large that a score might leave 64 bits (for 64 components, beyond about 2 million) are an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

K, SCALE, EVERY = 20, 64, 20
#: Vectors of an index block; queries of a query block, at least (if there are so many) and at most.
BLOCK_ROWS, LEAST_QUERIES, BLOCK_QUERIES = 65_536, 64, 8_192
#: A task gets about one pair of blocks, so that it holds few megabytes; tasks at most.
MOST_TASKS = 100_000


#: Doubles from here on are whole.
LARGE = float(1 << 52)


def quantise(embedding: Column, scale: int = SCALE) -> Column:
    """floor(scale * component) of each component, as double; null for vectors that take no part."""
    whole = F.transform(embedding, lambda x: x.cast("double") * F.lit(float(scale)))
    whole = F.transform(whole, lambda x: F.when(F.abs(x) < LARGE, F.floor(x).cast("double")).otherwise(x))
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(embedding.isNotNull() & ~F.coalesce(bad, F.lit(True)), whole)


def slices(values: np.ndarray, bits: int) -> np.ndarray:
    """(components, bits, words) bitmaps of non-negative values (rows, components); row r is bit r."""
    rows, components = values.shape
    words = -(-rows // 64)
    out = np.zeros((components, bits, words * 8), np.uint8)
    for b in range(bits):
        packed = np.packbits((values >> b & 1).astype(np.uint8).T, axis=1, bitorder="little")
        out[:, b, : packed.shape[1]] = packed
    return out.view("<u8")


def add_slices(total: list[np.ndarray], number: np.ndarray, shift: int, flip: bool, ones: np.ndarray) -> None:
    """total += number << shift in place, with number complemented if flip; slices are least significant first."""
    carry = None
    for i, bitmap in enumerate(number):
        at = shift + i
        if flip:
            bitmap = bitmap ^ ones
        old = total[at]
        half = old ^ bitmap
        if carry is None:
            total[at], carry = half, old & bitmap
        else:
            total[at] = half ^ carry
            carry = (old & bitmap) | (half & carry)
    at = shift + len(number)
    while at < len(total):
        if at % 4 == 0 and not carry.any():
            return
        total[at], carry = total[at] ^ carry, total[at] & carry
        at += 1


def select_top(total: list[np.ndarray], alive: np.ndarray, k: int) -> np.ndarray:
    """Rows of the k largest sums among alive, from the most significant slice down; ties to the lower row."""
    sure, maybe = np.zeros_like(alive), alive
    n_sure = 0
    for bitmap in reversed(total):
        high = maybe & bitmap
        n = int(np.bitwise_count(high).sum())
        if n_sure + n > k:
            maybe = high
        else:
            sure, n_sure, maybe = sure | high, n_sure + n, maybe & ~bitmap
    bits = lambda x: np.flatnonzero(np.unpackbits(x.view(np.uint8), bitorder="little"))
    return np.concatenate([bits(sure), bits(maybe)[: max(0, k - n_sure)]])


def search_block(index: np.ndarray, offset: int, ids: np.ndarray, own: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(vec_id, score) of the query's k best rows of a block whose ids ascend, except the row own (-1: none)."""
    components, bits, words = index.shape
    top = (1 << bits) - 1
    width = int(np.abs(query).sum() * top).bit_length() + 1
    ones = np.full(words, np.iinfo(np.uint64).max, np.uint64)
    total = [np.zeros(words, np.uint64) for _ in range(max(width, bits + int(np.abs(query).max(initial=0)).bit_length()) + 1)]
    for j in np.flatnonzero(query).tolist():
        weight = abs(int(query[j]))
        for b in range(weight.bit_length()):
            if weight >> b & 1:
                add_slices(total, index[j], b, bool(query[j] < 0), ones)
    alive = np.zeros(words * 64, np.uint8)
    alive[: len(ids)] = 1
    if own >= 0:
        alive[own] = 0
    rows = select_top(total, np.packbits(alive, bitorder="little").view("<u8"), k)
    sums = np.zeros(len(rows), np.int64)
    for b, bitmap in enumerate(total):
        sums += (bitmap[rows >> 6] >> (rows & 63).astype(np.uint64) & np.uint64(1)).astype(np.int64) << b
    # The complement of a is top - a, so each negative weight added |w| * top too much; offsets add w * offset.
    return ids[rows], sums - int(np.abs(query[query < 0]).sum()) * top - int(query.sum()) * offset


def top_k(vectors: DataFrame, *, k: int = K, every: int = EVERY, scale: int = SCALE, block_rows: int = BLOCK_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): for each id divisible by every, the k other vectors of highest score."""
    spark = vectors.sparkSession
    whole = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), quantise(F.col("embedding"), scale).alias("v")).where("vec_id is not null and v is not null")
    whole = whole.withColumn("size", F.size("v")).where("size > 0").withColumn("row", F.xxhash64("vec_id", "v"))
    facts = whole.groupBy("size").agg(F.count("*").alias("n"), F.min(F.array_min("v")).alias("low"), F.max(F.array_max("v")).alias("high"), F.count_if(F.col("vec_id") % every == 0).alias("q")).collect()
    result = "query_id long, rank int, vec_id long, score long"
    parts = []
    for fact in facts:  # one pass for each length of vectors, of which a table has one as a rule
        size, low, high = fact["size"], int(fact["low"]), int(fact["high"])
        if 4 * size * max(abs(low), abs(high), 1) ** 2 >= 1 << 62:
            raise ValueError(f"components up to {max(abs(low), abs(high)) / scale:g} are too large: a score of {size} components might leave 64 bits")
        offset, bits = -low, max(1, (high - low).bit_length())
        n_rows = -(-fact["n"] // block_rows)
        per_block = min(block_queries, max(LEAST_QUERIES, -(-fact["q"] * n_rows // (4 * spark.sparkContext.defaultParallelism))))
        n_queries = max(1, -(-fact["q"] // per_block))
        own = whole.where(F.col("size") == size)
        place = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
        index = own.withColumn("block", place(n_rows)).groupBy("block").applyInPandas(_build(offset, bits), "block int, ids binary, row_keys binary, bitmaps binary")
        queries = own.where(F.col("vec_id") % every == 0).withColumn("q_block", place(n_queries)).groupBy("q_block").applyInPandas(_pack, "q_block int, q_ids binary, q_keys binary, q_values binary")
        work = queries.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_rows - 1)))).join(index, "block")
        work = work.repartition(min(n_rows * n_queries, MOST_TASKS), "q_block", "block")
        found = work.mapInPandas(_search(offset, bits, size, k), "q_block int, q_row int, query_id long, vec_id long, score long")
        parts.append(found.withColumn("size", F.lit(size)))
    if not parts:
        return spark.createDataFrame([], result)
    found = parts[0]
    for more in parts[1:]:
        found = found.union(more)
    best = F.row_number().over(Window.partitionBy("size", "q_block", "q_row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _build(offset: int, bits: int):
    def build(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("vec_id", kind="stable")
        bitmaps = slices(np.stack(block["v"].to_numpy()).astype(np.int64) + offset, bits)
        packed = {c: [block[name].to_numpy("<i8").tobytes()] for c, name in (("ids", "vec_id"), ("row_keys", "row"))}
        return pd.DataFrame({"block": [block["block"].iloc[0]], **packed, "bitmaps": [bitmaps.tobytes()]})

    return build


def _pack(block: pd.DataFrame) -> pd.DataFrame:
    values = np.stack(block["v"].to_numpy()).astype("<i8")
    packed = {c: [block[name].to_numpy("<i8").tobytes()] for c, name in (("q_ids", "vec_id"), ("q_keys", "row"))}
    return pd.DataFrame({"q_block": [block["q_block"].iloc[0]], **packed, "q_values": [values.tobytes()]})


def _search(offset: int, bits: int, size: int, k: int):
    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                ids, keys, q_ids, q_keys = (np.frombuffer(x, "<i8") for x in (row.ids, row.row_keys, row.q_ids, row.q_keys))
                index = np.frombuffer(row.bitmaps, "<u8").reshape(size, bits, -1)
                order = np.argsort(keys, kind="stable")
                at = order[np.minimum(np.searchsorted(keys, q_keys, sorter=order), len(keys) - 1)]
                own = np.where((keys[at] == q_keys) & (ids[at] == q_ids), at, -1)  # of equal rows any one, they are interchangeable
                found = [search_block(index, offset, ids, i, q, k) for i, q in zip(own.tolist(), np.frombuffer(row.q_values, "<i8").reshape(-1, size))]
                n = [len(f[0]) for f in found]
                told = {"q_block": row.q_block, "q_row": np.repeat(np.arange(len(q_ids)), n), "query_id": np.repeat(q_ids, n)}
                yield pd.DataFrame(told | {"vec_id": np.concatenate([f[0] for f in found]), "score": np.concatenate([f[1] for f in found])})

    return search
