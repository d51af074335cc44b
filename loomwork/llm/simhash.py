"""Near duplicates by 64-bit fingerprints, searched with the binary Golay code.

A fingerprint is cut into segments of 22, 21 and 21 bits. The perfect (23,12) Golay code gives each segment
the codeword nearest to it (at most 3 bits away) and, where it is 3 bits away, the five codewords that are 4
bits away. If two segments differ in at most one bit, the nearest codeword of one is among these six of the
other. Three differing bits over three segments leave two cases (pigeonhole):

- one segment is equal and another differs in at most one bit: key = the equal segment, exact, and the other's
  codeword, for each of six ordered pairs of segments;
- each segment differs in exactly one bit, so one half of the last segment is equal: key = the codewords of the
  other two segments, that half, exact, and the parity of all three segments, which the other side has complemented.

Each distinct fingerprint is indexed under its nearest codewords (8 keys) and looks up all codewords (at most
108 keys); a join on the key then verifies the distance. No link is missed, and keys have 33 bits and more.

Copies are collapsed to their fingerprint before keys are made, so a group of copies of any size is one row,
and a fingerprint has at most as many links as there are words within 3 bits of it.

Defined cases: a null or blank text has fingerprint 0 and links like any other. Rows with a null id keep their
row; their component is that of the other ids, or null if there are none. Repeated rows stay.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.llm.components import connected_components
from loomwork.session import saved, scratch, tidy_shuffles

SEED, DISTANCE = 42, 3
#: Shingles whose bits are counted at once.
CHUNK = 1 << 16
#: (shift, bits) of the segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
PAIRS = ((0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1))
#: (shift, bits) of the halves of the last segment.
HALVES = ((0, 11), (11, 10))
# Fixed value: a generator polynomial of the binary Golay code.
GENERATOR = 0b110001110101


def shingles(text: str, width: int) -> list[bytes]:
    """Word shingles of a text in lower-case ASCII, with repeats; a shorter text is one shingle, if it has a word."""
    words = text.encode().lower().split()
    if len(words) <= width:
        return [b" ".join(words)] if words else []
    return [b" ".join(w) for w in zip(*(words[i:] for i in range(width)))]


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of shingle hashes: bit i is set if it is in over half of them."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = hashes[at : at + CHUNK].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprint(text: str, width: int = 3) -> int:
    """The fingerprint of a text's shingles; 0 without a word."""
    parts = shingles(text, width)
    digest = xxhash.xxh64_intdigest
    return majority(np.fromiter((digest(p, SEED) for p in parts), np.uint64, len(parts)))


def fingerprint_column(text: Column, make: Callable[[str], int] = fingerprint) -> Column:
    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([make(t or "") for t in texts], dtype="int64")

    return of(text)


@lru_cache(maxsize=1)
def golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Remainders of the low and high halves of a word, and for each remainder the errors to its codewords.

    errors[s, 0] leads to the nearest codeword; errors[s, 1:] to those 4 bits away, or -1.
    """

    def remainder(word: int) -> int:
        for bit in range(22, 10, -1):
            if word >> bit & 1:
                word ^= GENERATOR << (bit - 11)
        return word

    unit = [remainder(1 << i) for i in range(23)]
    low, high = np.zeros(1 << 12, np.int64), np.zeros(1 << 11, np.int64)
    for table, bits in ((low, unit[:12]), (high, unit[12:])):
        for i, r in enumerate(bits):
            table[1 << i : 2 << i] = table[: 1 << i] ^ r
    errors, filled = np.full((1 << 11, 6), -1, np.int64), np.zeros(1 << 11, np.int64)
    for weight in range(5):
        places = _subsets(23, weight)
        words = (np.int64(1) << places).sum(1)
        for s, word in zip((low[words & 0xFFF] ^ high[words >> 12]).tolist(), words.tolist()):
            if weight < 4 or filled[s]:
                errors[s, filled[s]] = word
                filled[s] += 1
    return low, high, errors


def _subsets(n: int, k: int) -> np.ndarray:
    from itertools import combinations

    found = list(combinations(range(n), k))
    return np.array(found, np.int64).reshape(len(found), k)


def codewords(segment: np.ndarray) -> np.ndarray:
    """(n, 6) 12-bit indices of the codewords near each segment, nearest first; -1 where there are fewer."""
    low, high, errors = golay()
    found = errors[low[segment & 0xFFF] ^ high[segment >> 12]]
    return np.where(found < 0, -1, (segment[:, None] ^ found) >> 11)


def search_keys(prints: np.ndarray, probe: bool) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of the keys under which fingerprints are indexed or, with probe, looked up."""
    bits = prints.astype("<i8").view("<u8")
    segments = [(bits >> np.uint64(s) & np.uint64((1 << n) - 1)).astype(np.int64) for s, n in SEGMENTS]
    words = [codewords(s)[:, : 6 if probe else 1] for s in segments]
    odd = [np.bitwise_count(s).astype(np.int64) & 1 for s in segments]
    parity = (odd[0] << 2 | odd[1] << 1 | odd[2]) ^ (7 if probe else 0)
    rows, keys = [], []

    def put(key: np.ndarray, there: np.ndarray) -> None:
        row, col = np.nonzero(there)
        rows.append(row)
        keys.append(key[row, col])

    for n, (i, j) in enumerate(PAIRS):
        put(n << 40 | segments[i][:, None] << 12 | words[j], words[j] >= 0)
    a, b = words[0][:, :, None], words[1][:, None, :]
    there = ((a >= 0) & (b >= 0)).reshape(len(bits), -1)
    for n, (shift, width) in enumerate(HALVES, len(PAIRS)):
        half = segments[2] >> shift & (1 << width) - 1
        put((n << 40 | (parity << 11 | half)[:, None, None] << 24 | a << 12 | b).reshape(len(bits), -1), there)
    return np.concatenate(rows), np.concatenate(keys)


def keyed(prints: DataFrame, probe: bool) -> DataFrame:
    """(key, print) rows of the distinct fingerprints in column print."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy()
            for at in range(0, len(values), 20_000):
                part = values[at : at + 20_000]
                row, key = search_keys(part, probe)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part[row])], ["key", "print"])

    return prints.select("print").mapInArrow(rows, "key long, print long")


def near_prints(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Every pair (a, b), a < b, of the distinct fingerprints that differ in at most distance <= 3 bits.

    The join is a merge join: Spark guesses the sizes of both sides from that of prints, without the keys of each.
    """
    if distance > DISTANCE:
        raise ValueError(f"the keys find distances up to {DISTANCE}")
    left = keyed(prints, False).withColumnRenamed("print", "a")
    right = keyed(prints, True).withColumnRenamed("print", "b").hint("merge")
    near = left.join(right, (left["key"] == right["key"]) & (left["a"] != right["b"]) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance))
    return near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, *, width: int = 3, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, print, component_id) of every document; component_id is the smallest doc_id reachable by links."""
    folder = scratch(docs.sparkSession, "simhash")
    with tidy_shuffles(docs.sparkSession):
        printed = docs.select("doc_id", fingerprint_column(F.col("text"), lambda t: fingerprint(t, width)).alias("print"))
        printed = saved(printed, f"{folder}/printed")
        prints = saved(printed.groupBy("print").agg(F.min("doc_id").alias("first_id")), f"{folder}/prints")
        linked = connected_components(near_prints(prints, distance), "a", "b")
        rooted = prints.join(linked, prints["print"] == linked["node"], "left").select("print", "first_id", F.coalesce("root", "print").alias("root"))
        rooted = saved(rooted, f"{folder}/rooted")
        smallest = saved(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), f"{folder}/smallest")
        named = saved(rooted.select("print", "root").join(smallest, "root").select("print", "component_id"), f"{folder}/named")
    return printed.join(named, "print")


def fingerprint_report(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    digits = F.lpad(F.lower(F.hex("print")), 16, "0")
    return near_duplicates(docs).select("doc_id", digits.alias("fingerprint"), "component_id")
