"""Term vectors from the corpus itself: co-occurrence, PPMI and a randomised eigendecomposition; text vectors from these.

Counts cover all texts: each task counts pairs of vocabulary terms within WINDOW words, and their sums meet by band, the
rows of the terms' matrix whose number leaves the same remainder by BANDS; frequent terms, which come first, are so dealt over
all bands. What a task counted for a band is one packed row, so Spark moves blocks of numbers, not a row a pair. A
pair's weight is its positive pointwise mutual information, so the terms' matrix is sparse and symmetric. A random
projection of it, POWER times multiplied and made orthonormal, spans its strongest directions; each product is one pass over the
matrix's bands, past a dense factor of VOCABULARY x (DIMENSIONS + EXTRA) numbers at most, which is sent to all
tasks; what comes back to the driver are the products' rows, as many numbers.

A term's vector at unit length is added to a direction of its own, drawn by a hash of the term, which keeps rare terms
apart. A text's vector is the sum over its terms, weighed by a / (a + p) with p a term's share of all words, without the
direction that texts have in common (found on the vocabulary), at unit length.

The vocabulary is a parameter of the model: the VOCABULARY terms that most texts have, and LEAST_TEXTS at least. Other terms
have their own direction only, at OTHER.

Defined cases: a text that is null or without a term is the zero vector. Equal counts rank by the term's bytes. A corpus
without a pair gives a model without terms.
"""

from __future__ import annotations

import hashlib
import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.session import saved, scratch, tidy_shuffles

VOCABULARY, LEAST_TEXTS, DIMENSIONS, EXTRA, POWER, WINDOW, SEED = 50_000, 3, 128, 16, 3, 4, 17
#: The weight of a term of share p is SMOOTH / (SMOOTH + p).
SMOOTH, OTHER = 1e-3, 1.5
#: Numbers of pairs, and rows of terms, that a task holds before it passes them on; texts taken at once; directions of terms that
#: a worker keeps, and makes at once; bands of the matrix's rows.
HELD, TERMS, SLICE, KEPT, DRAWN, BANDS = 2_000_000, 500_000, 512, 100_000, 4_096, 512
#: A row of the matrix that has more than one entry in DENSE is multiplied with its zeros, FULL such rows at once: that reads the
#: factor in order, so a product takes no more time the fuller the matrix is.
DENSE, FULL = 16, 64
#: Texts whose terms are added up together.
TOGETHER = 512
_TERM = re.compile(r"[^\W_]+")


def terms(text: str | None) -> list[str]:
    return _TERM.findall((text or "").lower())


@cache
def _in_terms() -> np.ndarray:
    """Whether terms may have each code point."""
    return np.fromiter((chr(c).isalnum() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def coded(texts: list[str | None]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All terms of texts, in order, as places in the first array, and the number of the text that each is from.

    What parts terms is blanked in all texts at once; the first array may have an empty text, to which no term leads.
    """
    lowered = [(t or "").lower() for t in texts]
    signs = np.frombuffer("\n".join(lowered).encode("utf-32-le", "surrogatepass"), "<u4")
    signs = np.where(_in_terms()[signs], signs, np.uint32(ord(" ")))
    signs[np.cumsum([len(t) + 1 for t in lowered])[:-1] - 1] = ord("\n")
    parts = pc.ascii_split_whitespace(pa.array(signs.tobytes().decode("utf-32-le").split("\n"), pa.string()))
    found = parts.flatten().dictionary_encode()
    ids, rows = found.indices.to_numpy(), np.repeat(np.arange(len(parts)), np.diff(parts.offsets.to_numpy()))
    some = pc.not_equal(found.dictionary, "").to_numpy(zero_copy_only=False)[ids] if len(ids) else np.zeros(0, bool)
    return found.dictionary, ids[some], rows[some]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[list[str | None]]:
    return (whole.column(0).slice(at, SLICE).to_pylist() for whole in batches for at in range(0, whole.num_rows, SLICE))


def _places(names: pa.Array, places: dict[str, int]) -> np.ndarray:
    return np.array([places.get(t, -1) for t in names.to_numpy(zero_copy_only=False)], np.int64)


def vocabulary(texts: DataFrame, size: int = VOCABULARY) -> tuple[list[str], np.ndarray]:
    """The terms of the model, and the share of all words that each is."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for some in _slices(batches):
            names, ids, rows = coded(some)
            each = np.unique(rows * len(names) + ids) % max(1, len(names))
            words, texts = (np.bincount(x, minlength=len(names)) for x in (ids, each))
            held.append(pa.table({"term": names, "words": words, "texts": texts}).filter(pa.array(words > 0)))
            if sum(map(len, held)) > TERMS:
                held = [_added(held)]
                if len(held[0]) > TERMS // 2:
                    yield from held.pop().to_batches()
        if held:
            yield from _added(held).to_batches()

    counted = texts.select("text").mapInArrow(count, "term string, words long, texts long").groupBy("term").agg(F.sum("words").alias("words"), F.sum("texts").alias("texts"))
    counted = saved(counted, f"{scratch(texts.sparkSession, 'terms')}/counted")
    total = counted.agg(F.sum("words")).first()[0] or 1
    kept = counted.where(F.col("texts") >= LEAST_TEXTS).orderBy(F.desc("texts"), "term").limit(size).collect()  # size at most
    return [r.term for r in kept], np.array([r.words / total for r in kept])


def _added(held: list[pa.Table]) -> pa.Table:
    names = ["term", "words", "texts"]
    both = pa.concat_tables(held).group_by("term", use_threads=False).aggregate([("words", "sum"), ("texts", "sum")])
    return both.select(["term", "words_sum", "texts_sum"]).rename_columns(names)


def packed(numbers: np.ndarray) -> bytes:
    """Whole numbers, small ones in few bytes: their first bytes, then their second ones, and so on, compressed."""
    return pa.compress(np.ascontiguousarray(numbers.astype("<i8").view(np.uint8).reshape(-1, 8).T), codec="zstd", asbytes=True)


def unpacked(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, decompressed_size=8 * n, codec="zstd"), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, n).T).view("<i8").ravel()


_BAND = "band int, n int, pairs binary, counts binary"


def _rows(bands: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    columns = [pa.array([b for b, _, _ in bands], pa.int32()), pa.array([len(p) for _, p, _ in bands], pa.int32())]
    columns += [pa.array([packed(np.diff(p, prepend=0)) for _, p, _ in bands], pa.binary()), pa.array([packed(c) for _, _, c in bands], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["band", "n", "pairs", "counts"])


def _bands(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for band, n, pairs, counts in zip(*(batch.column(c).to_pylist() for c in ("band", "n", "pairs", "counts"))):
        yield band, np.cumsum(unpacked(pairs, n)), unpacked(counts, n)


def _summed(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    pairs, counts = (np.concatenate(x) for x in zip(*held))
    order = np.argsort(pairs, kind="stable")
    pairs, counts = pairs[order], counts[order]
    starts = np.flatnonzero(np.diff(pairs, prepend=-1))
    return pairs[starts], np.add.reduceat(counts, starts)


def pair_counts(texts: DataFrame, names: list[str], window: int = WINDOW) -> DataFrame:
    """(band, n, pairs, counts): how often two vocabulary terms i, j stand within window words, both ways round.

    A row has what a task counted of a band, i % BANDS: n ascending pairs, (i // BANDS + band * the most rows of a band) * len(names)
    + j, and their counts, packed. A term beside itself counts twice.
    """
    sent, size, most = texts.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(names)}), len(names), -(-len(names) // BANDS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: list[np.ndarray] = []

        def settled() -> pa.RecordBatch:
            whole = np.concatenate(codes)
            codes.clear()
            pairs, counts = np.unique(whole, return_counts=True)
            ends = np.searchsorted(pairs, np.arange(BANDS + 1) * most * size)
            return _rows([(band, pairs[a:b], counts[a:b]) for band, (a, b) in enumerate(zip(ends, ends[1:])) if b > a])

        for some in _slices(batches):
            found, ids, rows = coded(some)
            line = np.full(len(ids) + len(some) * window, -1)  # all texts' terms, texts farther apart than the window
            line[np.arange(len(ids)) + rows * window] = _places(found, sent.value)[ids]
            row = (line % BANDS * most + line // BANDS) * size
            for step in range(1, window + 1):
                there = np.flatnonzero((line[:-step] >= 0) & (line[step:] >= 0))
                codes += [row[there] + line[there + step], row[there + step] + line[there]]
            if sum(map(len, codes)) > HELD:
                yield settled()
        if any(map(len, codes)):
            yield settled()

    return texts.select("text").mapInArrow(count, _BAND)


def banded(counted: DataFrame, folder: str) -> DataFrame:
    """The counts added up: a row a band, of as many pairs as its rows have terms beside theirs."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, most = -1, [], HELD // 2
        for batch in batches:
            for band, pairs, counts in _bands(batch):
                if band != now and held:
                    yield _rows([(now, *_summed(held))])
                    held, most = [], HELD // 2
                now = band
                held.append((pairs, counts))
                if sum(len(p) for p, _ in held) > most:
                    held = [_summed(held)]
                    most = max(HELD // 2, 2 * len(held[0][0]))
        if held:
            yield _rows([(now, *_summed(held))])

    return saved(counted.repartition("band").sortWithinPartitions("band").mapInArrow(add, _BAND), f"{folder}/matrix")


def _entries(pairs: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The terms i, j of pairs."""
    row, j = np.divmod(pairs, size)
    band, at = np.divmod(row, -(-size // BANDS))
    return at * BANDS + band, j


def row_sums(matrix: DataFrame, size: int) -> np.ndarray:
    """The sum of each row of counts."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, pairs, counts in _bands(batch):
                i, _ = _entries(pairs, size)
                starts = np.flatnonzero(np.diff(i, prepend=-1))
                yield pa.RecordBatch.from_arrays([pa.array(i[starts]), pa.array(np.add.reduceat(counts, starts))], ["i", "s"])

    sums = np.zeros(size)
    for r in matrix.mapInArrow(add, "i long, s long").collect():  # a row for each term of the vocabulary
        sums[r.i] = r.s
    return sums


def product(matrix: DataFrame, sums: np.ndarray, factor: np.ndarray, folder: str) -> np.ndarray:
    """The matrix of weights, positive pointwise mutual information of the counts, times a dense factor: all tasks multiply
    their bands, and the driver reads what they wrote."""
    sent, size, total = matrix.sparkSession.sparkContext.broadcast((sums, factor)), len(factor), float(sums.sum())

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, factor = sent.value
        for batch in batches:
            for _, pairs, counts in _bands(batch):
                i, j = _entries(pairs, size)
                w = np.log(counts * total / (sums[i] * sums[j]))
                there = np.flatnonzero(w > 0)
                i, j, w = i[there], j[there], w[there]
                starts = np.flatnonzero(np.diff(i, prepend=-1))
                many = np.diff(starts, append=len(i))
                rows, full = np.zeros((len(starts), factor.shape[1])), np.flatnonzero(many > size // DENSE)
                for at in range(0, len(full), FULL):
                    wide = np.zeros((len(full[at : at + FULL]), size))
                    for to, row in zip(wide, full[at : at + FULL]):
                        to[j[starts[row] : starts[row] + many[row]]] = w[starts[row] : starts[row] + many[row]]
                    rows[full[at : at + FULL]] = wide @ factor
                for row in np.flatnonzero(many <= size // DENSE):
                    a, b = starts[row], starts[row] + many[row]
                    rows[row] = w[a:b] @ factor[j[a:b]]
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (i[starts], rows)], ["i", "rows"])

    out = np.zeros_like(factor)
    # A row a band. Taken from the tasks one by one, they would be made one task at a time.
    for part in saved(matrix.mapInArrow(multiply, "i binary, rows binary"), folder).toLocalIterator():
        out[np.frombuffer(part.i, np.int64)] = np.frombuffer(part.rows).reshape(-1, factor.shape[1])
    sent.destroy()
    return out


def orthonormal(a: np.ndarray) -> np.ndarray:
    """The first factor of numpy's qr of a, which has no fewer rows than columns, in half of its memory."""
    v, scales = np.linalg.qr(a, mode="raw")
    v, k = v.T, len(scales)
    v[:k] = np.tril(v[:k], -1) + np.eye(k)
    inner, turn = v.T @ v, np.zeros((k, k))
    for n, scale in enumerate(scales):  # reflections, as I - v turn v.T
        turn[:n, n], turn[n, n] = -scale * (turn[:n, :n] @ inner[:n, n]), scale
    q = v @ -(turn @ v[:k].T)
    q[:k] += np.eye(k)
    return q


def _seeded(seeds: np.ndarray) -> np.ndarray:
    """For each seed below 2^64 the four numbers that numpy's SeedSequence(seed) gives a generator, all seeds at once."""
    low, half = np.uint64(0xFFFFFFFF), np.uint64(16)
    words = [seeds & low, seeds >> np.uint64(32), np.zeros_like(seeds), np.zeros_like(seeds)]

    def mixer(by: int, times: int):
        def mix(x: np.ndarray) -> np.ndarray:
            nonlocal by
            x = x ^ np.uint64(by)
            by = by * times & 0xFFFFFFFF
            x = x * np.uint64(by) & low
            return x ^ x >> half

        return mix

    mix = mixer(0x43B0D7E5, 0x931E8875)
    pool = [mix(x) for x in words]
    for a in range(4):
        for b in (b for b in range(4) if b != a):
            x = np.uint64(0xCA01F9DD) * pool[b] - np.uint64(0x4973F715) * mix(pool[a]) & low
            pool[b] = x ^ x >> half
    mix = mixer(0x8B51F9DD, 0x58F38DED)
    out = [mix(pool[n % 4]) for n in range(8)]
    return np.stack([out[n] | out[n + 1] << np.uint64(32) for n in range(0, 8, 2)], 1)


def directions(names: list[str], dimensions: int) -> np.ndarray:
    """A direction of its own for each term: normal numbers of numpy's default generator, seeded by the term's hash.

    One generator is set to each seed's state in turn; to make one for each term takes five times as long.
    """
    seeds = np.array([int.from_bytes(hashlib.md5(t.encode()).digest()[:6], "big") for t in names], np.uint64)
    source, out, low = np.random.PCG64(0), np.empty((len(names), dimensions)), (1 << 128) - 1
    draw = np.random.Generator(source)
    for row, (a, b, c, d) in zip(out, _seeded(seeds).tolist()):
        step = (c << 64 | d) << 1 & low | 1
        state = (step + (a << 64 | b)) * 0x2360ED051FC65DA44385DF649FCCF645 + step & low
        source.state = {"bit_generator": "PCG64", "state": {"state": state, "inc": step}, "has_uint32": 0, "uinteger": 0}
        draw.standard_normal(out=row)
    out /= np.sqrt(np.einsum("ij,ij->i", out, out))[:, None]
    return out


@dataclass
class TermVectors:
    """An embedder: names of terms, their vectors and weights, and the direction that texts have in common."""

    names: list[str]
    vectors: np.ndarray
    weights: np.ndarray
    common: np.ndarray

    def __post_init__(self) -> None:
        norm = np.linalg.norm(self.vectors, axis=1, keepdims=True)
        self.places = {t: i for i, t in enumerate(self.names)}
        self.added = directions(self.names, self.vectors.shape[1])
        self.added += self.vectors / np.where(norm > 1e-9, norm, 1)
        self.added *= self.weights[:, None]
        self.drawn: dict[str, np.ndarray] = {}
        self.older: dict[str, np.ndarray] = {}

    def __getstate__(self) -> dict:
        """What a task needs to embed texts: without the terms' vectors themselves, and the terms that a worker keeps."""
        return self.__dict__ | {"vectors": self.vectors[:0], "drawn": {}, "older": {}}

    def own(self, names: list[str]) -> np.ndarray:
        """The terms' directions of their own; those of other terms than the model's that came last are kept."""
        found = [self.drawn.get(t, self.older.get(t)) for t in names]
        made = iter(directions([t for t, x in zip(names, found) if x is None], self.vectors.shape[1]))
        found = [next(made).copy() if x is None else x for x in found]
        for t, x in zip(names, found):
            if len(self.drawn) >= KEPT // 2:
                self.older, self.drawn = self.drawn, {}
            self.drawn[t] = x
        return np.concatenate([*found, np.zeros(0)]).reshape(len(names), -1)

    def whole(self, term: str) -> np.ndarray:
        """What a term adds to a text."""
        i = self.places.get(term)
        return OTHER * self.own([term])[0] if i is None else self.added[i]

    def embed(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros((len(texts), self.vectors.shape[1]))
        for at in range(0, len(texts), TOGETHER):
            names, ids, rows = coded(texts[at : at + TOGETHER])
            if not len(ids):
                continue
            # Each term of a text once, times how often the text has it.
            each, times = np.unique(rows * len(names) + ids, return_counts=True)
            (rows, ids), times = np.divmod(each, len(names)), times.astype(float)
            places = _places(names, self.places)
            known = places[ids] >= 0
            _add(out[at:], rows[known], times[known], self.added, places[ids[known]])
            held = names.to_numpy(zero_copy_only=False)
            others = np.flatnonzero((places < 0) & (held != ""))
            for first in range(0, len(others), DRAWN):
                some = others[first : first + DRAWN]
                places[others] = -1
                places[some] = np.arange(len(some))
                here = ~known & (places[ids] >= 0)
                _add(out[at:], rows[here], times[here], OTHER * self.own(list(held[some])), places[ids[here]])
        out -= (out @ self.common)[:, None] * self.common
        norm = np.sqrt((out**2).sum(1, keepdims=True))
        return np.where(norm > 1e-9, out / np.where(norm > 1e-9, norm, 1), 0)


@dataclass
class Sent:
    """An embedder that workers get by a broadcast: each reads it once, not with every task, and keeps what it has drawn."""

    model: Broadcast

    def embed(self, texts: list[str | None]) -> np.ndarray:
        return self.model.value.embed(texts)


def _add(out: np.ndarray, rows: np.ndarray, times: np.ndarray, vectors: np.ndarray, places: np.ndarray) -> None:
    """Adds vectors[places] times times to the rows of out; rows ascend."""
    starts = np.flatnonzero(np.diff(rows, prepend=-1))
    for a, b in zip(starts, [*starts[1:], len(rows)]):
        for at in range(a, b, DRAWN):
            out[rows[a]] += times[at : min(b, at + DRAWN)] @ vectors[places[at : min(b, at + DRAWN)]]


def fit(texts: DataFrame, *, dimensions: int = DIMENSIONS, size: int = VOCABULARY, window: int = WINDOW, power: int = POWER) -> TermVectors:
    """Term vectors of all texts(text)."""
    spark = texts.sparkSession
    folder = scratch(spark, "embedding")
    with tidy_shuffles(spark):
        names, shares = vocabulary(texts, size)
        matrix = banded(pair_counts(texts, names, window), folder)
        sums = row_sums(matrix, len(names))
        k = min(dimensions + EXTRA, len(names))
        basis = np.random.default_rng(SEED).normal(size=(len(names), k))
        for n in range(power):
            basis = product(matrix, sums, basis, f"{folder}/product{n}")
            basis = orthonormal(basis) if k else basis
        small = basis.T @ product(matrix, sums, basis, f"{folder}/product")
    values, turns = np.linalg.eigh((small + small.T) / 2)
    best = [i for i in np.argsort(-values, kind="stable")[:dimensions] if values[i] > 1e-9]
    vectors = basis @ (turns[:, best] * np.sqrt(values[best]))
    del basis
    if vectors.shape[1] == 0:
        return TermVectors([], np.zeros((0, dimensions)), np.zeros(0), np.zeros(dimensions))
    weights = SMOOTH / (SMOOTH + shares)
    mean = (weights * shares) @ vectors
    return TermVectors(names, vectors, weights, mean / max(np.linalg.norm(mean), 1e-12))
