"""Removal of repeated passages, found by recompression.

Recompression shortens every document in rounds: a maximal run of one symbol becomes one symbol, then each pair
of a left and a right symbol (a coin tossed from the symbol's name and the round) becomes one. Names are hashes
of what they stand for, so all tasks name equal runs and pairs alike without a shared dictionary, and equal
passages get equal symbols inside, wherever they stand; only symbols near a passage's ends may differ.

For each symbol the rounds also keep its support, the words that fix it, and its name in context: its own and those
of the neighbours that fixed it. A symbol whose support lies in a window is the same, in the same context, in every
equal window, so each window has a landmark that depends on its words alone: of the highest symbols with support in
the window, the one whose name in context is least (a window without such a symbol is its own landmark). Landmarks
are several times fewer than windows. The steps are:

0. texts equal to one of a smaller document are repeats as a whole, and take no further part;
1. the rounds give the landmarks of each text, and names that two documents share are kept;
2. among windows with such a landmark only, a task settles those it has seen in a smaller document itself, so it
   sends on one row for each window and buffer, however many documents have it and however often;
3. what is left is sorted by window and document and read in that order: a window is a repeat in every document
   but the first. The words that repeats cover are dropped.

Landmarks only choose what to compare. Windows are verified by two independent 64-bit hashes of their words: among
10^13 windows, two different ones agree in both with a chance of about 10^-13.

Defined cases: a null or blank text has no words and loses none. Rows with a null id neither lose words nor
make others lose them. Rows that share an id are judged each on its own text and don't affect each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.rows import pack, unpack
from loomwork.session import broadcast_if_small, drop, saved, scratch, tidy_shuffles

#: More rounds would give symbols whose support rarely fits in a window of 13 words.
WINDOW, ROUNDS = 13, 2
#: Covered places of all texts that are broadcast to them, and ids of copies, at most; with more, texts are shuffled.
BROADCAST_PLACES, BROADCAST_IDS = 2_000_000, 1_000_000
#: Words parsed at once in a task; windows that a task holds before it sends them on.
BLOCK_WORDS, BUFFER = 50_000, 200_000

# Odd multipliers for mixing and for the two rolling hashes.
MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


class Spans:
    """Hashes of any span of an array of word hashes."""

    def __init__(self, words: np.ndarray, base: np.uint64):
        powers = np.full(len(words) + 1, base, np.uint64)
        powers[0] = 1
        np.multiply.accumulate(powers, out=powers)
        inverse = np.full(len(words) + 1, pow(int(base), -1, 1 << 64), np.uint64)
        inverse[0] = 1
        self.back = np.multiply.accumulate(inverse)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * powers[: len(words)], dtype=np.uint64)])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        value = (self.sums[end] - self.sums[start]) * self.back[start]
        return mix(value + (end - start).astype(np.uint64) * MIX_B)


class Level:
    """Symbols of one round over a block of documents: names, names in context, supports as half-open spans."""

    def __init__(self, name, context, low, high, doc):
        self.name, self.context, self.low, self.high, self.doc = name, context, low, high, doc


def together(*names: np.ndarray) -> np.ndarray:
    """One name for several in order."""
    total = names[0]
    for name in names[1:]:
        total = mix(total * MIX_A + name)
    return total


def next_level(at: Level, edges: tuple[np.ndarray, np.ndarray], round_: int) -> Level:
    """The symbols after naming runs and then pairs; edges are each document's first and last word places."""
    first_word, end_word = edges
    new = np.ones(len(at.name), bool)
    new[1:] = (at.name[1:] != at.name[:-1]) | (at.doc[1:] != at.doc[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(new)) - 1
    length = (last - first + 1).astype(np.uint64)
    name = np.where(length > 1, mix(at.name[first] + length * MIX_A), at.name[first])
    doc = at.doc[first]
    # A run ends where its neighbours differ, so their supports count; a document's edge isn't in any window.
    before, after = np.maximum(first - 1, 0), np.minimum(last + 1, len(new) - 1)
    low = np.where((first > 0) & (at.doc[before] == doc), at.low[before], first_word[doc] - 1)
    high = np.where((last + 1 < len(new)) & (at.doc[after] == doc), at.high[after], end_word[doc] + 1)
    context = together(at.context[before], name, at.context[after])
    right = (mix(name + np.uint64((round_ + 1) * int(MIX_B) & (1 << 64) - 1)) & np.uint64(1)).astype(bool)
    next_same = np.zeros(len(name), bool)
    next_same[:-1] = doc[1:] == doc[:-1]
    opens = np.zeros(len(name), bool)
    opens[:-1] = ~right[:-1] & right[1:] & next_same[:-1]
    closes = np.append(False, opens[:-1])
    # A left symbol alone depends on its next neighbour, a right symbol alone on the one before.
    i = np.arange(len(name))
    later, earlier = np.minimum(i + 1, len(i) - 1), np.maximum(i - 1, 0)
    lone_high = np.where(next_same, high[later], end_word[doc] + 1)
    lone_low = np.where(np.append(False, next_same[:-1]), low[earlier], first_word[doc] - 1)
    lone = ~opens & ~closes
    beside = np.where(lone & ~right, together(context, context[later]), np.where(lone & right, together(context[earlier], context), context))
    high = np.where(lone & ~right, lone_high, high)
    low = np.where(lone & right, lone_low, low)
    keep = np.flatnonzero(~closes)
    mate = np.where(opens[keep], keep + 1, keep)
    merged = np.where(opens[keep], together(name[keep], name[mate]), name[keep])
    context = np.where(opens[keep], together(context[keep], context[mate]), beside[keep])
    # Supports must not shrink to the left or right of an earlier symbol's, for the search below.
    return Level(merged, context, np.minimum(low[keep], low[mate]), np.maximum(high[keep], high[mate]), doc[keep])


def landmarks(words: np.ndarray, counts: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, key) of every window of a block; words are hashes, counts the words of each document."""
    end_word = np.cumsum(counts)
    first_word = end_word - counts
    per = np.maximum(counts - window + 1, 0)
    doc = np.repeat(np.arange(len(counts)), per)
    starts = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per) + first_word[doc]
    if not len(doc):
        return doc, doc, np.zeros(0, np.uint64)
    spans = Spans(words, BASES[0])
    key = np.zeros(len(doc), np.uint64)
    todo = np.arange(len(doc))
    n = np.arange(len(words))
    level, levels = Level(words, words, n, n + 1, np.repeat(np.arange(len(counts)), counts)), []
    for r in range(ROUNDS):
        level = next_level(level, (first_word, end_word), r)
        levels.append(level)
    for r in range(ROUNDS, 0, -1):
        level = levels[r - 1]
        fits = np.flatnonzero((level.high - level.low <= window) & (level.low >= first_word[level.doc]) & (level.high <= end_word[level.doc]))
        low, high = level.low[fits], level.high[fits]
        if not len(todo) or not len(fits):
            continue
        names = mix(level.context[fits] ^ np.uint64(r))
        # Supports may nest a little, so search each bound in running extremes and test the other.
        least, most = np.minimum.accumulate(low[::-1])[::-1], np.maximum.accumulate(high)
        at = starts[todo]
        a = np.searchsorted(np.maximum.accumulate(low), at, "left")
        b = np.searchsorted(np.minimum.accumulate(high[::-1])[::-1], at + window, "right")
        best = np.full(len(todo), np.iinfo(np.uint64).max, np.uint64)
        for k in range(int(max(0, (b - a).max(initial=0)))):
            i = np.minimum(a + k, len(fits) - 1)
            ok = (a + k < b) & (low[i] >= at) & (high[i] <= at + window)
            best = np.where(ok, np.minimum(best, names[i]), best)
        found = best != np.iinfo(np.uint64).max
        key[todo[found]] = best[found]
        todo = todo[~found]
    key[todo] = spans(starts[todo], starts[todo] + window)
    return doc, starts - first_word[doc], key


def _blocks(texts: list[str | None]) -> Iterator[tuple[int, int, list[list[bytes]]]]:
    """(from, to, words of each text) of consecutive texts, about BLOCK_WORDS words at a time."""
    at, held, n = 0, [], 0
    for i, text in enumerate(texts):
        held.append((text or "").encode().split())
        n += len(held[-1])
        if n >= BLOCK_WORDS or i == len(texts) - 1:
            yield at, i + 1, held
            at, held, n = i + 1, [], 0


def _hashes(held: list[list[bytes]], digest) -> tuple[np.ndarray, np.ndarray]:
    counts = np.array([len(w) for w in held], np.int64)
    return np.fromiter((digest(x) for w in held for x in w), np.uint64, int(counts.sum())), counts


def _batches(rows: Iterator[pa.RecordBatch], size: int = 512) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)


def _doc_landmarks(docs: DataFrame, window: int) -> DataFrame:
    """(doc_id, tag, keys) of the texts that are long enough: their distinct landmarks."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _batches(batches):
            for a, b, held in _blocks(batch.column("text").to_pylist()):
                words, counts = _hashes(held, xxhash.xxh64_intdigest)
                doc, _, key = landmarks(words, counts, window)
                order = np.lexsort((key, doc))
                doc, key = doc[order], key[order]
                once = np.ones(len(doc), bool)
                once[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
                ends = np.concatenate([[0], np.cumsum(np.bincount(doc[once], minlength=b - a))]).astype(np.int32)
                keys = pa.ListArray.from_arrays(pa.array(ends), pa.array(key[once].view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(a, b - a) for c in ("doc_id", "tag")] + [keys], ["doc_id", "tag", "keys"])

    return docs.select("doc_id", "tag", "text").mapInArrow(rows, "doc_id long, tag long, keys array<long>").where(F.size("keys") > 0)


REPEAT = "w1 long, w2 long, doc_id long, tag long, starts array<int>, n int, sure boolean"


def _record(w1, w2, doc_id, tag, ends, starts, n, sure) -> pa.RecordBatch:
    lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(starts))
    columns = [pa.array(w1), pa.array(w2), pa.array(doc_id), pa.array(tag), lists, pa.array(n.astype(np.int32)), pa.array(np.full(len(w1), sure))]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in REPEAT.split(", ")])


def _new(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before in any of the columns."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def settle(w1: np.ndarray, w2: np.ndarray, doc_id: np.ndarray, tag: np.ndarray, start: np.ndarray) -> Iterator[pa.RecordBatch]:
    """REPEAT rows of a buffer of windows: for each window its least document, with all its places, and runs of n
    windows of the other documents, which are repeats for sure."""
    order = np.lexsort((start, tag, doc_id, w2, w1))
    w1, w2, doc_id, tag, start = (x[order] for x in (w1, w2, doc_id, tag, start))
    new = _new(w1, w2)
    sure = doc_id > doc_id[np.flatnonzero(new)][np.cumsum(new) - 1]
    a, b, d, t, places = (x[~sure] for x in (w1, w2, doc_id, tag, start))
    heads = np.flatnonzero(_new(a, b, d, t))
    yield _record(a[heads], b[heads], d[heads], t[heads], np.append(heads, len(places)), places, np.ones(len(heads)), False)
    doc_id, tag, start = doc_id[sure], tag[sure], start[sure]
    order = np.lexsort((start, tag, doc_id))
    doc_id, tag, start = doc_id[order], tag[order], start[order]
    if len(start):
        head = _new(doc_id, tag)
        head[1:] |= start[1:] > start[:-1] + 1
        first = np.flatnonzero(head)
        last = np.append(first[1:], len(start)) - 1
        spread = mix(doc_id[first].view(np.uint64) + start[first].astype(np.uint64)).view(np.int64)
        yield _record(spread, tag[first], doc_id[first], tag[first], np.arange(len(first) + 1), start[first], start[last] - start[first] + 1, True)


def _windows(docs: DataFrame, window: int) -> DataFrame:
    """REPEAT rows of the windows whose landmark is in the row's array keys."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_back: list[tuple[np.ndarray, ...]] = []
        for batch in _batches(batches):
            ids, tags = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "tag"))
            keys = batch.column("keys")
            for a, b, held in _blocks(batch.column("text").to_pylist()):
                words, counts = _hashes(held, xxhash.xxh64_intdigest)
                doc, start, key = landmarks(words, counts, window)
                part = keys.slice(a, b - a)
                wanted = part.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                owner = np.repeat(np.arange(b - a), np.array(part.value_lengths().to_numpy(zero_copy_only=False), np.int64))
                salt = lambda d: mix(d.astype(np.uint64) + MIX_A)  # noqa: E731  a key counts in its own document
                hit = np.flatnonzero(np.isin(key ^ salt(doc), wanted ^ salt(owner)))
                if not len(hit):
                    continue
                doc, start = doc[hit], start[hit]
                at = np.cumsum(counts)[doc] - counts[doc] + start
                second, _ = _hashes(held, xxhash.xxh3_64_intdigest)
                w1, w2 = (Spans(w, base)(at, at + window) for w, base in zip((words, second), BASES))
                held_back.append((w1.view(np.int64), w2.view(np.int64), ids[a + doc].astype(np.int64), tags[a + doc].astype(np.int64), start.astype(np.int32)))
                if sum(len(x[0]) for x in held_back) >= BUFFER:
                    yield from settle(*(np.concatenate(c) for c in zip(*held_back)))
                    held_back = []
        if held_back:
            yield from settle(*(np.concatenate(c) for c in zip(*held_back)))

    return docs.select("doc_id", "tag", "text", "keys").mapInArrow(rows, REPEAT)


def _repeats(windows: DataFrame) -> DataFrame:
    """(doc_id, tag, starts, n) of all repeats: each window's rows follow each other, the smallest document first."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, first_id = None, None
        for batch in batches:
            w1, w2, doc_id, sure = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("w1", "w2", "doc_id", "sure"))
            if not len(w1):
                continue
            new = _new(w1, w2, sure)
            new[0] = before != (w1[0], w2[0], sure[0])
            firsts = np.where(new, doc_id, 0)[np.maximum.accumulate(np.where(new, np.arange(len(w1)), 0))]
            if not new[0]:
                firsts[: np.argmax(new) if new.any() else len(new)] = first_id
            before, first_id = (w1[-1], w2[-1], sure[-1]), firsts[-1]
            yield batch.select(["doc_id", "tag", "starts", "n"]).filter(pa.array(sure | (doc_id > firsts)))

    ordered = windows.repartition("w1", "w2").sortWithinPartitions("w1", "w2", "sure", "doc_id")
    return ordered.mapInArrow(rows, "doc_id long, tag long, starts array<int>, n int")


def covered(runs: list[dict], window: int) -> list[int]:
    """From and to of the places that windows in runs (start, n) cover, merged: [from, to, from, to, ...]."""
    found: list[int] = []
    for start, end in sorted((r["start"], r["start"] + r["n"] - 1 + window) for r in runs):
        if found and start <= found[-1]:
            found[-1] = max(found[-1], end)
        else:
            found += [start, end]
    return found


def repeated_places(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, tag, places) of documents with repeats: tag is xxhash64(text); places are from and to of repeated words,
    and null if all of a text that is long enough for a window are."""
    spark = docs.sparkSession
    folder = scratch(spark, "recompress")

    @F.pandas_udf("array<int>")
    def merged(runs: pd.Series) -> pd.Series:
        return pd.Series([covered(r, window) for r in runs])

    with tidy_shuffles(spark):
        docs = docs.select("doc_id", "text").where("doc_id is not null").withColumn("tag", F.xxhash64("text"))
        copies = _copies(docs, folder)
        later = copies.select(F.col("doc_id").alias("later_id"), F.col("tag").alias("later_tag"))
        left = docs.join(broadcast_if_small(later, BROADCAST_IDS), (F.col("doc_id") == F.col("later_id")) & (F.col("tag") == F.col("later_tag")), "left_anti")
        marks = saved(_doc_landmarks(left, window), f"{folder}/marks")
        keys = marks.select("doc_id", "tag", F.explode("keys").alias("key"))
        per_key = keys.groupBy("key").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))
        shared = saved(per_key.where("first_id < last_id").select("key"), f"{folder}/shared")
        wanted = saved(keys.join(shared, "key").groupBy("doc_id", "tag").agg(F.collect_set("key").alias("keys")), f"{folder}/wanted")
        drop(spark, f"{folder}/marks", f"{folder}/shared")
        runs = _repeats(_windows(left.join(wanted, ["doc_id", "tag"]), window)).select("doc_id", "tag", F.explode("starts").alias("start"), "n")
        found = saved(runs.groupBy("doc_id", "tag").agg(merged(F.collect_set(F.struct("start", "n"))).alias("places")), f"{folder}/places")
        drop(spark, f"{folder}/wanted")
    return found.union(copies.select("doc_id", "tag", F.lit(None).cast("array<int>").alias("places")))


def _copies(docs: DataFrame, folder: str) -> DataFrame:
    """(doc_id, tag) of the rows whose text a document with a smaller id has."""
    seen = docs.select("doc_id", "tag", F.unhex(F.md5("text")).alias("digest"))
    first = seen.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))
    first = saved(first.where("first_id < last_id").select("digest", "first_id"), f"{folder}/first")
    return saved(seen.join(first, "digest").where("first_id < doc_id").select("doc_id", "tag").distinct(), f"{folder}/copies")


def kept_words(text: str | None, copied: bool, places, window: int = WINDOW) -> tuple[int, list[bytes]]:
    """Number of words of a text, and the words outside places; of a copied text, those of one too short for a window."""
    words = (text or "").encode().split()
    if copied:
        return len(words), words if len(words) < window else []
    kept, at = [], 0
    for start, end in zip(places[::2], places[1::2]) if places is not None else ():
        kept += words[at:start]
        at = end
    return len(words), kept + words[at:]


def _with_places(docs: DataFrame, window: int) -> DataFrame:
    """docs with lw_found, whether a text has repeats, and lw_places of them, null if it is a copy as a whole."""
    found = repeated_places(docs, window).select(F.col("doc_id").alias("lw_id"), F.col("tag").alias("lw_tag"), F.col("places").alias("lw_places"), F.lit(True).alias("lw_found"))
    n = found.agg(F.sum(F.coalesce(F.size("lw_places"), F.lit(1)) + 2)).first()[0] or 0
    found = F.broadcast(found) if n <= BROADCAST_PLACES else found
    return docs.join(found, (docs["doc_id"] == found["lw_id"]) & (F.xxhash64(docs["text"]) == found["lw_tag"]), "left")


def drop_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with repeats cut out of text, and n_chars, if there is such a column, counted anew.

    A text without repeats is left as it is; what is kept of another is its words joined by single spaces.
    """

    @F.pandas_udf("string")
    def kept(texts: pd.Series, places: pd.Series) -> pd.Series:
        return pd.Series([b" ".join(kept_words(t, p is None, p, window)[1]).decode() for t, p in zip(texts, places)], dtype=object)

    names = ("doc_id", "text")
    joined = _with_places(pack(docs, *names), window)
    cut = F.col("lw_found").isNotNull()
    changed = joined.withColumn("lw_text", F.when(cut, kept(F.when(cut, F.col("text")), F.col("lw_places"))))
    new = {"text": F.when(cut, F.col("lw_text")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(cut, F.length("lw_text").cast("long")).otherwise(F.col("lw_row.n_chars"))
    return unpack(changed, docs, names, **new)


def repeat_report(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The contract's columns."""

    @F.pandas_udf("n_words long, n_removed long, kept_sha256 string")
    def report(texts: pd.Series, found: pd.Series, places: pd.Series) -> pd.DataFrame:
        rows = []
        for text, some, at in zip(texts, found, places):
            n, kept = kept_words(text, bool(some) and at is None, at, window)
            rows.append((n, n - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
        return pd.DataFrame(rows, columns=["n_words", "n_removed", "kept_sha256"])

    joined = _with_places(docs.select("doc_id", "text"), window)
    return joined.select("doc_id", report("text", F.coalesce("lw_found", F.lit(False)), "lw_places").alias("r")).select("doc_id", "r.*")
