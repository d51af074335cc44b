"""Source divergence audit: how far the term shares of each source are from those of the other sources of its language.

Every task counts the terms of its documents in byte tries, one for each language, whose leaves hold a count for each
source. A node keeps its leaves in one table until there are more than BURST, and then hands them on to nodes below, by
their next STRIDE bytes. A trie is walked in UTF-8 order and its leaves are merged with those of all other tries by range
of (language, prefix): in a range they arrive sorted, so equal terms meet, and what a task holds is one term's counters.

Kept terms leave the walk in blocks. A second pass streams the blocks past the sources' totals: it adds up each pair of
sources, and holds the CANDIDATES best terms of a source in tie order. Sources of a language are dealt by hash to tiles
of about TILE, and blocks meet pairs of tiles, so what a task holds doesn't grow with their number.

All arithmetic is on whole numbers, exactly; a sum beyond 64 bits is an error.

Defined cases: null text, language and source count as the empty string. Documents that repeat, ids included, count
each time; the id is never read. A language without kept terms has pairs of value 0; a source without terms takes part
with counts of 0. Equal values rank by the item's UTF-8 bytes. An empty table gives no rows.
"""

from __future__ import annotations

import pickle
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomwork.session import broadcast_if_small, saved, scratch, tidy_shuffles

LEAST_DOCUMENTS, CANDIDATES, SCALE = 3, 200, 1_000_000_000
#: Bytes of a step down a trie, leaves of a node that it keeps itself, and leaves of a task's tries before they move on.
STRIDE, BURST, LEAVES = 3, 512, 500_000
#: Bytes of text counted at once, and rows taken; leaves of a block; sources of a tile; pairs of tiles that are broadcast.
WINDOW, SLICE, BLOCK, TILE, SENT_TILES = 4 << 20, 256, 1_000, 1_000, 64
#: Leaves of one term, and pairs of tiles with their sums, that a task holds; rows of an Arrow batch that it gives.
HELD_LEAVES, HELD, BATCH = 10_000, 8, 50_000

TERMS = "lang string, term binary, documents long, leaf binary"
BLOCKS = "lang string, leaves long, block binary, sources array<struct<source: string, n: long>>"
PARTS = "lang string, source string, part string, item string, value long"
#: A to Z in lower case, other ASCII characters that aren't letters as spaces.
_FOLD = bytes(b | 0x20 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def terms_of(data: bytes) -> Iterator[list[bytes]]:
    """The terms of a folded text, in lists of those of about WINDOW bytes."""
    at = 0
    while at < len(data):
        end = len(data)
        if end - at > WINDOW:
            end = data.rfind(b" ", at, at + WINDOW)
            if end < 0:
                end = data.find(b" ", at + WINDOW)
            end = len(data) if end < 0 else end + 1
        yield data[at:end].split()
        at = end


def counted(texts: list[bytes], groups: list[int], n_groups: int) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms, and in the order of (term, group) the term's number, the group, occurrences and documents of each term in
    each group; groups has the group of each folded text."""
    lines = pa.array(texts, pa.binary())
    words = pc.ascii_split_whitespace(pa.StringArray.from_buffers(len(lines), *lines.buffers()[1:]))
    coded = words.flatten().dictionary_encode()
    text, term = pc.list_parent_indices(words).to_numpy(), coded.indices.to_numpy().astype(np.int64)
    named = coded.dictionary.to_pylist()
    full = np.array([bool(x) for x in named], bool)[term] if named else term > 0  # white space at an end leaves an empty one
    size = len(texts)
    own, times = np.unique(term[full] * size + text[full], return_counts=True)  # of each text
    both = own // size * n_groups + np.array(groups, np.int64)[own % size]
    order = np.argsort(both, kind="stable")
    both, times = both[order], times[order]
    starts = np.flatnonzero(np.diff(both, prepend=-1))
    if not len(starts):
        return [], both, both, both, both
    return [x.encode() for x in named], both[starts] // n_groups, both[starts] % n_groups, np.add.reduceat(times, starts), np.diff(starts, append=len(both))


#: {source: count}, and the number of documents under None. A dict of strings and numbers costs the collector nothing.
Leaf = dict[str | None, int]


class Trie:
    """A byte trie; the leaf of a term is {source: count}, with the number of documents under None."""

    __slots__ = ("held", "below")

    def __init__(self) -> None:
        #: Leaves by the rest of their key; once there are nodes below, only those shorter than a step.
        self.held: dict[bytes, Leaf] = {}
        self.below: dict[bytes, Trie] | None = None

    def leaf(self, key: bytes) -> Leaf:
        """The leaf of key, made if it isn't there."""
        node = self
        while node.below is not None and len(key) >= STRIDE:
            step = node.below.get(key[:STRIDE])
            if step is None:
                step = node.below[key[:STRIDE]] = Trie()
            node, key = step, key[STRIDE:]
        found = node.held.get(key)
        if found is None:
            found = node.held[key] = {}
            if len(node.held) > BURST and node.below is None:
                node._burst()
        return found

    def _burst(self) -> None:
        self.below = {}
        for key in [k for k in self.held if len(k) >= STRIDE]:
            self.below.setdefault(key[:STRIDE], Trie()).held[key[STRIDE:]] = self.held.pop(key)

    def walk(self) -> Iterator[tuple[bytes, Leaf]]:
        """(key, leaf) of every term, in the order of the keys' bytes."""
        todo: list[tuple[bytes, Trie | Leaf]] = [(b"", self)]
        while todo:
            key, x = todo.pop()
            if isinstance(x, dict):
                yield key, x
            elif x.below is None:
                for k in sorted(x.held):
                    yield key + k, x.held[k]
            else:  # a leaf that a node keeps beside others below is shorter than their steps
                both = {**x.held, **x.below}
                todo += [(key + k, both[k]) for k in sorted(both, reverse=True)]


def _leaves_of(tries: dict[str, Trie]) -> Iterator[pa.RecordBatch]:
    """A row for each leaf, in the order of the walk."""
    for lang, trie in tries.items():
        walk = trie.walk()
        while rows := list(islice(walk, BATCH)):
            documents = [x.pop(None) for _, x in rows]
            columns = [pa.array([lang] * len(rows), pa.string()), pa.array([k for k, _ in rows], pa.binary()), pa.array(documents, pa.int64()), pa.array([pickle.dumps(x) for _, x in rows], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "term", "documents", "leaf"])


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts (lang, source, text) rows in tries; texts of about WINDOW bytes together are counted in arrays first, so a
    trie is touched once for each term that differs among them."""
    tries: dict[str, Trie] = {}
    held: dict[tuple[str, str], list[bytes]] = {}
    leaves = size = 0

    def settle() -> int:
        groups, new = sorted(held), 0
        of = [(lang, source, tries.setdefault(lang, Trie()).leaf) for lang, source in groups]
        texts = [t for g in groups for t in held[g]]
        terms, *columns = counted(texts, [i for i, g in enumerate(groups) for _ in held[g]], len(groups))
        last, x = None, {}
        for term, group, n, documents in zip(*(c.tolist() for c in columns)):
            lang, source, leaf = of[group]
            if (term, lang) != last:
                x, last = leaf(terms[term]), (term, lang)
                new += not x
            x[source] = x.get(source, 0) + n
            x[None] = x.get(None, 0) + documents
        held.clear()
        return new

    def alone(lang: str, source: str, data: bytes) -> int:
        """A text of more than WINDOW bytes."""
        found: Counter = Counter()
        for terms in terms_of(data):
            found.update(terms)
        leaf, new = tries.setdefault(lang, Trie()).leaf, 0
        for term, n in found.items():
            x = leaf(term)
            new += not x
            x[source] = x.get(source, 0) + n
            x[None] = x.get(None, 0) + 1
        return new

    for batch in (whole.slice(at, SLICE) for whole in batches for at in range(0, whole.num_rows, SLICE)):
        for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text"))):
            data = text.encode().translate(_FOLD)
            if len(data) > WINDOW:
                leaves += alone(lang, source, data)
                continue
            held.setdefault((lang, source), []).append(data)
            size += len(data) + 64
            if size > WINDOW:
                leaves, size = leaves + settle(), 0
        if leaves > LEAVES:
            yield from _leaves_of(tries)
            tries.clear()
            leaves = 0
    leaves += settle()
    yield from _leaves_of(tries)


def merged(leaves: list[bytes]) -> Leaf:
    """One leaf of those of a term; only terms that are kept come to it."""
    whole = pickle.loads(leaves[0])
    for leaf in leaves[1:]:
        for source, n in pickle.loads(leaf).items():
            whole[source] = whole.get(source, 0) + n
    return whole


def _merge(least: int):
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Leaves in the order of (lang, term) as blocks of the kept ones."""
        block: list[tuple[bytes, dict[str, int]]] = []
        of = key = None
        documents, leaves = 0, []

        def given() -> pa.RecordBatch:
            sums: Counter = Counter()
            for _, counts in block:
                sums.update(counts)
            sources = pa.array([[{"source": s, "n": n} for s, n in sums.items()]], pa.list_(pa.struct([("source", pa.string()), ("n", pa.int64())])))
            return pa.RecordBatch.from_arrays([pa.array([of]), pa.array([len(block)], pa.int64()), pa.array([pickle.dumps(block)], pa.binary()), sources], ["lang", "leaves", "block", "sources"])

        for batch in batches:
            for lang, term, n, leaf in zip(*(batch.column(c).to_pylist() for c in ("lang", "term", "documents", "leaf"))):
                if term == key and lang == of:
                    documents += n
                    leaves.append(leaf)
                    if len(leaves) > HELD_LEAVES:
                        leaves = [pickle.dumps(merged(leaves))]
                    continue
                if documents >= least:
                    block.append((key, merged(leaves)))
                if block and (lang != of or len(block) >= BLOCK):
                    yield given()
                    block = []
                of, key, documents, leaves = lang, term, n, [leaf]
        if documents >= least:
            block.append((key, merged(leaves)))
        if block:
            yield given()

    return merge


def kept_terms(docs: DataFrame, folder: str, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """Blocks of the terms that at least `least` documents of their language have, with their counts by source."""
    leaves = saved(docs.select("lang", "source", "text").mapInArrow(count_terms, TERMS), f"{folder}/leaves")
    ranged = leaves.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term")
    return saved(ranged.mapInArrow(_merge(least), BLOCKS), f"{folder}/blocks")


def shares(counts: np.ndarray, n, v: int, scale: int = SCALE) -> np.ndarray:
    """1 + floor(scale * (count + 1) / (n + v)) of each count, exactly; n is a number, or one for each column."""
    if counts.size and int(counts.max()) + 1 > (2**63 - 1) // scale:
        below = np.broadcast_to(np.asarray(n, dtype=object), counts.shape)
        return np.array([1 + scale * (int(c) + 1) // (int(m) + v) for c, m in zip(counts.ravel(), below.ravel())], np.int64).reshape(counts.shape)
    return 1 + scale * (counts + 1) // (np.asarray(n, np.int64) + v)


class _Best:
    """The CANDIDATES items of highest value, ties to the smaller item."""

    def __init__(self) -> None:
        self.rows: list[tuple[int, bytes]] = []

    def take(self, values: np.ndarray, terms: list[bytes]) -> None:
        """values with their terms, which ascend."""
        self.rows += [(-int(values[i]), terms[i]) for i in np.argsort(-values, kind="stable")[:CANDIDATES]]
        if len(self.rows) > 4 * CANDIDATES:
            self.settle()

    def settle(self) -> list[tuple[int, bytes]]:
        self.rows.sort()
        del self.rows[CANDIDATES:]
        return self.rows


def _dense(leaves: list[tuple[bytes, dict[str, int]]], names: list[str]) -> np.ndarray:
    """(leaves, names) counts; names ascend."""
    found = np.zeros((len(leaves), len(names)), np.int64)
    for row, (_, counts) in enumerate(leaves):
        for source, n in counts.items():
            at = bisect_left(names, source)
            if at < len(names) and names[at] == source:
                found[row, at] = n
    return found


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with a pair of tiles each, as sums of the pairs of sources and candidates among the terms."""
    sums: dict[tuple, tuple[list[str], list[str], np.ndarray]] = {}
    best: dict[tuple[str, str], _Best] = {}

    def given() -> Iterator[pa.RecordBatch]:
        rows: list[tuple[str, str, str, str, int]] = []
        for (lang, _, _), (left, right, total) in sums.items():
            for s, line in zip(left, total.tolist()):
                rows += [(lang, s, "pair", t, x) for t, x in zip(right, line) if s != t]
                if len(rows) >= BATCH:
                    yield _parts(rows)
                    rows = []
        for (lang, source), top in best.items():
            rows += [(lang, source, "term", term.decode(), -x) for x, term in top.settle()]
            if len(rows) >= BATCH:
                yield _parts(rows)
                rows = []
        if rows:
            yield _parts(rows)
        sums.clear()
        best.clear()

    for batch in batches:
        for r in (batch.slice(at, 1).to_pylist()[0] for at in range(batch.num_rows)):
            leaves, v, lang = pickle.loads(r["block"]), r["v"], r["lang"]
            sides = []
            for side in ("left", "right"):
                names = [x["source"] for x in r[side]]
                sides.append((names, _dense(leaves, names), np.array([x["n"] for x in r[side]], np.int64)))
            (left, counts, n), (right, others, m) = sides
            p, q = shares(counts, n, v), shares(others, m, v)
            key = (lang, r["i"], r["j"])
            if key not in sums:
                if len(sums) >= HELD:
                    yield from given()
                sums[key] = (left, right, np.zeros((len(left), len(right)), np.int64))
            total = sums[key][2]
            for at in range(len(left)):
                apart = p[:, at : at + 1] - q
                total[at] += (apart * apart // q).sum(0)
            if r["i"] == r["j"]:
                whole = shares(np.array([sum(c.values()) for _, c in leaves], np.int64), r["n"], v)
                terms = [t for t, _ in leaves]
                for at, source in enumerate(left):
                    over = np.flatnonzero((counts[:, at] > 0) & (p[:, at] > whole))
                    if len(over):
                        apart = p[over, at] - whole[over]
                        best.setdefault((lang, source), _Best()).take(apart * apart // whole[over], [terms[i] for i in over])
    yield from given()


def _parts(rows: list[tuple[str, str, str, str, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64() if i == 4 else pa.string()) for i, x in enumerate(zip(*rows))], ["lang", "source", "part", "item", "value"])


def divergence_report(docs: DataFrame, least: int = LEAST_DOCUMENTS, tile: int = TILE) -> DataFrame:
    """The contract's columns: for each source of a language, every other one and its CANDIDATES most typical terms, ranked."""
    spark = docs.sparkSession
    folder = scratch(spark, "divergence")
    docs = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")))
    with tidy_shuffles(spark):
        blocks = kept_terms(docs, folder, least)
        sums = blocks.select("lang", F.explode("sources").alias("s")).groupBy("lang", "s.source").agg(F.sum("s.n").alias("n"))
        groups = docs.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").fillna(0, ["n"])
        groups = saved(groups, f"{folder}/groups")
        langs = groups.groupBy("lang").agg(F.sum("n").alias("n"), F.count("*").alias("sources"))
        langs = saved(langs.join(blocks.groupBy("lang").agg(F.sum("leaves").alias("v")), "lang", "left").fillna(0, ["v"]), f"{folder}/langs")
        dealt = groups.withColumnRenamed("n", "of").join(broadcast_if_small(langs), "lang")
        dealt = dealt.withColumn("tile", F.pmod(F.xxhash64("source"), F.ceil(F.col("sources") / tile)))
        tiles = dealt.groupBy("lang", "tile", "v", "n").agg(F.array_sort(F.collect_list(F.struct("source", F.col("of").alias("n")))).alias("held"))
        tiles = saved(tiles, f"{folder}/tiles")
        right = tiles.select("lang", F.col("tile").alias("j"), F.col("held").alias("right"))
        pairs = saved(tiles.withColumnsRenamed({"tile": "i", "held": "left"}).where("v > 0").join(right, "lang"), f"{folder}/pairs")
        met = blocks.select("lang", "block").join(broadcast_if_small(pairs, SENT_TILES), "lang")
        parts = saved(met.mapInArrow(_compare, PARTS), f"{folder}/parts")
    names = groups.join(broadcast_if_small(langs.where("v = 0").select("lang")), "lang").select("lang", "source")
    none = names.join(names.withColumnRenamed("source", "item"), "lang").where("source <> item").selectExpr("lang", "source", "'pair' AS part", "item", "0L AS value")
    added = parts.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    best = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    ranked = lambda rows: rows.withColumn("rank", best)
    pair = ranked(added.union(none))
    term = ranked(parts.where("part = 'term'")).where(F.col("rank") <= CANDIDATES)
    return pair.union(term).select("lang", "source", "part", "item", "value", "rank")
