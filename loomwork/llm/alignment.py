"""Cross-tokenizer alignment: which tokens of a byte-level and of a piece vocabulary cover the same bytes of a text.

Both tokenizers give the ends of their tokens as events. An event row is a run of a document's events of one side that
end within the same WINDOW bytes: the run's start and its ids (ends follow from the ids' lengths). The rows of both
sides are one union, dealt by document and sorted by offset within partitions. A state machine streams them: its state
is the group that is open, that is, the tokens since the last offset where both sides ended. Each offset where a token
ends closes one stretch, and each stretch is one link: the A and the B token that cover it.

A document's row holds its counts, the digest of its groups, and its distinct id pairs, compressed. Corpus-wide counts
of pairs are added up from these rows, and go back to them: to every task while there are at most SENT pairs (counted),
else by a join of single pairs.

Defined cases: texts that are null or empty, or that a side's tokens don't spell byte for byte, have no tokens: zeros and
the empty string. Rows that repeat a doc_id have a row each; rows equal in id and text travel once with their number,
and each counts for the pairs. Ids may be null. Texts of more than LONG characters are encoded in parts, cut where no token
can cross. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.bpe import VOCABULARY, vocabulary
from loomwork.llm.tokenfile import RANKS, _encoding
from loomwork.session import saved, scratch, tidy_shuffles

PIECES = public_tokenizers.path("piece_bpe_32k.model")
#: Bytes that the events of a row end within; characters beyond which a text is encoded in parts; rows taken at once.
WINDOW, LONG, SLICE = 1 << 16, 1 << 20, 256
#: Id pairs that are sent to every task, at most; pairs that a task holds while it adds them up.
SENT, HELD = 2_000_000, 1_000_000
EVENTS = "doc_id long, digest binary, block int, side int, copies long, start long, ids binary"
SWEPT = "doc_id long, digest binary, copies long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary"
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


class ByteSide:
    """The tokens of a byte-level vocabulary; special strings in a text are plain text."""

    def __init__(self, path: str):
        self.path, voc = path, vocabulary(path)
        self.spelt = [voc.pieces.get(i, b"") for i in range(voc.width)]
        self.lengths = np.array([len(x) for x in self.spelt], np.int64)

    def ids(self, text: str) -> np.ndarray:
        """Of a space and the text; joined they always spell it, as every byte is a token."""
        if len(text) <= LONG:
            return _encoding(self.path, RANKS).encode_to_numpy(" " + text, disallowed_special=()).astype(np.int64)
        voc = vocabulary(self.path)
        return np.array([i for piece in voc.cut.finditer(" " + text) for i in voc.merge(piece[0].encode())], np.int64)


class PieceSide:
    """The tokens of a piece vocabulary, which puts a space before a text."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.spelt = [bytes([int(x[3:5], 16)]) if self.model.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(names)]
        self.lengths = np.array([len(x) for x in self.spelt], np.int64)
        #: Whether a text may be cut before a space that follows another character: no piece has a space after one.
        self.parts = not any(re.search("[^▁]▁", x) for x in names)

    def ids(self, text: str) -> np.ndarray:
        if len(text) <= LONG or not self.parts:
            return np.array(self.model.encode(text), np.int64)
        found, at = [], 0
        while at <= len(text):
            cut = re.compile(r"[^ ] (?=[\s\S])").search(text, at + LONG - 1)
            end = cut.start() + 1 if cut else len(text)
            found.append(np.array(self.model.encode(text[at:end]), np.int64))
            at = end + 1  # the space there is the one that the model puts before a text
        return np.concatenate(found)


@lru_cache(maxsize=2)
def sides(a: str, b: str) -> tuple[ByteSide, PieceSide]:
    return ByteSide(a), PieceSide(b)


def id_kind(a: str, b: str) -> str:
    """How ids travel: as 16-bit numbers where both vocabularies allow it."""
    return "<u2" if max(len(side.lengths) for side in sides(a, b)) <= 1 << 16 else "<u4"


def _runs(ids: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(block, start, ids) of the tokens that end within each WINDOW bytes."""
    ends = np.cumsum(lengths[ids])
    blocks = (ends - 1) // WINDOW
    cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(ids)]
    for i, j in zip(cuts, cuts[1:]):
        yield int(blocks[i]), int(ends[i - 1]) if i else 0, ids[i:j]


def events(docs: DataFrame, a: str = VOCABULARY, b: str = PIECES) -> DataFrame:
    """The end events of both sides, as EVENTS; documents without tokens have one row of block -1."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, kind = sides(a, b), id_kind(a, b)
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                copies: dict[tuple[int | None, str | None], int] = {}
                for key in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                    copies[key] = copies.get(key, 0) + 1
                found = []
                for (doc_id, text), n in copies.items():
                    whole_text = (" " + (text or "")).encode()
                    digest = hashlib.blake2b(whole_text, digest_size=16, person=b"" if text is None else b"text").digest()
                    ids = [side.ids(text) if text else np.zeros(0, np.int64) for side in both]
                    if text and b"".join(map(both[1].spelt.__getitem__, ids[1].tolist())) == whole_text:
                        found += [(doc_id, digest, block, k, n, start, run.astype(kind).tobytes()) for k, (side, x) in enumerate(zip(both, ids)) for block, start, run in _runs(x, side.lengths)]
                    else:
                        found.append((doc_id, digest, -1, 0, n, 0, b""))
                yield _batch(found, EVENTS)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(rows, EVENTS)


_ARROW = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    columns = zip(*rows) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[kind]) for c, (_, kind) in zip(columns, fields)], [n for n, _ in fields])


@lru_cache(maxsize=2)
def _numbers(width: int) -> list[str]:
    """Each id in decimal after a comma, a bar or a semicolon, at three times the id."""
    return [mark + str(i) for i in range(width) for mark in ",|;"]


def inside(ends: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Which ends are among the others; all of one window or of one open group, so a table of their range is small."""
    return np.isin(ends, others, assume_unique=True, kind="table") if len(ends) and len(others) else np.zeros(len(ends), bool)


def last_common(a: np.ndarray, b: np.ndarray) -> int | None:
    """The last end that both have; None if there is none."""
    if not len(a) or not len(b):
        return None
    if a[-1] == b[-1]:  # so at the end of a text
        return int(a[-1])
    common = a[inside(a, b)]
    return int(common[-1]) if len(common) else None


class Sweep:
    """The state of one document: counts so far, and the group that is open."""

    def __init__(self, spelt: Callable[[int], str]):
        self.spelt = spelt
        self.open: tuple[list, list] = ([], [])  # of (ids, ends) for each side
        self.n = [0, 0]
        self.groups = self.links = 0
        self.sha = hashlib.sha256()
        self.pairs, self.times = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.held: list[np.ndarray] = []

    def take(self, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> None:
        """The tokens (ids, ends) of both sides that end within the next window; the last common end closes groups."""
        last = last_common(a[1], b[1])
        closed = []
        for k, (ids, ends) in enumerate((a, b)):
            self.n[k] += len(ids)
            cut = 0 if last is None else int(np.searchsorted(ends, last, "right"))
            if last is not None:
                parts = [*self.open[k], (ids[:cut], ends[:cut])]
                closed.append(tuple(np.concatenate(x) for x in zip(*parts)) if len(parts) > 1 else parts[0])
                self.open[k].clear()
            if cut < len(ids):
                self.open[k].append((ids[cut:], ends[cut:]))
        if not closed:
            return
        (a_ids, a_ends), (b_ids, b_ends) = closed
        base = min(a_ends[0], b_ends[0])
        table = np.zeros(last - base + 1, np.uint8)  # which sides end at each byte: 1 for A, 2 for B
        table[a_ends - base] = 1
        table[b_ends - base] |= 2
        kinds = table[np.flatnonzero(table)]  # of each offset where a token ends, in order
        of_a, of_b, common = kinds != 2, kinds != 1, kinds == 3
        so_far = [np.cumsum(x) for x in (of_a, of_b)]  # tokens that ended, this offset included
        groups = np.cumsum(common)
        n_groups = int(groups[-1])
        groups -= common  # common ends before an offset's own
        group = [groups[of_a], groups[of_b]]
        through = [x[common] for x in so_far]  # tokens of a group and of those before it
        before_b = np.concatenate([[0], through[1][:-1]])
        # In text, the A tokens of a group stand after the B tokens of the groups before it, its B tokens after its A tokens.
        a_place = np.arange(len(a_ids)) + before_b[group[0]]
        b_place = np.arange(len(b_ids)) + through[0][group[1]]
        first = [np.ones(len(g), np.int64) for g in group]
        for f, g in zip(first, group):
            f[1:] = g[1:] != g[:-1]
        marked = np.empty(len(a_ids) + len(b_ids), np.int64)
        marked[a_place] = 3 * a_ids + 2 * first[0]
        marked[b_place] = 3 * b_ids + first[1]
        text = "".join(map(self.spelt, marked.tolist()))
        self.sha.update((text if self.groups else text[1:]).encode())
        self.groups += n_groups
        self.links += len(kinds)
        self.held.append(a_ids[so_far[0] - of_a] << 32 | b_ids[so_far[1] - of_b])
        if sum(map(len, self.held)) > HELD:
            self.settle()

    def settle(self) -> None:
        if not len(self.pairs) and self.held:
            held = np.sort(np.concatenate(self.held))
            starts = np.flatnonzero(np.concatenate([[True], held[1:] != held[:-1]]))
            self.pairs, self.times, self.held = held[starts], np.diff(starts, append=len(held)), []
            return
        held = np.concatenate([self.pairs, *self.held])
        self.pairs, self.times = summed(held, np.concatenate([self.times, np.ones(len(held) - len(self.pairs), np.int64)]))
        self.held = []


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in ascending order, with the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1))
    return keys[starts], np.add.reduceat(counts[order], starts)


@lru_cache(maxsize=1)
def _compressor() -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=1)


def packed(pairs: np.ndarray, times: np.ndarray) -> bytes:
    """Ascending pairs and their counts: byte planes of A's steps, B's ids and the counts, compressed."""
    columns = np.stack([np.diff(pairs >> 32, prepend=0), pairs & 0xFFFFFFFF, times]).astype("<u4")
    return _compressor().compress(columns.view("u1").reshape(-1, 4).T.tobytes())


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), "u1").reshape(4, -1)
    a, b, times = np.ascontiguousarray(planes.T).view("<u4").reshape(3, -1).astype(np.int64)
    return np.cumsum(a) << 32 | b, times


def sweep(rows: DataFrame, a: str = VOCABULARY, b: str = PIECES) -> DataFrame:
    """EVENTS as SWEPT: one row for each document that differs in id or text."""

    def machine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = [side.lengths for side in sides(a, b)]
        spelt = _numbers(max(map(len, lengths))).__getitem__
        kind, none = id_kind(a, b), (np.zeros(0, np.int64), np.zeros(0, np.int64))
        key = state = seen = None
        copies, block, window = 0, -1, [none, none]
        done: list[tuple] = []

        def finish() -> None:
            state.take(*window)
            state.settle()
            done.append((*key, copies, *state.n, state.groups, state.links, state.sha.hexdigest() if state.groups else "", packed(state.pairs, state.times)))

        for batch in batches:
            for r in zip(*(batch.column(c.split()[0]).to_pylist() for c in EVENTS.split(", "))):
                if r[:2] != key:
                    if key is not None:
                        finish()
                    key, state, first, seen, copies, block, window = r[:2], Sweep(spelt), r[2:4], None, 0, r[2], [none, none]
                if r[2:4] == first:
                    copies += r[4]
                if r[2:4] == seen:
                    continue  # a row equal to another
                seen = r[2:4]
                if r[2] != block:
                    state.take(*window)
                    block, window = r[2], [none, none]
                ids = np.frombuffer(r[6], kind).astype(np.int64)
                window[r[3]] = (ids, r[5] + np.cumsum(lengths[r[3]][ids]))
            if done:
                yield _batch(done, SWEPT)
                done = []
        if key is not None:
            finish()
            yield _batch(done, SWEPT)

    dealt = rows.repartition("doc_id", "digest").sortWithinPartitions("doc_id", "digest", "block", "side")
    return dealt.mapInArrow(machine, SWEPT)


def pair_counts(swept: DataFrame) -> DataFrame:
    """(pair, n, best): how many links hold each id pair (A's id times 2^32 plus B's), and whether no pair of its B id has more."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, held = np.zeros(0, np.int64), np.zeros(0, np.int64), []
        for batch in batches:
            for data, copies in zip(batch.column("pairs").to_pylist(), batch.column("copies").to_pylist()):
                found, times = unpacked(data)
                held.append((found, times * copies))
                if sum(len(x) for x, _ in held) > HELD:
                    pairs, n = (np.concatenate(x) for x in zip((pairs, n), *held))
                    (pairs, n), held = summed(pairs, n), []
                    if len(pairs) > HELD:
                        yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n)], ["pair", "n"])
                        pairs, n = pairs[:0], n[:0]
        pairs, n = summed(*(np.concatenate(x) for x in zip((pairs, n), *held)))
        if len(pairs):
            yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n)], ["pair", "n"])

    counted = swept.select("pairs", "copies").mapInArrow(add_up, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counted = saved(counted.withColumn("b", F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))), f"{scratch(swept.sparkSession, 'pairs')}/counts")
    most = counted.groupBy("b").agg(F.max("n").alias("most"))
    return counted.join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _repeated(done: list[tuple], copies: list[int]) -> Iterator[pa.RecordBatch]:
    """Each row as often as its document comes, SLICE at a time."""
    out: list[tuple] = []
    for row, n in zip(done, copies):
        for at in range(0, n, SLICE):
            out += [row] * min(SLICE, n - at)
            if len(out) >= SLICE:
                yield _batch(out, RESULT)
                out = []
    if out:
        yield _batch(out, RESULT)


def _with_sent(swept: DataFrame, counts: DataFrame) -> DataFrame:
    """RESULT of every document, its pairs looked up in a sorted table that every task has."""
    held = counts.orderBy("pair").toArrow()  # SENT rows at most
    sent = swept.sparkSession.sparkContext.broadcast(tuple(held.column(c).to_numpy() for c in ("pair", "n", "best")))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, best = sent.value
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE).to_pydict()
                sums = []
                for data in batch["pairs"]:
                    pairs, times = unpacked(data)
                    at_ = np.searchsorted(known, pairs)
                    sums.append((int(times[best[at_]].sum()), int((times * n[at_]).sum())))
                done = [(i, *c, *s, g) for i, *c, s, g in zip(*(batch[x] for x in ("doc_id", "n_a", "n_b", "n_groups", "n_links")), sums, batch["groups_sha256"])]
                yield from _repeated(done, batch["copies"])

    return swept.drop("digest").mapInArrow(rows, RESULT)


def _with_joined(swept: DataFrame, counts: DataFrame) -> DataFrame:
    """The same by a join of single pairs, for any number of them; a pair that very many documents have is a skewed key
    of two plain exchanges, which adaptive execution splits."""

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, digest, data in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "digest", "pairs"))):
                pairs, times = unpacked(data)
                for i in range(0, len(pairs), 10_000):
                    n = len(pairs[i : i + 10_000])
                    yield pa.RecordBatch.from_arrays([pa.array([doc_id] * n, pa.int64()), pa.array([digest] * n, pa.binary()), pa.array(pairs[i : i + n]), pa.array(times[i : i + n])], ["doc_id", "digest", "pair", "times"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(x.split()[0]).to_pylist() for x in RESULT.split(", ")]
            yield from _repeated(list(zip(*columns)), batch.column("copies").to_pylist())

    links = swept.select("doc_id", "digest", "pairs").mapInArrow(single, "doc_id long, digest binary, pair long, times long").join(counts, "pair")
    sums = links.groupBy("doc_id", "digest").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    sums = sums.withColumnsRenamed({"doc_id": "of", "digest": "of_digest"})
    joined = swept.drop("pairs").join(sums, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("of_digest")), "left").fillna(0, ["n_best", "count_sum"])
    return joined.mapInArrow(rows, RESULT)


def alignment_report(docs: DataFrame, a: str = VOCABULARY, b: str = PIECES, sent: int = SENT) -> DataFrame:
    """The contract's columns: tokens, groups and links of every document, and how usual its links are in the corpus."""
    spark = docs.sparkSession
    folder = scratch(spark, "alignment")
    with tidy_shuffles(spark):
        swept = saved(sweep(events(docs, a, b), a, b), f"{folder}/swept")
        counts = saved(pair_counts(swept), f"{folder}/counts")
    return (_with_sent if counts.count() <= sent else _with_joined)(swept, counts)
