"""Byte-level BPE: encoding with a segment tree over pair ranks, decoding, and token counts.

A vocabulary file in the tokenizers library's JSON format gives the tokens and merges. Texts are first cut
at added tokens and then by the byte-level pattern into pre-tokens; each pre-token is merged on its own.
Merging keeps a segment tree whose leaves are the ranks of adjacent pairs: its root is the leftmost pair of
lowest rank, and each merge changes three leaves, so a pre-token of n bytes takes O(n log n) steps. A node
has 16 children, so a tree over a usual word is its root alone.

Defined cases: a null text is encoded as the empty text (no ids, the digest of nothing). Special strings
inside a text become their added token, as in the library. Rows with null or repeated ids are kept as they are.
"""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
#: Pre-tokens kept per Python worker with their ids, and characters of one; beyond the first the cache starts anew, and
#: longer ones, which hardly come again, aren't kept.
CACHE_ENTRIES, CACHED = 250_000, 64
#: Texts encoded at once by encode_rows.
SLICE = 256
#: Children of a node of the segment tree.
FAN = 16

# Fixed value: the byte-level pre-token pattern of this vocabulary family.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a vocabulary file.

    Printable Latin-1 characters stand for themselves; the others follow from U+0100 in order.
    """
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """Tokens, merges and added tokens of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec["normalizer"]:
            raise ValueError(f"{path} isn't a plain byte-level BPE vocabulary")
        letters = byte_letters()
        as_bytes = lambda token: bytes(letters[c] for c in token)
        self.tokens = {as_bytes(t): i for t, i in model["vocab"].items()}
        self.pieces = {i: t for t, i in self.tokens.items()}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pieces |= {i: t.encode() for t, i in self.added.items()}
        self.byte_ids = [self.tokens[bytes([b])] for b in range(256)]
        self.width = max(self.pieces) + 1
        self.ranks: dict[int, int] = {}
        self.merged: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            left, right = (as_bytes(x) for x in (pair.split(" ") if isinstance(pair, str) else pair))
            self.ranks[self.tokens[left] * self.width + self.tokens[right]] = rank
            self.merged.append(self.tokens[left + right])
        self.cut = regex.compile(PATTERN)
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None

    def merge(self, piece: bytes) -> list[int]:
        """Token ids of one pre-token."""
        ids = [self.byte_ids[b] for b in piece]
        return self._in_node(ids) if len(ids) <= FAN + 1 else self._in_tree(ids)

    def _in_node(self, ids: list[int]) -> list[int]:
        """Merges of few enough ids for the tree to be its root alone; merged places are dropped from it."""
        width, get, none = self.width, self.ranks.get, len(self.merged)
        leaves = [get(a * width + b, none) for a, b in zip(ids, ids[1:])]
        while leaves and (r := min(leaves)) < none:
            i = leaves.index(r)
            ids[i] = new = self.merged[r]
            del ids[i + 1], leaves[i]
            if i:
                leaves[i - 1] = get(ids[i - 1] * width + new, none)
            if i < len(leaves):
                leaves[i] = get(new * width + ids[i + 1], none)
        return ids

    def _in_tree(self, ids: list[int]) -> list[int]:
        width, get, none, n = self.width, self.ranks.get, len(self.merged), len(ids)
        levels = [[get(a * width + b, none) for a, b in zip(ids, ids[1:])]]
        while len(below := levels[-1]) > FAN:
            levels.append([min(below[i : i + FAN]) for i in range(0, len(below), FAN)])
        after, before = list(range(1, n + 1)), list(range(-1, n))

        def put(place: int, rank: int) -> None:
            for level, above in zip(levels, [*levels[1:], None]):
                level[place] = rank
                if above is None:
                    return
                place //= FAN
                rank = min(level[place * FAN : place * FAN + FAN])
                if above[place] == rank:
                    return

        while (r := min(levels[-1])) < none:
            i = levels[-1].index(r)
            for level in levels[-2::-1]:  # down to the leftmost leaf of that rank
                i = level.index(r, i * FAN)
            j = after[i]
            k, h = after[j], before[i]
            ids[i], ids[j], after[i] = self.merged[r], -1, k
            if j < n - 1:
                put(j, none)
            if k < n:
                before[k] = i
            put(i, get(ids[i] * width + ids[k], none) if k < n else none)
            if h >= 0:
                put(h, get(ids[h] * width + ids[i], none))
        return [x for x in ids if x >= 0]

    def whole_tokens(self) -> frozenset[str]:
        """Vocabulary strings that alone are one pre-token and merge to one token, proved one by one."""
        proved = []
        for token, i in self.tokens.items():
            try:
                text = token.decode()
            except UnicodeDecodeError:
                continue  # part of a character: never a whole pre-token
            if self.cut.fullmatch(text) and self.cut.findall(text) == [text] and self.merge(token) == [i]:
                proved.append(text)
        return frozenset(proved)

    def parts(self, text: str) -> list[str]:
        """text cut at added tokens; every second part is one."""
        return self.special.split(text) if self.special else [text]


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class _Packed(dict):
    """Pre-token to its ids, as little-endian unsigned 32-bit integers."""

    def __init__(self, voc: Vocabulary):
        self.voc = voc

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        ids = self.voc.merge(piece.encode())
        found = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= CACHED:
            self[piece] = found
        return found


class _Counted(dict):
    """Pre-token to its number of tokens; whole tokens are there from the start."""

    def __init__(self, voc: Vocabulary, whole: frozenset[str]):
        self.voc, self.whole = voc, whole
        self.update(dict.fromkeys(whole, 1))

    def __missing__(self, piece: str) -> int:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
            self.update(dict.fromkeys(self.whole, 1))
        found = len(self.voc.merge(piece.encode()))
        if len(piece) <= CACHED:
            self[piece] = found
        return found


@lru_cache(maxsize=4)
def _packer(path: str) -> _Packed:
    return _Packed(vocabulary(path))


@lru_cache(maxsize=4)
def _piece_table(path: str) -> dict[int, bytes]:
    return vocabulary(path).pieces


def encode_text(text: str, path: str = VOCABULARY) -> bytes:
    """Ids of a whole text as little-endian unsigned 32-bit integers."""
    packed = _packer(path)
    voc = packed.voc
    out = []
    for i, part in enumerate(voc.parts(text)):
        if i % 2:
            out.append(struct.pack("<I", voc.added[part]))
        else:
            out += map(packed.__getitem__, voc.cut.findall(part))
    return b"".join(out)


def decode_ids(packed: bytes, path: str = VOCABULARY) -> str:
    """The text of ids; bytes that aren't UTF-8 become U+FFFD."""
    ids = np.frombuffer(packed, "<u4").tolist()
    return b"".join(map(_piece_table(path).__getitem__, ids)).decode("utf-8", errors="replace")


def encode_column(text: Column, path: str = VOCABULARY) -> Column:
    """array<int> of the ids of each text."""

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        return pd.Series([np.frombuffer(encode_text(t or "", path), "<u4").astype(np.int32) for t in texts])

    return ids(text)


def decode_column(ids: Column, path: str = VOCABULARY) -> Column:
    """The text of each array of ids; null stays null."""

    @F.pandas_udf("string")
    def texts(arrays: pd.Series) -> pd.Series:
        return pd.Series([None if a is None else decode_ids(np.asarray(a, dtype="<u4").tobytes(), path) for a in arrays])

    return texts(ids)


def encode_rows(docs: DataFrame, *keep: str, path: str = VOCABULARY) -> DataFrame:
    """The columns keep, ids (array of int), n_tokens, and round_trip: whether decoding ids gives the text again.

    Rows go through in slices, so a task holds the ids of few texts at a time.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                texts = [t or "" for t in batch.column("text").to_pylist()]
                packed = [encode_text(t, path) for t in texts]
                n = np.array([len(p) // 4 for p in packed], np.int64)
                ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), "<u4").astype(np.int32)))
                same = pa.array([decode_ids(p, path) == t for p, t in zip(packed, texts)])
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), ids, pa.array(n), same], [*keep, "ids", "n_tokens", "round_trip"])

    kept = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]
    return docs.select(*keep, "text").mapInArrow(rows, ", ".join([*kept, "ids array<int>", "n_tokens long", "round_trip boolean"]))


def encoding_report(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """The contract's columns: each whole text is encoded, and its ids are decoded again."""

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digest(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            packed = encode_text(text or "", path)
            back = decode_ids(packed, path)
            rows.append((len(packed) // 4, hashlib.sha256(packed).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
        return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", digest("text").alias("d")).select("doc_id", "d.*")


def count_column(spark, text: Column, path: str = VOCABULARY) -> Column:
    """Number of tokens of each whole text, by the whole-token shortcut.

    The set of whole tokens is proved here, once, and broadcast; its size is that of the vocabulary.
    """
    whole = spark.sparkContext.broadcast(vocabulary(path).whole_tokens())

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        counted = _counter(path, whole)
        voc = counted.voc
        rows = []
        for text in texts:
            parts = voc.parts(text or "")
            rows.append(len(parts) // 2 + sum(sum(map(counted.__getitem__, voc.cut.findall(p))) for p in parts[::2]))
        return pd.Series(rows, dtype="int64")

    return count(text)


_COUNTERS: dict[str, _Counted] = {}


def _counter(path: str, whole) -> _Counted:
    if path not in _COUNTERS:
        _COUNTERS[path] = _Counted(vocabulary(path), whole.value)
    return _COUNTERS[path]


def count_report(docs: DataFrame, path: str = VOCABULARY, limit: int = 1024) -> DataFrame:
    """The contract's columns: bytes, tokens, and whether there are more than limit tokens."""
    text = F.coalesce("text", F.lit(""))
    counted = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), count_column(docs.sparkSession, text, path).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
