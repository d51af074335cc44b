"""Token-id files: each document's ids are a frame of their own, compressed with one shared zstandard dictionary.

The dictionary is trained on the serialized id arrays of at most SAMPLE short documents (those of SHORT bytes or fewer,
taken by a hash); it bears on the files' size only. Documents are encoded, serialized and compressed where they are
read, so what is shuffled are frames. They are dealt by range of doc_id (quantiles of all ids), sorted, and written by
a Spark data source (`token_frames`), one shard file a task:

    magic, id width, SHA-256 of the dictionary | frames | index: doc_id, whether it is null, n_tokens, end of frame | footer

A shard's name holds its task attempt, and only shards whose task has been committed are listed in the manifest, so an
executor lost half-way leaves nothing that is read. The manifest also has each shard's first and last id and how many
ids all earlier shards hold. Reading (`spark.read.format("token_frames")`) goes by shard; `fetch` gets single documents
by halving the manifest and a shard's index, and reads their frames by range. Both refuse a dictionary of another hash.

Ids are those of the tokenizers library; tiktoken with the same vocabulary gives them in about a quarter of the time,
and texts above LONG characters go through this package's own merge tree.

Defined cases: a null or empty text is the end id alone. Documents are in the order of doc_id, null ids first; those of
one id by number of ids, then by frame; equal rows are equal documents, each written. An empty table is a manifest
without shards.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
import struct
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from loomwork.llm.bpe import VOCABULARY, encode_text, vocabulary
from loomwork.session import scratch, tidy_shuffles

FORMAT = "token_frames"
MAGIC, FOOT = b"LWTOKEN1", struct.Struct("<QQI8s")
HEAD = struct.Struct("<8sI32s")
END_ID, DICTIONARY = 0, "dictionary.zdict"
#: Documents of the dictionary's sample, bytes of the longest one; bytes of the dictionary.
SAMPLE, SHORT, DICTIONARY_BYTES = 2_000, 8_192, 65_536
#: Characters beyond which a text isn't given to tiktoken; rows taken, and bytes of frames read, at once.
LONG, SLICE, READ = 1 << 20, 256, 4 << 20
FRAMES = "shard int, doc_id long, n_tokens long, frame binary"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=4)
def _encoding(path: str, ranks: str) -> tiktoken.Encoding:
    """tiktoken's encoder of the same tokens as the vocabulary file's, merges in the same order."""
    voc = vocabulary(path)
    with open(ranks, "rb") as f:
        order = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    if any(voc.tokens.get(token) != i for token, i in order.items()):
        raise ValueError(f"{ranks} isn't the vocabulary of {path}")
    return tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=order, special_tokens=voc.added)


def ids_of(text: str, path: str = VOCABULARY, ranks: str = RANKS) -> np.ndarray:
    """Ids of a whole text, special strings inside it as their added token."""
    if len(text) > LONG:
        return np.frombuffer(encode_text(text, path), "<u4")
    return _encoding(path, ranks).encode_to_numpy(text, allowed_special="all")


def width_of(path: str) -> int:
    """Bytes of a serialized id."""
    return 2 if vocabulary(path).width <= 1 << 16 else 4


def serialized(ids: np.ndarray, width: int) -> bytes:
    return ids.astype(f"<u{width}").tobytes()


def place(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


def read_bytes(path: str) -> bytes:
    store, at = place(path)
    with store.open_input_file(at) as f:
        return f.read()


def write_bytes(path: str, data: bytes) -> None:
    """Written beside and then renamed, so a reader sees all of it or nothing."""
    store, at = place(path)
    store.create_dir(os.path.dirname(at), recursive=True)
    with store.open_output_stream(f"{at}.new") as f:
        f.write(data)
    store.move(f"{at}.new", at)


def dictionary_of(path: str, digest: str) -> zstandard.ZstdCompressionDict:
    data = read_bytes(path)
    if hashlib.sha256(data).hexdigest() != digest:
        raise ValueError(f"{path} isn't the dictionary {digest}")
    kind = zstandard.DICT_TYPE_FULLDICT if data[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
    return zstandard.ZstdCompressionDict(data, dict_type=kind)


def train(samples: Sequence[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary from serialized id arrays; where they are too few to train on, their own bytes."""
    try:
        return zstandard.train_dictionary(size, list(samples)).as_bytes()
    except zstandard.ZstdError:
        return (b"".join(samples) or bytes(8))[-size:].ljust(8, b"\0")


def train_dictionary(docs: DataFrame, path: str = VOCABULARY, sample: int = SAMPLE) -> bytes:
    """Trained in one task, on the short documents of smallest hash; a threshold keeps what moves to it in proportion to sample."""
    short = docs.where(F.octet_length("text") <= SHORT).select("text", F.abs(F.xxhash64("doc_id", "text") / 2.0**63).alias("h"))
    share = min(1.0, 4 * sample / max(1, short.count()))
    chosen = short.where(F.col("h") <= share).orderBy("h", "text").limit(sample).coalesce(1)
    width = width_of(path)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        samples = [serialized(np.append(ids_of(t, path), END_ID), width) for b in batches for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([train(samples)], pa.binary())], ["dictionary"])

    rows = chosen.select("text").mapInArrow(fit, "dictionary binary").collect()  # one row of DICTIONARY_BYTES
    return bytes(rows[0].dictionary) if rows else train([])


def shard_bounds(docs: DataFrame, shards: int) -> list[int]:
    """Ids that cut all documents into about equal shards; only ids are read for it."""
    at = [i / shards for i in range(1, shards)]
    found = docs.select(F.percentile_approx(F.col("doc_id").cast("long"), at or [0.5], 10 * max(1_000, shards))).first()[0]
    return sorted(set(found or [])) if at else []


def frames(docs: DataFrame, bounds: list[int], dictionary: str, digest: str, path: str = VOCABULARY) -> DataFrame:
    """(shard, doc_id, n_tokens, frame) of every document: its ids and the end id, compressed on their own."""
    width = width_of(path)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3, dict_data=dictionary_of(dictionary, digest), write_checksum=True).compress
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                n, packed = [], []
                for text in batch.column("text").to_pylist():
                    ids = np.append(ids_of(text or "", path), END_ID)
                    n.append(len(ids))
                    packed.append(pack(serialized(ids, width)))
                shard = [0 if i is None else bisect_left(bounds, i) for i in batch.column("doc_id").to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(packed, pa.binary())], ["shard", "doc_id", "n_tokens", "frame"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(rows, FRAMES)


@dataclass
class Shard(WriterCommitMessage, InputPartition):
    """A committed shard; start counts the ids of all documents before it."""

    file: str
    documents: int
    tokens: int
    first: int | None
    last: int | None
    start: int = 0


def manifest(folder: str) -> list[Shard]:
    return [Shard(**x) for x in json.loads(read_bytes(f"{folder}/manifest.json"))]


@dataclass
class Settings:
    """What the files of a folder have in common; id width in bytes."""

    digest: str
    width: int


def settings(folder: str) -> Settings:
    return Settings(**json.loads(read_bytes(f"{folder}/settings.json")))


def _unpacker(folder: str, held: Settings):
    return zstandard.ZstdDecompressor(dict_data=dictionary_of(f"{folder}/{DICTIONARY}", held.digest)).decompress


class ShardWriter(DataSourceArrowWriter):
    def __init__(self, folder: str, digest: str, width: int):
        self.folder, self.digest, self.width = folder, digest, width

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Shard:
        task = TaskContext.get()
        name = f"shard-{task.partitionId():06d}-{task.taskAttemptId()}.bin"
        store, at = place(f"{self.folder}/{name}")
        store.create_dir(os.path.dirname(at), recursive=True)
        ids, absent, counts, ends, end = [], [], [], [], HEAD.size
        with store.open_output_stream(at) as f:
            f.write(HEAD.pack(MAGIC, self.width, bytes.fromhex(self.digest)))
            for batch in iterator:
                held = batch.column("doc_id")
                ids.append(held.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"))
                absent.append(np.asarray(held.is_null().to_numpy(zero_copy_only=False), "u1"))
                counts.append(batch.column("n_tokens").to_numpy().astype("<u8"))
                for frame in batch.column("frame"):
                    data = frame.as_buffer()
                    f.write(data)
                    end += data.size
                    ends.append(end)
            columns = [np.concatenate(x) if x else np.zeros(0, kind) for x, kind in ((ids, "<i8"), (absent, "u1"), (counts, "<u8"))]
            index = b"".join(x.tobytes() for x in (*columns, np.array(ends, "<u8")))
            f.write(index)
            f.write(FOOT.pack(end, len(ends), zlib.crc32(index), MAGIC))
        known = columns[0][columns[1] == 0]
        return Shard(name, len(ends), int(columns[2].sum()), int(known[0]) if len(known) else None, int(known[-1]) if len(known) else None)

    def commit(self, messages: list) -> None:
        start, shards = 0, [m for m in messages if m is not None and m.documents]
        for shard in shards:
            shard.start, start = start, start + shard.tokens
        write_bytes(f"{self.folder}/settings.json", json.dumps(asdict(Settings(self.digest, self.width))).encode())
        write_bytes(f"{self.folder}/manifest.json", json.dumps([asdict(x) for x in shards]).encode())
        self._clean({x.file for x in shards})

    def abort(self, messages: list) -> None:
        self._clean(set())

    def _clean(self, keep: set[str]) -> None:
        """Deletes shards of attempts that don't count."""
        store, at = place(self.folder)
        for x in store.get_file_info(fs.FileSelector(at, allow_not_found=True)):
            if x.base_name.startswith("shard-") and x.base_name not in keep:
                store.delete_file(x.path)


@dataclass
class Index:
    """Of a shard: documents in order, and where their frames are."""

    ids: np.ndarray
    absent: np.ndarray
    counts: np.ndarray
    ends: np.ndarray

    def begin(self, i: int) -> int:
        return int(self.ends[i - 1]) if i else HEAD.size

    def of(self, doc_id: int) -> range:
        """Where a document is, by halving; null ids come before all."""
        nulls = int(self.absent.sum())
        return range(nulls + bisect_left(self.ids[nulls:], doc_id), nulls + bisect_right(self.ids[nulls:], doc_id))


def read_index(f: pa.NativeFile, digest: str, name: str) -> Index:
    magic, _, held = HEAD.unpack(f.read(HEAD.size))
    f.seek(f.size() - FOOT.size)
    at, n, crc, foot = FOOT.unpack(f.read(FOOT.size))
    f.seek(at)
    data = f.read(n * 25)
    if magic != MAGIC or foot != MAGIC or zlib.crc32(data) != crc or held.hex() != digest:
        raise ValueError(f"{name} isn't a whole shard of dictionary {digest}")
    return Index(np.frombuffer(data, "<i8", n), np.frombuffer(data, "u1", n, 8 * n), np.frombuffer(data, "<u8", n, 9 * n), np.frombuffer(data, "<u8", n, 17 * n))


class ShardReader(DataSourceReader):
    def __init__(self, folder: str, digests: bool):
        self.folder, self.digests = folder, digests

    def partitions(self) -> Sequence[InputPartition]:
        return manifest(self.folder) or [Shard("", 0, 0, None, None)]

    def read(self, shard: Shard) -> Iterator[pa.RecordBatch]:
        if not shard.documents:
            return
        held = settings(self.folder)
        unpack = _unpacker(self.folder, held)
        store, at = place(f"{self.folder}/{shard.file}")
        with store.open_input_file(at) as f:
            index = read_index(f, held.digest, shard.file)
            starts = shard.start + np.concatenate([[0], np.cumsum(index.counts)]).astype(np.int64)
            i = 0
            while i < shard.documents:  # a run of frames of about READ bytes
                j = max(i + 1, min(i + SLICE, bisect_right(index.ends, index.begin(i) + READ)))
                f.seek(index.begin(i))
                data, base = memoryview(f.read(int(index.ends[j - 1]) - index.begin(i))), index.begin(i)
                found = [np.frombuffer(unpack(data[index.begin(k) - base : int(index.ends[k]) - base]), f"<u{held.width}").astype("<u4") for k in range(i, j)]
                n = np.array([len(x) for x in found], np.int64)
                if (n != index.counts[i:j].astype(np.int64)).any():
                    raise ValueError(f"{shard.file} has frames of other lengths than its index")
                columns = [pa.array(index.ids[i:j], mask=index.absent[i:j] > 0), pa.array(starts[i:j]), pa.array(n)]
                if self.digests:
                    columns.append(pa.array([zlib.crc32(x) for x in found], pa.int64()))
                else:
                    ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found).astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32" if self.digests else "ids"])
                i = j


class TokenFrames(DataSource):
    """format("token_frames"): writes the rows of frames(), reads documents (doc_id, start, n_tokens, ids).

    Options: path; for writing digest and width of the dictionary, which is in the folder already; for reading content,
    "ids" or "digest" (CRC-32 of the ids as little-endian unsigned 32-bit integers, in place of them).
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def _digests(self) -> bool:
        return self.options.get("content", "ids") == "digest"

    def schema(self) -> str:
        return "doc_id long, start long, n_tokens long, " + ("ids_crc32 long" if self._digests() else "ids array<int>")

    def reader(self, schema) -> ShardReader:
        return ShardReader(self.options["path"], self._digests())

    def writer(self, schema, overwrite: bool) -> ShardWriter:
        return ShardWriter(self.options["path"], self.options["digest"], int(self.options["width"]))


def write_tokens(docs: DataFrame, folder: str, path: str = VOCABULARY) -> None:
    """All documents(doc_id, text) as token-id files in folder, in ascending doc_id."""
    spark = docs.sparkSession
    spark.dataSource.register(TokenFrames)
    data = train_dictionary(docs, path)
    digest, name = hashlib.sha256(data).hexdigest(), f"{folder}/{DICTIONARY}"
    write_bytes(name, data)
    with tidy_shuffles(spark):
        bounds = shard_bounds(docs, int(spark.conf.get("spark.sql.shuffle.partitions")))
        packed = frames(docs, bounds, name, digest, path)
        ordered = packed.repartitionById(len(bounds) + 1, F.col("shard")).drop("shard").sortWithinPartitions(F.asc_nulls_first("doc_id"), "n_tokens", "frame")
        ordered.write.format(FORMAT).mode("append").option("digest", digest).option("width", width_of(path)).save(folder)


def read_tokens(spark: SparkSession, folder: str, *, digests: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of the files in folder, or ids_crc32 in place of ids."""
    spark.dataSource.register(TokenFrames)
    return spark.read.format(FORMAT).option("content", "digest" if digests else "ids").load(folder)


def fetch(wanted: DataFrame, folder: str) -> DataFrame:
    """(doc_id, ids) of the wanted(doc_id) that are in the files: each shard's index is read once, and frames by range."""

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [s for s in manifest(folder) if s.first is not None]
        firsts, lasts = [s.first for s in held], [s.last for s in held]
        for batch in batches:
            rows = [(held[k].file, i) for i in batch.column("doc_id").to_pylist() for k in range(bisect_left(lasts, i), bisect_right(firsts, i))]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], ["file", "doc_id"])

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = settings(folder)
        unpack = _unpacker(folder, held)
        open_file, f, index = None, None, None
        for batch in batches:
            for name, doc_id in zip(batch.column("file").to_pylist(), batch.column("doc_id").to_pylist()):
                if name != open_file:
                    if f is not None:
                        f.close()
                    store, at = place(f"{folder}/{name}")
                    f, open_file = store.open_input_file(at), name
                    index = read_index(f, held.digest, name)
                for i in index.of(doc_id):
                    f.seek(index.begin(i))
                    ids = np.frombuffer(unpack(f.read(int(index.ends[i]) - index.begin(i))), f"<u{held.width}").astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array([doc_id], pa.int64()), pa.array([ids], pa.list_(pa.int32()))], ["doc_id", "ids"])
        if f is not None:
            f.close()

    asked = wanted.where("doc_id is not null").select(F.col("doc_id").cast("long")).distinct().mapInArrow(shards, "file string, doc_id long")
    return asked.repartition("file").sortWithinPartitions("file", "doc_id").mapInArrow(documents, "doc_id long, ids array<int>")


def token_file_report(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """The contract's columns, from files that were written and read back."""
    folder = f"{scratch(docs.sparkSession, 'tokens')}/files"
    write_tokens(docs, folder, path)
    return read_tokens(docs.sparkSession, folder, digests=True)
