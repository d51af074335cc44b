"""WARC archives of pages, and a two-level capture index over them.

Archives are written by Spark's text writer: a record is one row, and the line separator is the blank line that
ends a WARC record, so the files go to any store that Spark can write. Pages with equal payloads of MIN_SHARED
bytes or more are stored once: the smallest page id is the response, others are revisits of it. Archives are read
as streams, a record at a time, so neither a large page nor a large file has to fit in a row.

The capture index has two levels. Captures are sorted by a key of reversed host and path, and packed into
compressed blocks of BLOCK_LINES lines; a sparse directory holds the first and last key and page id of each block, so a
url that has very many captures is still found in one block a capture. A lookup searches the directory in halves: its top, TOP entries at most, is sent to tasks, and if there are more blocks, each
further step joins an entry with its FAN parts. Of the blocks, those that can hold a key are read, and searched in
halves; what is found is the place (file, offset, length) of a record, which is then read as a range.

Tasks open archives with pyarrow's file systems (local or shared folders, hdfs, s3, gs, abfs), whatever the store
that pages come from.

Defined cases: a null html is the empty payload, a null url the empty one; line breaks in a url are escaped.
A page with a null id is a response unless its payload has a page with an id to revisit. Rows that repeat the
smallest id of a payload are all responses. An empty table gives no archive, an empty index and no rows.
"""

from __future__ import annotations

import hashlib
import io
import json
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.session import broadcast_if_small, saved, scratch, tidy_shuffles

MIN_SHARED, BLOCK_LINES = 100, 2_000
#: Bytes of an archive file, roughly; bytes read at once from one.
FILE_BYTES, READ = 16_000_000, 1 << 20
#: Directory entries sent to tasks, at most, and parts of an entry of a higher level.
TOP, FAN = 10_000, 128
END = "\r\n\r\n"
CAPTURE = "key string, page_id long, url string, record_type string, refers_to long, refers_key string, payload_bytes long, payload_digest string, file string, offset long, length long"


def url_key(url: str) -> str:
    """Reversed host, then path and query: com,example,www)/path?query; the scheme, port and fragment don't count."""
    try:
        parts = urlsplit(url)
        host = parts.hostname or ""
    except ValueError:
        return url.replace("\t", "%09")
    return ",".join(reversed(host.split("."))) + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def with_records(pages: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """(value) column of WARC records, each without the blank line that ends it; folder takes the shared payloads."""
    page = pages.select("page_id", F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("")), "\r", "%0D"), "\n", "%0A").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    page = page.withColumn("digest", F.sha2("html", 256)).withColumn("size", F.octet_length("html"))
    shared = page.where(F.col("size") >= MIN_SHARED).groupBy("digest").agg(F.count("*").alias("n"), F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("first"))
    shared = shared.where("n > 1 and first is not null").select(F.col("digest").alias("shared_digest"), "first")
    shared = broadcast_if_small(saved(shared, folder))
    page = page.join(shared, (F.col("digest") == F.col("shared_digest")) & (F.col("size") >= MIN_SHARED), "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first.page_id"))
    name = lambda i: F.concat(F.lit("<urn:page:"), F.coalesce(i.cast("string"), F.lit("none")), F.lit(">"))
    line = lambda key, value: F.concat(F.lit(f"{key}: "), value, F.lit("\r\n"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(END))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    refers = F.concat(
        line("WARC-Refers-To", name(F.col("first.page_id"))),
        line("WARC-Refers-To-Target-URI", F.col("first.url")),
        line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
    )
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", name(F.col("page_id"))),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-Date", F.lit(date)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(revisit, refers).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        F.lit("Content-Length: "),
    )
    return page.select(F.concat(head, F.octet_length(block).cast("string"), F.lit(END), block).alias("value"))


def write_archives(pages: DataFrame, folder: str) -> None:
    """One WARC record per page, in files under folder. Pages aren't shuffled: each task writes what it has read."""
    mean = pages.agg(F.avg(F.octet_length("html"))).first()[0] or 1
    rows = max(1, int(FILE_BYTES / (mean + 600)))
    with_records(pages, f"{folder}-shared").write.option("lineSep", END).option("maxRecordsPerFile", rows).text(folder)


def parse_records(read: Callable[[int], bytes]) -> Iterator[tuple[dict[str, str], int, int, bytes]]:
    """(headers, offset, length, payload) of each record of an archive; length is without the closing blank line.

    read(n) gives the next n bytes or fewer. What is held is one record and READ bytes.
    """
    held, at, place = b"", 0, 0  # at: the record in held, place: in the archive

    def upto(n: int) -> bool:
        nonlocal held, at
        while len(held) - at < n:
            more = read(max(READ, n - (len(held) - at)))
            if not more:
                return False
            held, at = held[at:] + more, 0
        return True

    while upto(1):
        seen = 0
        while (end := held.find(b"\r\n\r\n", at + seen)) < 0:
            seen = max(0, len(held) - at - 3)
            if not upto(len(held) - at + 1):
                raise ValueError(f"the archive breaks off in the record at {place}")
        lines = held[at:end].decode().split("\r\n")
        headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        length = end + 4 - at + int(headers["Content-Length"])
        head = end + 4 - at
        if not upto(length):
            raise ValueError(f"the archive breaks off in the record at {place}")
        block = held[at + head : at + length]
        yield headers, place, length, block[block.index(b"\r\n\r\n") + 4 :]
        upto(length + 4)
        at, place = min(len(held), at + length + 4), place + length + 4


def opened(path: str) -> pa.NativeFile:
    """An archive file, for reading in a task."""
    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file("/" + path.removeprefix("file:").lstrip("/"))
    store, place = fs.FileSystem.from_uri(path)
    return store.open_input_file(place)


def _page(name: str | None) -> int | None:
    value = (name or "").removeprefix("<urn:page:").removesuffix(">")
    return int(value) if value.lstrip("-").isdigit() else None


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """The captures in the archives: CAPTURE, with size and digest of the payload as read; a revisit has its stated digest."""

    def captures(path: str) -> Iterator[tuple]:
        with opened(path) as stream:
            for h, offset, length, payload in parse_records(stream.read):
                url, revisit = h["WARC-Target-URI"], h["WARC-Type"] == "revisit"
                stated = h["WARC-Payload-Digest"].removeprefix("sha256:")
                size, digest = (None, stated) if revisit else (len(payload), hashlib.sha256(payload).hexdigest())
                to = (_page(h["WARC-Refers-To"]), url_key(h["WARC-Refers-To-Target-URI"])) if revisit else (None, None)
                yield url_key(url), _page(h["WARC-Record-ID"]), url, h["WARC-Type"], *to, size, digest, path, offset, length

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                found = []
                for capture in captures(path):
                    found.append(capture)
                    if len(found) == BLOCK_LINES:
                        yield _batch(zip(*found))
                        found = []
                if found:
                    yield _batch(zip(*found))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    return files.select("path").mapInArrow(rows, CAPTURE)  # only names are read here


def _batch(columns) -> pa.RecordBatch:
    fields = [c.split() for c in CAPTURE.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if kind == "string" else pa.int64()) for c, (_, kind) in zip(columns, fields)], [n for n, _ in fields])


def _lines(packed: bytes) -> list[str]:
    return zlib.decompress(packed).decode().split("\n")


def _key(line: str) -> str:
    return line.split("\t", 1)[0]


def _order(key: str, page_id: int | None) -> tuple:
    """Captures sort by key and page id, null ids first."""
    return key, page_id is not None, page_id or 0


def _place(line: str) -> tuple:
    key, page_id, _ = line.split("\t", 2)
    return _order(key, int(page_id) if page_id else None)


def _captures(lines: list[str]) -> list[dict]:
    return [json.loads(x.split("\t", 2)[2]) for x in lines]


def _in_block(lines: list[str], key: str) -> list[dict]:
    """The captures of a key, found in halves."""
    return _captures(lines[bisect_left(lines, key, key=_key) : bisect_right(lines, key, key=_key)])


def _one_in_block(lines: list[str], key: str, page_id: int | None) -> list[dict]:
    """The captures of a key and page, found in halves."""
    at = _order(key, page_id)
    return _captures(lines[bisect_left(lines, at, key=_place) : bisect_right(lines, at, key=_place)])


def _can_hold(key: Column) -> Column:
    return (F.col("first_key") <= key) & (key <= F.col("last_key"))


BLOCKS = "first_key string, first_page long, last_key string, last_page long, lines long, packed binary"
_ENTRY = ("first_key", "first_page", "last_key", "last_page")


@dataclass
class CaptureIndex:
    """blocks: BLOCKS and block; block numbers follow the order of keys and page ids."""

    blocks: DataFrame
    size: int

    def directory(self) -> list[tuple[DataFrame, int]]:
        """(entries, divisor) by level, the blocks' own first; an entry of a level stands for FAN numbers of the one below."""
        levels, n, divisor = [(self.blocks.select("block", *_ENTRY), 1)], self.size, 1
        while n > TOP:
            divisor *= FAN
            ends = F.min(F.struct("first_key", "first_page")).alias("a"), F.max(F.struct("last_key", "last_page")).alias("b")  # null ids count as least
            entries = self.blocks.groupBy(F.floor(F.col("block") / divisor).alias("block")).agg(*ends).select("block", "a.*", "b.*")
            levels.append((entries, divisor))
            n = entries.count()
        return levels

    def blocks_of(self, wanted: DataFrame) -> DataFrame:
        """(block, key, page_id) of the blocks that can hold wanted(key, page_id): from the directory's top downward."""
        (top, _), *below = self.directory()[::-1]
        entries = sorted((_order(r.first_key, r.first_page), _order(r.last_key, r.last_page), r.block) for r in top.collect())  # TOP at most
        firsts, lasts = [e[0] for e in entries], [e[1] for e in entries]

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(entries[i][2], k, p) for k, p in zip(*(batch.column(c).to_pylist() for c in ("key", "page_id"))) for i in range(bisect_left(lasts, _order(k, p)), bisect_right(firsts, _order(k, p)))]
                blocks, keys, pages = zip(*rows) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(keys, pa.string()), pa.array(pages, pa.int64())], ["block", "key", "page_id"])

        asked = wanted.select("key", "page_id").distinct().mapInArrow(search, "block long, key string, page_id long")
        for level, _ in below:
            parts = level.withColumn("above", F.floor(F.col("block") / FAN))
            asked = asked.withColumnRenamed("block", "above").join(parts, "above").where("struct(first_key, first_page) <= struct(key, page_id) and struct(key, page_id) <= struct(last_key, last_page)").select("block", "key", "page_id")
        return asked

    def locate(self, wanted: DataFrame) -> DataFrame:
        """CAPTURE rows of the wanted(key, page_id) that are in the index. A block is read once, its keys pass it one by one."""

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lines: list[str] = []
            for batch in batches:
                found = []
                for key, page_id, packed in zip(*(batch.column(c).to_pylist() for c in ("key", "page_id", "packed"))):
                    if packed is not None:
                        lines = _lines(packed)
                    else:
                        found += _one_in_block(lines, key, page_id)
                if found:
                    yield _batch([[x[c.split()[0]] for x in found] for c in CAPTURE.split(", ")])

        asked = self.blocks_of(wanted).withColumn("packed", F.lit(None).cast("binary"))
        hit = self.blocks.join(asked.select("block").distinct(), "block", "left_semi")
        hit = hit.select("block", F.lit(None).cast("string").alias("key"), F.lit(None).cast("long").alias("page_id"), "packed")
        dealt = hit.union(asked.select("block", "key", "page_id", "packed")).repartition("block").sortWithinPartitions("block", F.asc_nulls_first("key"))
        return dealt.select("key", "page_id", "packed").mapInArrow(rows, CAPTURE)

    def find(self, url: str) -> DataFrame:
        """CAPTURE rows of one url: the blocks that can hold its key, searched in halves."""
        key = url_key(url)

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for packed in chain.from_iterable(b.column("packed").to_pylist() for b in batches):
                if found := _in_block(_lines(packed), key):
                    yield _batch([[x[c.split()[0]] for x in found] for c in CAPTURE.split(", ")])

        return self.blocks.where(_can_hold(F.lit(key))).select("packed").mapInArrow(rows, CAPTURE)


def build_index(captures: DataFrame, folder: str) -> CaptureIndex:
    """Sorts captures by key in ranges of about equal size, packs them into blocks and writes these under folder."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def block(lines: list[dict]) -> pa.RecordBatch:
            text = "\n".join(f"{x['key']}\t{'' if x['page_id'] is None else x['page_id']}\t{json.dumps(x)}" for x in lines)
            cols = [[lines[0]["key"]], [lines[0]["page_id"]], [lines[-1]["key"]], [lines[-1]["page_id"]], [len(lines)], [zlib.compress(text.encode())]]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i in (1, 3, 4) else None) for i, c in enumerate(cols)], [x.split()[0] for x in BLOCKS.split(", ")])

        for batch in batches:
            held += batch.to_pylist()
            while len(held) >= BLOCK_LINES:
                yield block(held[:BLOCK_LINES])
                del held[:BLOCK_LINES]
        if held:
            yield block(held)

    spark = captures.sparkSession
    # Tabs and line breaks can't be in a key: urls are escaped when they are written.
    ordered = captures.repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id")
    packed = ordered.mapInArrow(pack, BLOCKS)
    packed.withColumn("block", F.monotonically_increasing_id()).write.parquet(folder)
    blocks = spark.read.schema(f"{BLOCKS}, block long").parquet(folder)
    return CaptureIndex(blocks, blocks.count())


def read_ranges(captures: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest) of captures, each read from its file by seek and length."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, stream = None, None
        for batch in batches:
            found = []
            for page_id, path, offset, length in zip(*(batch.column(c).to_pylist() for c in ("page_id", "file", "offset", "length"))):
                if path != at:
                    if stream:
                        stream.close()
                    at, stream = path, opened(path)
                stream.seek(offset)
                [(_, _, _, payload)] = parse_records(io.BytesIO(stream.read(length)).read)
                found.append((page_id, len(payload), hashlib.sha256(payload).hexdigest()))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (pa.int64(), pa.int64(), pa.string()))], ["page_id", "payload_bytes", "payload_digest"])
        if stream:
            stream.close()

    ordered = captures.select("page_id", "file", "offset", "length").sortWithinPartitions("file", "offset")
    return ordered.mapInArrow(rows, "page_id long, payload_bytes long, payload_digest string")


def archive_report(pages: DataFrame) -> DataFrame:
    """The contract's columns: pages are archived, the archives read back and indexed; what a revisit refers to is
    looked up in the index and read by range."""
    spark = pages.sparkSession
    folder = scratch(spark, "warc")
    with tidy_shuffles(spark):
        write_archives(pages, f"{folder}/archive")
        captures = saved(read_archives(spark, f"{folder}/archive"), f"{folder}/captures")
        index = build_index(captures, f"{folder}/index")
        asked = captures.where("record_type = 'revisit'").select(F.col("refers_key").alias("key"), F.col("refers_to").alias("page_id")).distinct()
        first = read_ranges(index.locate(asked).where("record_type = 'response'"))
        first = saved(first.toDF("first_id", "first_bytes", "first_digest").distinct(), f"{folder}/first")
    # An id that repeats may be the response for several payloads, so the digest counts too.
    same = (F.col("refers_to") == F.col("first_id")) & (F.col("payload_digest") == F.col("first_digest"))
    joined = captures.join(broadcast_if_small(first), same, "left")
    return joined.select("page_id", F.coalesce("payload_bytes", "first_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
