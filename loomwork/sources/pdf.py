"""PDF files in a folder as a Spark data source: pages to rows, and rows to pages.

`spark.read.format("pdf_pages").load(folder)` gives a row for each page of the files whose names end in .pdf, in this
case: source (the file), page (from 0), pos, text, error. Files are listed on the driver and dealt to partitions of
about PART_BYTES; a larger file is read by several, each for its share of the pages. A file or page that can't be read
is a row with an error and no text, and the others are read all the same. What a task holds is one file.

`spark.readStream.format("pdf_pages").option("state", folder).load(folder)` gives the pages of files as they come or change.

`rows.write.format("pdf_pages").mode("append").save(folder)` writes rows (name, page, text), which must be sorted by
name and page within partitions, as one file for each name, under its final name only when it is whole; so a task that
is run again leaves the same files. A name that spans partitions would be written by each: deal rows by name.

Defined cases: a null text is a page without text. Hidden files are passed over. An empty folder has no rows; a missing
one is an error; the path of one file reads it alone. Passing parse reads files by Spark's binaryFile source and another parser instead.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage

from loomwork.session import tidy_shuffles
from loomwork.sources.pdftext import texts

FORMAT, VANISHED = "pdf_pages", "the file has vanished"
PAGES = "source string, page int, pos long, text string, error string"
#: Bytes of files for a partition, at most, and at least where there are more cores than partitions; partitions wanted for
#: a core; rows, and characters, of an Arrow batch; characters of a shown string; objects of an object stream.
PART_BYTES, LEAST_BYTES, WAVES, ROWS, CHARACTERS, SHOWN, PACKED = 32 << 20, 1 << 20, 4, 512, 4 << 20, 8_000, 100


def place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return (fs.LocalFileSystem(), path) if "://" not in path else fs.FileSystem.from_uri(path)


@dataclass
class FileRange(InputPartition):
    """Files with the share of their pages to read: (path, part, parts)."""

    files: list[tuple[str, int, int]]


class PdfReader(DataSourceReader):
    def __init__(self, folder: str, recursive: bool, part_bytes: int, cores: int = 1):
        self.folder, self.recursive, self.part_bytes, self.cores = folder.rstrip("/"), recursive, part_bytes, cores

    def listing(self) -> dict[str, tuple[int, int]]:
        """The length and time, in nanoseconds, of each PDF file."""
        store, at = place(self.folder)
        if (whole := store.get_file_info(at)).is_file:
            return {self.folder: (whole.size or 0, whole.mtime_ns or 0)}
        inner = lambda x: x.path[len(at) :].lstrip("/")
        found = store.get_file_info(fs.FileSelector(at, recursive=self.recursive))
        sound = [x for x in found if x.is_file and x.base_name.endswith(".pdf") and not any(n.startswith((".", "_")) for n in inner(x).split("/"))]
        return {f"{self.folder}/{inner(x)}": (x.size or 0, x.mtime_ns or 0) for x in sound}

    def partitions(self) -> Sequence[FileRange]:
        return self.ranges((path, size) for path, (size, _) in self.listing().items())

    def ranges(self, files: Iterable[tuple[str, int]]) -> list[FileRange]:
        """Files of these sizes in partitions of about part_bytes, or less where cores would stand idle; only files beyond
        part_bytes are shared, as each share reads the whole file."""
        ranges, held, size, files = [], [], 0, sorted(files)
        most = min(self.part_bytes, max(LEAST_BYTES, sum(n for _, n in files) // (WAVES * self.cores)))
        for path, n in files:
            parts = -(-n // self.part_bytes)
            if parts > 1:
                ranges += [FileRange([(path, k, parts)]) for k in range(parts)]
                continue
            if held and size + n > most:
                ranges.append(FileRange(held))
                held, size = [], 0
            held.append((path, 0, 1))
            size += n
        return [*ranges, FileRange(held)] if held or not ranges else ranges

    def read(self, partition: FileRange) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for path, part, parts in partition.files:
            if part < 0:
                rows.append((path, None, None, VANISHED))
                continue
            try:
                store, at = place(path)
                with store.open_input_file(at) as f:
                    data = f.read()
            except OSError as e:
                rows.append((path, None, None, f"{type(e).__name__}: {e}"))
                continue
            for page, text, error in texts(data, part, parts):
                rows.append((path, page, text, error))
                held += len(text or "")
                if len(rows) >= ROWS or held > CHARACTERS:
                    yield self._batch(rows)
                    rows, held = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        source, page, text, error = zip(*rows)
        columns = [pa.array(source), pa.array(page, pa.int32()), pa.array(page, pa.int64()), pa.array(text, pa.string()), pa.array(error, pa.string())]
        return pa.RecordBatch.from_arrays(columns, ["source", "page", "pos", "text", "error"])


class PdfChanges(DataSourceStreamReader):
    """The pages of files that are new or were replaced since the last batch; unchanged files aren't opened.

    The state is a numbered listing of paths, lengths and times in the state folder, an offset its number; so a batch
    that is run again reads the same files. A file that has vanished is a row with the error VANISHED.
    """

    def __init__(self, reader: PdfReader, state: str):
        self.reader, self.state = reader, state.rstrip("/")

    def _listing(self, n: int) -> dict[str, list[int]]:
        if not n:
            return {}
        store, at = place(f"{self.state}/{n:010d}.json")
        with store.open_input_file(at) as f:
            return json.loads(f.read())

    def _numbers(self) -> list[int]:
        store, at = place(self.state)
        store.create_dir(at, recursive=True)
        return sorted(int(x.base_name.removesuffix(".json")) for x in store.get_file_info(fs.FileSelector(at)) if x.base_name[:1] != "." and x.base_name.endswith(".json"))

    def initialOffset(self) -> dict:
        return {"listing": 0}

    def latestOffset(self) -> dict:
        last = max(self._numbers(), default=0)
        now = {path: list(x) for path, x in self.reader.listing().items()}
        if now == self._listing(last):
            return {"listing": last}
        store, at = place(f"{self.state}/{last + 1:010d}.json")
        hidden = at.replace(f"{last + 1:010d}.json", f".{last + 1}")
        with store.open_output_stream(hidden) as f:
            f.write(json.dumps(now).encode())
        store.move(hidden, at)
        return {"listing": last + 1}

    def partitions(self, start: dict, end: dict) -> Sequence[FileRange]:
        before, after = self._listing(start["listing"]), self._listing(end["listing"])
        gone = [(path, -1, 0) for path in sorted(before.keys() - after.keys())]
        return [*self.reader.ranges((path, x[0]) for path, x in after.items() if before.get(path) != x), *([FileRange(gone)] if gone else [])]

    def read(self, partition: FileRange) -> Iterator[pa.RecordBatch]:
        return self.reader.read(partition)

    def commit(self, end: dict) -> None:
        """Listings before the last two of a query that goes on aren't asked for any more."""
        for n in self._numbers():
            if n < end["listing"] - 1:
                store, at = place(f"{self.state}/{n:010d}.json")
                store.delete_file(at)


class PdfFile:
    """Writes one file page by page. Characters get codes in the order of their first use; a ToUnicode map gives them back.

    Compact files keep their dictionaries in object streams and have a cross-reference stream; others have a table.
    """

    CATALOG, PAGES, FONT, GLYPHS, UNICODE, FREE = 1, 2, 3, 4, 5, 6

    def __init__(self, out, compact: bool = True):
        self.out, self.compact, self.at = out, compact, 0
        self.places: dict[int, tuple[int, int, int]] = {0: (0, 0, 65535)}
        self.next, self.kids, self.loose = self.FREE, [], []
        self.codes: dict[int, int] = {}
        self.code_of = np.zeros(0x110000, ">u2")  # 0: none yet; pages of it that no character needs take no memory
        self._put(b"%PDF-1.7\n%\xe2\xe3\xcf\xd3\n")

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def _new(self) -> int:
        self.next += 1
        return self.next - 1

    def _object(self, number: int, body: str) -> None:
        if self.compact:
            self.loose.append((number, body))
            if len(self.loose) >= PACKED:
                self._pack()
        else:
            self.places[number] = (1, self.at, 0)
            self._put(f"{number} 0 obj\n{body}\nendobj\n".encode("latin-1"))

    def _stream(self, number: int, data: bytes, more: str = "") -> None:
        packed = zlib.compress(data, 1)
        self.places[number] = (1, self.at, 0)
        self._put(f"{number} 0 obj\n<< {more}/Length {len(packed)} /Filter /FlateDecode >>\nstream\n".encode() + packed + b"\nendstream\nendobj\n")

    def _pack(self) -> None:
        if not self.loose:
            return
        number, heads, body = self._new(), [], ""
        for i, (n, text) in enumerate(self.loose):
            heads.append(f"{n} {len(body)}")
            body += text + "\n"
            self.places[n] = (2, number, i)
        head = " ".join(heads) + "\n"
        self._stream(number, (head + body).encode("latin-1"), f"/Type /ObjStm /N {len(heads)} /First {len(head)} ")
        self.loose = []

    def page(self, text: str) -> None:
        points = np.frombuffer(text.encode("utf-32-le"), "<u4")
        for c in np.unique(points[self.code_of[points] == 0]).tolist():
            self.codes[c] = len(self.codes) + 1
            if len(self.codes) >= 1 << 16:
                raise ValueError("a file has more than 65,535 different characters")
            self.code_of[c] = self.codes[c]
        shown = self.code_of[points].tobytes().hex()
        lines, at = [], 0
        for line in text.split("\n"):
            ends = [*range(at, at + len(line), SHOWN), at + len(line)]
            lines.append(" ".join(f"<{shown[4 * a : 4 * b]}> Tj" for a, b in zip(ends, ends[1:])))
            at += len(line) + 1
        content, number = self._new(), self._new()
        self._stream(content, ("BT /F0 10 Tf 12 TL 36 806 Td\n" + "\nT* ".join(lines) + "\nET").encode())
        self._object(number, f"<< /Type /Page /Parent {self.PAGES} 0 R /Contents {content} 0 R >>")
        self.kids.append(number)

    def close(self) -> None:
        as_hex = lambda c: chr(c).encode("utf-16-be").hex()
        pairs = [f"<{code:04x}> <{as_hex(c)}>" for c, code in self.codes.items()]
        blocks = [pairs[i : i + 100] for i in range(0, len(pairs), 100)]
        cmap = "/CIDInit /ProcSet findresource begin\n12 dict begin\nbegincmap\n/CMapName /Own def\n/CMapType 2 def\n1 begincodespacerange\n<0000> <ffff>\nendcodespacerange\n"
        cmap += "".join(f"{len(b)} beginbfchar\n" + "\n".join(b) + "\nendbfchar\n" for b in blocks) + "endcmap\nend\nend\n"
        self._stream(self.UNICODE, cmap.encode())
        self._object(self.CATALOG, f"<< /Type /Catalog /Pages {self.PAGES} 0 R >>")
        kids = " ".join(f"{k} 0 R" for k in self.kids)
        self._object(self.PAGES, f"<< /Type /Pages /Count {len(self.kids)} /Kids [{kids}] /MediaBox [0 0 595 842] /Resources << /Font << /F0 {self.FONT} 0 R >> >> >>")
        self._object(self.FONT, f"<< /Type /Font /Subtype /Type0 /BaseFont /Helvetica /Encoding /Identity-H /DescendantFonts [{self.GLYPHS} 0 R] /ToUnicode {self.UNICODE} 0 R >>")
        self._object(self.GLYPHS, "<< /Type /Font /Subtype /CIDFontType2 /BaseFont /Helvetica /CIDSystemInfo << /Registry (Adobe) /Ordering (Identity) /Supplement 0 >> >>")
        self._pack()
        if self.compact:
            number, at = self._new(), self.at
            self.places[number] = (1, at, 0)
            rows = b"".join(kind.to_bytes(1, "big") + a.to_bytes(8, "big") + b.to_bytes(2, "big") for _, (kind, a, b) in sorted(self.places.items()))
            self._stream(number, rows, f"/Type /XRef /W [1 8 2] /Size {self.next} /Root {self.CATALOG} 0 R ")
        else:
            at = self.at
            rows = "".join(f"{a:010d} {b:05d} {'n' if kind else 'f'} \n" for _, (kind, a, b) in sorted(self.places.items()))
            self._put(f"xref\n0 {self.next}\n{rows}trailer\n<< /Size {self.next} /Root {self.CATALOG} 0 R >>\n".encode())
        self._put(f"startxref\n{at}\n%%EOF\n".encode())


class PdfWriter(DataSourceArrowWriter):
    def __init__(self, folder: str, compact: bool):
        self.folder, self.compact = folder.rstrip("/"), compact

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        attempt, open_name, out, file = TaskContext.get().taskAttemptId(), None, None, None
        store, folder = place(self.folder)
        store.create_dir(folder, recursive=True)

        def close() -> None:
            if out is not None:
                file.close()
                out.close()
                store.move(f"{folder}/.{open_name}.{attempt}", f"{folder}/{open_name}")

        for batch in iterator:
            for name, text in zip(batch.column("name").to_pylist(), batch.column("text").to_pylist()):
                if name != open_name:
                    close()
                    if not name or "/" in name or name.startswith((".", "_")) or not name.endswith(".pdf"):
                        raise ValueError(f"{name!r} isn't the name of a PDF file")
                    open_name, out = name, store.open_output_stream(f"{folder}/.{name}.{attempt}")
                    file = PdfFile(out, self.compact)
                file.page(text or "")
        close()
        return WriterCommitMessage()


class PdfPages(DataSource):
    """format("pdf_pages"). Options: path; recursive, partBytes and cores to read, state to read as a stream, compact to write."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return PAGES

    def reader(self, schema) -> PdfReader:
        return PdfReader(self.options["path"], self.options.get("recursive", "false").lower() == "true", int(self.options.get("partBytes", PART_BYTES)), int(self.options.get("cores", 1)))

    def streamReader(self, schema) -> PdfChanges:
        return PdfChanges(self.reader(schema), self.options["state"])

    def writer(self, schema, overwrite: bool) -> PdfWriter:
        return PdfWriter(self.options["path"], self.options.get("compact", "true").lower() == "true")


def pdf_files(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", recursive)
    return files.load(folder)


def pdf_pages(spark: SparkSession, folder: str, *, recursive: bool = False, parse: Callable[[bytes], list[str]] | None = None, part_bytes: int = PART_BYTES) -> DataFrame:
    """(source, page, pos, text, error) of every page; pages count from 0, and pos orders the pages of a file."""
    if parse is None:
        spark.dataSource.register(PdfPages)
        return spark.read.format(FORMAT).option("recursive", str(recursive)).option("partBytes", part_bytes).option("cores", spark.sparkContext.defaultParallelism).load(folder)

    def pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                found = parse(bytes(content))
                yield pd.DataFrame({"source": path, "page": range(len(found)), "pos": range(len(found)), "text": found, "error": None})

    return pdf_files(spark, folder, recursive).select("path", "content").mapInPandas(pages, PAGES)


def write_pdfs(pages: DataFrame, folder: str, *, compact: bool = True) -> None:
    """The pages(name, page, text) as PDF files, one for each name; pages of a file are in the order of page."""
    pages.sparkSession.dataSource.register(PdfPages)
    rows = pages.select("name", "page", "text").repartition("name").sortWithinPartitions("name", "page").select("name", "text")
    with tidy_shuffles(pages.sparkSession):
        rows.write.format(FORMAT).mode("append").option("compact", str(compact)).save(folder)


def text_pages(documents: DataFrame) -> DataFrame:
    """A table of documents(doc_id, source, text) as pages: a document is a page of its source."""
    return documents.select("source", F.col("doc_id").alias("page"), F.col("doc_id").alias("pos"), "text")
