"""The retrieval engine: ingest pages, ask questions, see the status, reset."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.functions.judging import agreement_column
from loomwork.functions.models import Embedder, ExtractiveGenerator, Generator, TermEmbedder, embed_column, generate_column
from loomwork.functions.text import is_blank, verdict, verdict_or_error
from loomwork.operators.answers import NOTHING_FOUND, assembled
from loomwork.operators.chunking import numbered, recursive_chunks
from loomwork.operators.retrieval import K, nearest, with_texts
from loomwork.sources.pdf import pdf_pages
from loomwork.sources.store import ChunkStore


class BlankQuestion(ValueError):
    """A question without anything but white space."""


class NotAPdf(ValueError):
    """A file whose name doesn't end in .pdf, or that has a path in its name."""


class DamagedPdf(ValueError):
    """An uploaded file that can't be read."""


@dataclass(frozen=True)
class Answer:
    answer: str
    sources: list[str]


class Engine:
    def __init__(self, spark: SparkSession, store_path: str, data_path: str = "data", *, embedder: Embedder | None = None, generator: Generator | None = None, split: Callable[[DataFrame], DataFrame] = recursive_chunks, parse: Callable[[bytes], list[str]] | None = None):
        self.spark, self.data_path = spark, data_path
        self.store = ChunkStore(spark, store_path)
        self.embedder, self.generator = embedder or TermEmbedder(), generator or ExtractiveGenerator()
        self.split, self.parse = split, parse

    def health(self) -> dict[str, str]:
        return {"status": "ok", "message": "The retrieval engine is running."}

    def ingest(self, pages: DataFrame | None = None, *, reset: bool = False) -> int:
        """Splits pages, by default those of the data folder's PDF files, and stores new chunks; returns how many.

        A chunk whose id is there already is left as it is, even if its text has changed. Files and pages that can't be
        read are passed over; damaged() names them.
        """
        if reset:
            self.reset()
        if pages is None:
            pages = pdf_pages(self.spark, self.data_path, parse=self.parse).where("error is null")
        chunks = self.split(pages).withColumn("page", F.col("page").cast("string"))
        return self.store.add(chunks, lambda text: embed_column(text, self.embedder), numbered)

    def damaged(self) -> DataFrame:
        """(source, page, error) of the data folder's files, page null, and pages that can't be read."""
        return pdf_pages(self.spark, self.data_path, parse=self.parse).where("error is not null").select("source", "page", "error")

    def upload(self, name: str, content: bytes) -> int:
        """Puts a PDF file in the data folder and ingests the folder; a file it replaces comes back on failure.

        A file that can't be read, so that nothing was added, is a failure too.
        """

        def write(fs, path) -> None:
            stream = fs.create(path, True)
            stream.write(content)
            stream.close()

        return self._land(name, write)

    def upload_file(self, file: str) -> int:
        """As upload, for a PDF file that is in a store already, as one that tasks have written: it is copied from there."""

        def copy(fs, path) -> None:
            source = self.spark._jvm.org.apache.hadoop.fs.Path(file)
            configuration = self.spark._jsc.hadoopConfiguration()
            if not self.spark._jvm.org.apache.hadoop.fs.FileUtil.copy(source.getFileSystem(configuration), source, fs, path, False, True, configuration):
                raise OSError(f"{file} can't be copied")

        return self._land(file.rpartition("/")[2], copy)

    def _land(self, name: str, write: Callable) -> int:
        if not name.endswith(".pdf") or "/" in name or "\\" in name or name.startswith("."):
            raise NotAPdf(name)
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.data_path, name)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        old = jvm.org.apache.hadoop.fs.Path(self.data_path, f".{name}.{uuid.uuid4().hex}")
        replaced = fs.exists(path)
        if replaced and not fs.rename(path, old):
            raise OSError(f"{name} can't be replaced")
        try:
            write(fs, path)
            added = self.ingest()
            if not added and self.parse is None and (bad := pdf_pages(self.spark, f"{self.data_path}/{name}").where("page is null").first()):
                raise DamagedPdf(f"{name}: {bad.error}")
        except Exception:
            fs.delete(path, False)
            if replaced:
                fs.rename(old, path)
            raise
        if replaced:
            fs.delete(old, False)
        return added

    def hits(self, questions: DataFrame, k: int = K) -> DataFrame:
        """(query_id, rank, id, text) of the k nearest stored chunks to each of questions(query_id, question)."""
        stored = self.store.read()
        vectors = questions.select("query_id", embed_column(F.col("question"), self.embedder).alias("vector"))
        found = nearest(stored, vectors, k=k, id_type="string")
        return with_texts(found, stored, k * questions.count())

    def answers(self, questions: DataFrame, k: int = K) -> DataFrame:
        """(query_id, answer, sources) of many questions(query_id, question); blank ones are dropped."""
        asked = questions.where(~is_blank(F.col("question")))
        ready = assembled(asked, self.hits(asked, k))
        answer = generate_column(F.coalesce("prompt", F.lit("")), F.col("texts"), self.generator)
        return ready.select("query_id", F.when(F.size("texts") > 0, answer).otherwise(NOTHING_FOUND).alias("answer"), "sources")

    def query(self, question: str, k: int = K) -> Answer:
        """The answer to one question; it is passed on as it is, spaces included."""
        asked = self.spark.createDataFrame([(0, question)], "query_id long, question string")
        if asked.where(is_blank(F.col("question"))).count():
            raise BlankQuestion("the question is blank")
        row = self.answers(asked, k).first()
        return Answer(row.answer, list(row.sources))

    def status(self) -> DataFrame:
        """One row: document_count (of chunks), chroma_path (the store's, whatever it is; the field's name is the API's) and data_path."""
        return self.spark.createDataFrame([(self.store.count(), self.store.path, self.data_path)], "document_count int, chroma_path string, data_path string")

    def reset(self) -> None:
        self.store.reset()


def judged(engine: Engine, cases: DataFrame, judge=agreement_column, *, strict: bool = True) -> DataFrame:
    """(query_id, passed) of cases(query_id, question, expected): judge(expected, answer) columns give a verdict text.

    A text that is no verdict is an error; if not strict, it is in a further column, error, and passed is null.
    """
    told = cases.join(engine.answers(cases.select("query_id", "question")), "query_id")
    said = F.trim(judge(F.col("expected"), F.col("answer")))
    if strict:
        return told.select("query_id", verdict(said).alias("passed"))
    return told.select("query_id", verdict_or_error(said).alias("v")).select("query_id", "v.passed", "v.error")
