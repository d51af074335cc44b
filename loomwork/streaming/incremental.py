"""Incremental ingest: files that arrive in a folder are split and stored once.

Each micro-batch is compared with the store as it is then, so a restart, or a page that comes twice, adds nothing. PDF
files are told apart by path, length and time: an unchanged one isn't opened again, one that was replaced is read anew
(chunks whose ids are there are left as they are, as ingest does), and one that has vanished keeps its chunks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from loomwork.plans.engine import Engine
from loomwork.session import drop, saved, scratch
from loomwork.sources.pdf import FORMAT, PdfPages

PAGES = "source string, page int, pos long, text string"


def ingest_stream(engine: Engine, pages: DataFrame, checkpoint: str) -> StreamingQuery:
    """Ingests a stream of pages; it ends when all that is there now has been read."""

    def batch(rows: DataFrame, _: int) -> None:
        engine.ingest(rows.dropDuplicates(["source", "page", "pos"]))

    return pages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def pdf_stream(engine: Engine, checkpoint: str) -> DataFrame:
    """The pages of new and replaced PDF files of the engine's data folder."""
    engine.spark.dataSource.register(PdfPages)
    return engine.spark.readStream.format(FORMAT).option("state", f"{checkpoint}-files").load(engine.data_path)


def ingest_pdf_stream(engine: Engine, checkpoint: str, seen: Callable[[DataFrame], None] | None = None) -> StreamingQuery:
    """Ingests new and replaced PDF files; it ends when all that is there now has been read. seen gets the rows of each batch."""

    def batch(rows: DataFrame, _: int) -> None:
        folder = scratch(engine.spark, "pages")
        rows = saved(rows, f"{folder}/pages")  # files are parsed once for all that follows
        if seen:
            seen(rows)
        engine.ingest(rows.where("error is null").drop("error"))
        drop(engine.spark, folder)

    return pdf_stream(engine, checkpoint).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def page_stream(engine: Engine, folder: str) -> DataFrame:
    """Parquet files of pages that land in a folder."""
    return engine.spark.readStream.schema(PAGES).parquet(folder)
