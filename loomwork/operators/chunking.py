"""Splitting pages into overlapping chunks, and chunk ids.

Pages are rows (source, page, pos, text): pos orders them. Chunks are rows (source, page, pos, chunk, text),
chunk counting from 0 within a page.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomwork.session import saved, scratch

SIZE, OVERLAP = 800, 80
#: From strong to weak; an empty one cuts anywhere.
SEPARATORS = ("\n\n", "\n", " ", "")


def stride_chunks(pages: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Chunks of size code points that start every size - overlap; an empty text is one empty chunk, a null none.

    A text is first cut into pieces of one step each, in a single pass by a pattern; a chunk is a few pieces in a
    row, cut to size. So the work is in proportion to a text's length, which substrings of the whole would not be.
    """
    step = size - overlap
    last = F.greatest(F.lit(0), F.ceil((F.length("text") - size) / step)).cast("int")
    pieces = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{step}}}"), F.lit(0))
    several = -(-size // step)
    chunk = lambda i: F.substring(F.array_join(F.slice("pieces", i + 1, several), ""), 1, size)
    cut = pages.where("text is not null").withColumn("pieces", pieces)
    return cut.select("source", "page", "pos", F.posexplode(F.transform(F.sequence(F.lit(0), last), chunk)).alias("chunk", "text"))


def split_text(text: str, size: int = SIZE, overlap: int = OVERLAP, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Chunks of at most size code points, cut at the strongest separators that make pieces fit.

    Pieces are packed as long as they fit; the trailing pieces of a chunk, up to overlap code points, open the
    next one too. Chunks are stripped of white space at the ends, and empty ones dropped.
    """
    pieces = _pieces(text, size, separators)
    chunks, held, length = [], [], 0
    for piece in pieces:
        if held and length + len(piece) > size:
            chunks.append("".join(held))
            while held and (length > overlap or length + len(piece) > size):
                length -= len(held.pop(0))
        held.append(piece)
        length += len(piece)
    chunks.append("".join(held))
    return [c for c in (x.strip() for x in chunks) if c]


def _pieces(text: str, size: int, separators: tuple[str, ...]) -> list[str]:
    """Parts of at most size code points that join to the text; a separator stays with the part before it."""
    mark, weaker = separators[0], separators[1:]
    if not mark:
        return list(text) if len(text) > size else [text]
    parts = text.split(mark)
    found = []
    for part in [p + mark for p in parts[:-1]] + parts[-1:]:
        if len(part) <= size:
            found.append(part)
        else:
            found += _pieces(part, size, weaker or ("",))
    return found


def recursive_chunks(pages: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Chunks by split_text; a text without anything but white space has none."""

    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        return pd.Series([split_text(t or "", size, overlap) for t in texts])

    return pages.select("source", "page", "pos", F.posexplode(split("text")).alias("chunk", "text"))


def page_key(source: Column, page: Column) -> Column:
    """source:page, None standing for what is missing."""
    return F.concat(F.coalesce(source.cast("string"), F.lit("None")), F.lit(":"), F.coalesce(page.cast("string"), F.lit("None")))


def page_chunk_ids(chunks: DataFrame) -> DataFrame:
    """chunks with id source:page:index, where index is the chunk's own; source and page must name one page only.

    No row moves for it: chunk already counts within a page.
    """
    return chunks.withColumn("id", F.concat(page_key(F.col("source"), F.col("page")), F.lit(":"), F.col("chunk")))


def repeated_page_ids(chunks: DataFrame) -> DataFrame:
    """As page_chunk_ids, for pages that come in several rows: the chunks of all count on, in the order of pos."""
    order = Window.partitionBy("source", "page").orderBy("pos", "chunk")
    return chunks.withColumn("id", F.concat(page_key(F.col("source"), F.col("page")), F.lit(":"), F.row_number().over(order) - 1))


def numbered(chunks: DataFrame, folder: str) -> DataFrame:
    """A saved table of chunks with ids as by repeated_page_ids: no text moves for it unless a page comes in several rows."""
    if chunks.where("chunk = 0").groupBy("source", "page").count().where("count > 1").isEmpty():
        return page_chunk_ids(chunks)
    return saved(repeated_page_ids(chunks), f"{folder}/numbered")


def run_length_ids(chunks: DataFrame, order: list[str]) -> DataFrame:
    """chunks with id source:page:index, where the index starts anew whenever source:page differs from the row before.

    If a page comes again later, its ids come again too. Rows are sorted by range over all tasks and numbered there by
    windows within a task's range; of each range only how it begins and ends, one row, meets the others, to tell what
    its first run goes on from.
    """
    spark = chunks.sparkSession
    keyed = chunks.withColumn("lw_key", page_key(F.col("source"), F.col("page")))
    ranged = keyed.repartitionByRange(*order).withColumn("lw_part", F.spark_partition_id())
    folder = scratch(spark, "runs")
    ranged = saved(ranged, f"{folder}/ranges")
    # An exchange by lw_part keeps each range whole and apart, and is as even as the ranges are.
    part = Window.partitionBy("lw_part").orderBy(*order)
    starts = F.coalesce(F.lag("lw_key").over(part) != F.col("lw_key"), F.lit(True)).cast("int")
    marked = ranged.withColumns({"lw_run": starts, "lw_row": F.row_number().over(part)})
    so_far = part.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = marked.withColumn("lw_from", F.max(F.when(F.col("lw_run") == 1, F.col("lw_row"))).over(so_far))
    placed = saved(placed.withColumn("lw_index", F.col("lw_row") - F.col("lw_from")).drop("lw_run"), f"{folder}/placed")
    last = F.max_by(F.struct("lw_key", "lw_from", "lw_row"), "lw_row").alias("last")
    ends = sorted(placed.groupBy("lw_part").agg(F.min_by("lw_key", "lw_row").alias("first"), last).collect(), key=lambda r: r.lw_part)
    goes_on, before, length = [], None, 0
    for r in ends:
        carried = length if r.first == before else 0
        goes_on.append((r.lw_part, carried))
        length = r["last"].lw_row - r["last"].lw_from + 1 + (carried if r["last"].lw_from == 1 else 0)
        before = r["last"].lw_key
    carried = spark.createDataFrame(goes_on, "lw_of int, lw_carried long")  # a row for each task
    joined = placed.join(F.broadcast(carried), F.col("lw_part") == F.col("lw_of"))
    index = F.col("lw_index") + F.when(F.col("lw_from") == 1, F.col("lw_carried")).otherwise(0)
    return joined.select(*(F.col(f"`{c}`") for c in chunks.columns), F.concat("lw_key", F.lit(":"), index).alias("id"))
