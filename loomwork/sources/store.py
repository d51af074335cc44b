"""The chunk store: Parquet files of chunks with their vectors, under numbered snapshots.

Each add writes a batch, a folder of data files, dealt by ranges of id buckets, and a table of Bloom filters, one for each
file's ids. A snapshot is a small file in `log` that lists the batches of the store; the highest number counts. It is
written beside and takes its place by one rename, which fails if the number is taken: a reader sees the store as it was
or as it is, whole, whatever step a writer was killed at, and of two writers from one snapshot the second is refused. A
reset is a snapshot without batches; their files are deleted after it. What killed writers leave, vacuum() deletes.

Insert-if-absent asks the filters first, and reads ids only of files that may hold one of the new ones. Ids alone tell
which chunks are new; then only the texts of new chunks move, once, to the files they are written to.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.session import broadcast_if_small, drop, saved, scratch, tidy_shuffles

SCHEMA = "id string, source string, page string, chunk int, pos long, text string, vector array<float>"
FILTERS = "file string, low int, high int, bits binary"
#: Rows of a data file, about, and twice that at most; buckets of ids; ids that a task asks a filter for at once.
FILE_ROWS, BUCKETS, PART = 25_000, 16_384, 200_000
#: Bits of a filter for each id, and how many of them an id sets: one in a hundred other ids is let through.
BITS, HASHES = 10, 7
#: Rounds that a large batch is written in, at most, and files of a round at least.
ROUNDS, ROUND_FILES = 3, 8
#: Snapshots kept in the log.
KEPT = 20


class DuplicateIds(ValueError):
    """A batch holds an id more than once."""


class ConcurrentWrite(RuntimeError):
    """Another writer has changed the store meanwhile; nothing was written."""


def insert_if_absent(chunks: DataFrame, store: DataFrame) -> DataFrame:
    """The chunks whose id isn't in the store; rows without an id count as absent. Only the store's ids are read."""
    return chunks.join(store.select("id"), "id", "left_anti")


def bucket(id_: Column) -> Column:
    return F.pmod(F.xxhash64(id_), F.lit(BUCKETS)).cast("int")


def places(first: np.ndarray, second: np.ndarray, size: int) -> np.ndarray:
    """(ids, HASHES) bits that ids of these two hashes set in a filter of size bits."""
    a, b = first.view(np.uint64)[:, None], second.view(np.uint64)[:, None] | np.uint64(1)
    with np.errstate(over="ignore"):
        return (a + b * np.arange(HASHES, dtype=np.uint64)) % np.uint64(size)


class ChunkStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    # Snapshots

    def _hadoop(self, *parts: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _names(self, *parts: str) -> dict[str, int]:
        """Names in a folder, with their times in milliseconds."""
        fs, path = self._hadoop(*parts)
        return {x.getPath().getName(): x.getModificationTime() for x in fs.listStatus(path)} if fs.exists(path) else {}

    def _log(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self._names("log") if n.endswith(".json") and not n.startswith("."))

    def snapshot(self) -> tuple[int, list[str]]:
        """The number of the current snapshot, and its batches; (0, []) where there is none."""
        log = self._log()
        if not log:
            return 0, []
        fs, path = self._hadoop("log", f"{log[-1]:010d}.json")
        stream = fs.open(path)
        try:
            text = bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()
        return log[-1], json.loads(text)["batches"]

    def _commit(self, number: int, batches: Sequence[str]) -> None:
        """Makes batches the snapshot of this number, which must be free."""
        fs, new = self._hadoop("log", f".{uuid.uuid4().hex}")
        _, path = self._hadoop("log", f"{number:010d}.json")
        stream = fs.create(new, True)
        stream.write(json.dumps({"batches": list(batches)}).encode())
        stream.close()
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.getFileSystem(self.spark._jsc.hadoopConfiguration()).getUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(fs.makeQualified(new), fs.makeQualified(path), none)
        except Py4JJavaError as e:
            fs.delete(new, False)
            if "FileAlreadyExistsException" in str(e.java_exception):
                raise ConcurrentWrite(f"{self.path} has a snapshot {number} already") from None
            raise
        for old in self._log()[:-KEPT]:
            fs.delete(self._hadoop("log", f"{old:010d}.json")[1], False)

    def vacuum(self, older_than: float = 86_400.0) -> int:
        """Deletes batches that aren't in the current snapshot and have been there for so many seconds; returns how many."""
        current, now = set(self.snapshot()[1]), self.spark._jvm.System.currentTimeMillis()
        gone = [n for n, t in self._names("batches").items() if n not in current and now - t >= 1_000 * older_than]
        drop(self.spark, *(f"{self.path}/batches/{n}" for n in gone))
        return len(gone)

    # Reading

    def _of(self, batches: Sequence[str], part: str, schema: str) -> DataFrame:
        folders = [f"{self.path}/batches/{b}/{part}" for b in batches]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame:
        """The stored chunks; of a missing store, no rows. A damaged one raises when it is read."""
        return self._of(self.snapshot()[1], "data", SCHEMA)

    def ids(self) -> DataFrame:
        return self.read().select("id")

    def count(self) -> int:
        return self.read().count()

    def may_hold(self, chunks: DataFrame, batches: Sequence[str]) -> list[str]:
        """The data files of batches that may hold an id of chunks, by their filters."""
        ids = chunks.where("id is not null").select(F.xxhash64("id").alias("first"), F.xxhash64("id", F.lit(1)).alias("second"), bucket(F.col("id")).alias("bucket"))
        parts = max(1, -(-ids.count() // PART))
        filters = self._of(batches, "filters", FILTERS)
        spans = filters.select(F.col("file").alias("of"), F.explode(F.sequence("low", "high")).alias("bucket"))
        asked = ids.join(spans, "bucket").withColumn("part", F.pmod(F.col("second"), F.lit(parts)).cast("int"))
        dealt = filters.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

        def ask(rows: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
            bits = np.frombuffer(own["bits"].iloc[0], np.uint8) if len(own) else np.zeros(0, np.uint8)
            if not len(rows) or not len(bits):
                return pd.DataFrame({"file": pd.Series(dtype=object)})
            at = places(rows["first"].to_numpy(np.int64), rows["second"].to_numpy(np.int64), 8 * len(bits))
            there = (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).all(1).any()
            return own[["file"]].head(1 if there else 0)

        found = asked.select("of", "part", "first", "second").groupBy("of", "part").cogroup(dealt.groupBy("file", "part")).applyInPandas(ask, "file string")
        return [r.file for r in found.distinct().collect()]  # names of files

    def known(self, chunks: DataFrame) -> DataFrame:
        """(id) of the stored chunks that could have an id of chunks: those of files that may hold one."""
        batches = self.snapshot()[1]
        files = self.may_hold(chunks, batches) if batches else []
        paths = [f"{self.path}/batches/{f}" for f in files]
        return self.spark.read.schema("id string").parquet(*paths) if paths else self.spark.createDataFrame([], "id string")

    def absent(self, chunks: DataFrame, n: int, folder: str) -> DataFrame | None:
        """Those of n saved chunks, of differing ids, that aren't stored; None if all are. No text is shuffled where all or few are new."""
        known = self.known(chunks)
        if known.isEmpty():
            return chunks
        ids = saved(insert_if_absent(chunks.select("id"), known), f"{folder}/absent")
        new = ids.count()
        if new in (0, n):
            return chunks if new else None
        ids = broadcast_if_small(ids.withColumnRenamed("id", "new"))
        return chunks.join(ids, F.col("id").eqNullSafe(F.col("new")), "left_semi")

    # Writing

    def _write(self, rows: DataFrame, vector_of, batch: str, files: int) -> int:
        """Writes a batch with its filters; returns its number of rows. Vectors are made where rows are written, so none is shuffled.

        Many files are written in a few rounds, so that disk holds the shuffle of one round only.
        """
        folder = f"{self.path}/batches/{batch}"
        share = F.floor(F.coalesce(bucket(F.col("id")), F.lit(0)) * files / BUCKETS).cast("int")
        rounds = max(1, min(ROUNDS, files // ROUND_FILES))
        cuts = [files * r // rounds for r in range(rounds + 1)]
        for low, high in zip(cuts, cuts[1:]):
            own = rows.where((share >= low) & (share < high)).repartitionById(high - low, share - low)
            own.withColumn("vector", vector_of(F.col("text"))).write.mode("append").option("maxRecordsPerFile", 2 * FILE_ROWS).option("compression", "zstd").parquet(f"{folder}/data")
        written = self.spark.read.schema(SCHEMA).parquet(f"{folder}/data")
        n = written.count()
        name = F.concat(F.lit(f"{batch}/data/"), F.substring_index(F.input_file_name(), "/", -1)).alias("file")
        ids = written.select(name, F.xxhash64("id").alias("first"), F.xxhash64("id", F.lit(1)).alias("second"), bucket(F.col("id")).alias("bucket"))

        def fill(rows: pd.DataFrame) -> pd.DataFrame:
            size = -(-BITS * len(rows) // 8)
            bits = np.zeros(8 * size, np.uint8)
            bits[places(rows["first"].to_numpy(np.int64), rows["second"].to_numpy(np.int64), 8 * size).ravel()] = 1
            packed = np.packbits(bits, bitorder="little").tobytes()
            return pd.DataFrame({"file": [rows["file"].iloc[0]], "low": [rows["bucket"].min()], "high": [rows["bucket"].max()], "bits": [packed]})

        ids.groupBy("file").applyInPandas(fill, FILTERS).write.parquet(f"{folder}/filters")
        return n

    def add(self, chunks: DataFrame, vector_of, number: Callable[[DataFrame, str], DataFrame] | None = None) -> int:
        """Appends the chunks(id, source, page, chunk, pos, text) that aren't there; returns how many.

        Vectors are computed by vector_of(text column) for new chunks only. Ids within the batch must differ. If chunks have
        no ids yet, number gives them to the table of all, which it may read several times; it gets a folder for its own tables.
        """
        with tidy_shuffles(self.spark):
            return self._add(chunks, vector_of, number)

    def _add(self, chunks: DataFrame, vector_of, number) -> int:
        folder = scratch(self.spark, "batch")
        try:
            chunks = saved(chunks, f"{folder}/chunks", "zstd")  # split once for all that follows
            chunks = number(chunks, folder) if number else chunks
            repeated = chunks.groupBy("id").count().where("count > 1").select("id").limit(3).collect()
            if repeated:
                raise DuplicateIds(f"ids occur more than once: {', '.join(str(r.id) for r in repeated)}")
            number, batches = self.snapshot()
            n = chunks.count()
            new = self.absent(chunks, n, folder)
            if new is None:
                return 0
            rows = new.select("id", "source", F.col("page").cast("string").alias("page"), F.col("chunk").cast("int").alias("chunk"), F.col("pos").cast("long").alias("pos"), "text")
            batch, kept = uuid.uuid4().hex, False
            try:
                added = self._write(rows, vector_of, batch, min(BUCKETS, max(1, -(-n // FILE_ROWS))))
                if added:
                    self._commit(number + 1, [*batches, batch])
                    kept = True
            finally:
                if not kept:
                    drop(self.spark, f"{self.path}/batches/{batch}")
            return added
        finally:
            drop(self.spark, folder)

    def reset(self) -> None:
        """An empty store from now on; then deletes the files of the chunks that were there. Sources stay."""
        number, batches = self.snapshot()
        if batches:
            self._commit(number + 1, [])
            drop(self.spark, *(f"{self.path}/batches/{b}" for b in batches))
