"""Session settings and input tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark then deletes the shuffle files of a DataFrame as soon as its action has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of a table that Spark broadcasts by its own guess. The guess is the size of compressed files, or of a row's columns
#: before a task makes many rows of one, so it may be a hundred times too low for the driver, which builds what is sent.
GUESSED = "spark.sql.autoBroadcastJoinThreshold"
#: Bytes of a batch that goes to a Python worker; by default only its rows are bounded, and a row may be a long text.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Rows of a few short columns that may be broadcast: some ten megabytes.
BROADCAST_ROWS = 100_000


def local_session(cores: int | str = 8, name: str = "loomwork", **conf: str) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    } | conf
    spark = SparkSession.builder.master(f"local[{cores}]").appName(name).config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _own_folder() -> str:
    folder = tempfile.mkdtemp(prefix="loomwork-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or for a local master a fresh folder.

    Also makes sure that DataFrame.checkpoint() has a folder to write to.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        current = context._jsc.sc().getCheckpointDir()
        folder = current.get() if current.isDefined() else "file://" + _own_folder()
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(folder)
    return folder


def _fs(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one for the tables of a job; what drop() leaves of it goes when the driver ends."""
    folder = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    fs, path = _fs(spark, folder)
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return folder


def drop(spark: SparkSession, *folders: str) -> None:
    """Deletes folders that no DataFrame reads any more."""
    for folder in folders:
        fs, path = _fs(spark, folder)
        fs.delete(path, True)


def saved(rows: DataFrame, folder: str, compression: str | None = None) -> DataFrame:
    """rows written to a folder and read again: no later step computes them anew, or needs what they came from."""
    rows.write.parquet(folder, compression=compression)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)


@contextmanager
def tidy_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within it, the shuffle files of an action go when the action ends, so disk holds those of one action, only tables
    whose rows were counted are broadcast, and batches of rows for Python are bounded in bytes."""
    settings = {CLEANUP: "true", GUESSED: "-1", BATCH_BYTES: "4m"}
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def broadcast_if_small(rows: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """rows, to be broadcast if there are no more than most of them; counted here, so rows should be a saved table."""
    return F.broadcast(rows) if rows.count() <= most else rows


def spread(rows: DataFrame) -> DataFrame:
    """rows over all cores; as they are, unless the input has fewer partitions than there are cores."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))
