"""Helpers that the operators of this subpackage share: shared folder, sizes, file access."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F


#: What empties each memo that this Python worker keeps between tasks, by the memo's name.
MEMOS: dict[str, Callable[[], None]] = {}


def working_on(memo: str = "") -> None:
    """Empty all memos but one, and give what is free to the system; workers are used again by tasks of other operators,
    and their memory is shared out tightly."""
    for name, empty in MEMOS.items():
        if name != memo:
            empty()
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # the GNU C library keeps freed memory until it is told
        trim(0)


#: Rows of texts that go to Python at once; Spark's own default of 10,000 long texts takes much of a task's memory.
BATCH_TEXTS = 1000


def text_batches(docs: DataFrame) -> DataFrame:
    """``docs``, in a session that sends at most ``BATCH_TEXTS`` rows to Python at once (fewer, if it is set so)."""
    conf, name = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_TEXTS:
        conf.set(name, str(BATCH_TEXTS))
    return docs


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder below the shared folder that ``spark.checkpoint.dir`` names (or ``setCheckpointDir`` has set).

    A session in local mode, where driver and tasks are one process, may leave it unset and gets a folder of its own.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="caselight-"))
        base = context.getCheckpointDir()
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, purpose: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet into the shared folder and read it again."""
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table from ``materialise`` that nothing reads any more."""
    paths = {path.rsplit("/", 1)[0] for path in df.inputFiles()}
    for path in paths:
        files, folder = filesystem(path)
        files.delete_dir(folder)


#: Rows of one number each that are broadcast at most (some 100 MB of an executor).
BROADCAST_ROWS = 2_000_000


def broadcast_if_small(ids: DataFrame) -> DataFrame:
    """``ids`` (one number a row), to be broadcast if they are few, so that texts joined with them are not shuffled; more
    are left to the planner, which shuffles both sides."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids


def first_rows(rows: DataFrame, group: str, order: list, n: int, shares: int = 64) -> DataFrame:
    """The first ``n`` rows of each group, with their ``rank``: those of shares of it first, so that no task sorts a whole group."""
    share = F.pmod(F.xxhash64(*rows.columns), F.lit(shares))
    some = rows.withColumn("share", share).withColumn("rank", F.row_number().over(Window.partitionBy(group, "share").orderBy(*order))).where(F.col("rank") <= n)
    return some.drop("share").withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("long")).where(F.col("rank") <= n)


def free_name(name: str, taken: list[str]) -> str:
    """``name`` with as many underscores before it as set it apart from all of ``taken``."""
    lower = {t.lower() for t in taken}
    while name.lower() in lower:
        name = "_" + name
    return name


def filesystem(uri: str):
    """The pyarrow file system of ``uri`` and the path in it (local mounts, HDFS, object stores)."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def runs(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[tuple, dict[str, list]]]:
    """Runs of rows with equal keys in sorted batches; a run may lie in several batches."""
    now, held = None, None
    for batch in batches:
        columns = {c: batch.column(c).to_pylist() for c in batch.schema.names}
        names = list(zip(*(columns[k] for k in keys)))
        start = 0
        for k in range(1, len(names) + 1):
            if k < len(names) and names[k] == names[start]:
                continue
            if names[start] != now:
                if now is not None:
                    yield now, held
                now, held = names[start], {c: [] for c in columns}
            for c, values in columns.items():
                held[c] += values[start:k]
            start = k
    if now is not None:
        yield now, held
