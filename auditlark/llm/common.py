"""Shared helpers: the shared folder, written stages, and state that a Python worker keeps between tasks."""

from __future__ import annotations

import ctypes
import functools
import re
import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the contract for documents: runs of anything but blank, tab, line feed, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from the session. Only a session that runs in one process on one
    machine (tests) may leave it unset and gets a folder of its own; anywhere else no other folder is safe."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="auditlark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage ends here and survives lost executors."""
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete the files below frames that written() made and that nothing reads any more."""
    for df in frames:
        for top in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(top)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of an Arrow batch between Spark and its Python workers, where the session has Spark's own default.
BATCH_ROWS, DEFAULT_ROWS = 2000, "10000"


def small_batches(spark: SparkSession) -> None:
    """Long texts make Spark's default batches large in both processes: a session that hasn't chosen gets smaller ones."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, DEFAULT_ROWS) == DEFAULT_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def documents_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the two columns that text operators read; other columns, whatever their names, stay outside."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))


def worker_state() -> dict:
    """A dictionary that lives as long as the Python worker, for tokenizers and their caches."""
    return sys.modules.setdefault("_auditlark_worker_state", types.ModuleType("_auditlark_worker_state")).__dict__


def returning_memory(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, a map over Arrow batches, giving freed memory back to the system at the end of each task.

    A worker outlives its task, and what its allocators keep counts against the executor while Spark's own tasks run.
    """

    @functools.wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            _trim()

    return wrapped


def _trim() -> None:
    state = worker_state()
    if "trim" not in state:
        state["trim"] = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if state["trim"]:
        state["trim"](0)
