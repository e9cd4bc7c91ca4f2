"""Helpers shared by the training-data operators: inputs, durable cuts, keyed text batches."""

from __future__ import annotations

import ctypes
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return table(spark, sf_dir, "documents")


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 4 << 20) -> None:
    """Fewer rows to an Arrow batch than usual, and about ``size`` bytes, unless the session has a bound of its own (a longer text is a batch by itself): texts differ in length, and what a task holds at once should not."""
    name, limit = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name)) > rows:
        spark.conf.set(name, rows)
    if spark.conf.get(limit, None) is None:  # the user's own stays
        spark.conf.set(limit, size)


def trim() -> None:
    """Hand memory that a task has freed back to the system: workers live on, and their peaks would add up."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it; a local one only where it is unset and one machine does all."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="fascicle-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Spark deletes a query's shuffle files when it ends, not when the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Tables that :func:`cut` has written and nothing has deleted yet. One that a returned DataFrame reads stays until :func:`release`.
_CUTS: list[str] = []
_watching = threading.local()


@contextmanager
def collected() -> Iterator[list[str]]:
    """The tables that this thread cuts meanwhile, in order."""
    lists = _watching.__dict__.setdefault("lists", [])
    own: list[str] = []
    lists.append(own)
    try:
        yield own
    finally:
        lists.pop()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends here, a lost executor costs nothing before it.

    Shuffle files of the write go when it ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    usual = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if usual is None else spark.conf.set(_CLEANUP, usual)
    _CUTS.append(path)
    for own in getattr(_watching, "lists", ()):
        own.append(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def drop(*frames: DataFrame) -> None:
    """Delete tables made by :func:`cut` once a later cut holds what came from them."""
    for df in frames:
        for parent in {f.rpartition("/")[0] for f in df.inputFiles()}:
            own = [p for p in _CUTS if p.rpartition("/")[2] == parent.rpartition("/")[2]]
            for path in own:
                _delete(df.sparkSession, path)
                _CUTS.remove(path)


def cuts() -> list[str]:
    """The tables that stand now, to be released when what came from them is written."""
    return list(_CUTS)


def rest(spark: SparkSession) -> None:
    """Between steps of many jobs, have the driver collect its garbage once its heap has grown to half of what it may be: only then it gives memory back."""
    runtime = spark._jvm.java.lang.Runtime.getRuntime()
    if 2 * runtime.totalMemory() > runtime.maxMemory():
        spark._jvm.java.lang.System.gc()
    trim()


def release(spark: SparkSession, paths: list[str]) -> None:
    """Delete these tables, which nothing reads any more."""
    rest(spark)
    for path in paths:
        if path in _CUTS:
            _delete(spark, path)
            _CUTS.remove(path)


def partitions(df: DataFrame, each: int = 32 << 20) -> int:
    """Into how many tasks to deal what comes of ``df``, so that each can hold its part: the session's count, or more where the plan's own estimate of the input asks for it."""
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return usual if size >= 1 << 60 else max(usual, min(size // each, 1000 * usual))


def crc32_of_id(column: str) -> F.Column:
    return F.crc32(F.col(column).cast("string").cast("binary"))


def text_of(column: str = "text") -> F.Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def slices(texts: pa.Array, most: int = 1 << 20):
    """Row ranges of a string or binary array with about ``most`` bytes each (one row at least), so that arrays made per byte stay small."""
    import numpy as np

    bits = 64 if texts.type in (pa.large_string(), pa.large_binary()) else 32
    kind = np.int64 if bits == 64 else np.int32
    offsets = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1]
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, int(offsets[at]) + most, "right")) - 1)
        yield at, min(end, len(texts))
        at = end


def raw(texts: pa.Array):
    """(bytes, offsets from 0) of a string or binary array without nulls, as numpy views."""
    import numpy as np

    kind = np.int64 if texts.type in (pa.large_string(), pa.large_binary()) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]
