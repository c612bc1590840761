"""Helpers that the training-data operators share: tables, shared storage, words."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Hashable, Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a longest run of characters other than blank, \t, \n, \v, \f and \r.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read lazily through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where the setting is missing a temporary folder is made, which is only right
    with a local master; on a cluster that is an error.
    """
    conf = spark.sparkContext.getConf()
    if found := conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    own = getattr(spark.sparkContext, "_eventloom_dir", None)
    if own is None:
        if not conf.get("spark.master", "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        own = f"file://{tempfile.mkdtemp(prefix='eventloom-')}"
        spark.sparkContext._eventloom_dir = own
        spark.sparkContext.setCheckpointDir(own)
    return own


def new_path(spark: SparkSession, label: str) -> str:
    """An unused path below the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


#: What Spark bounds the bytes of Arrow batches by.
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def batches_of(spark: SparkSession, batch_bytes: int | None) -> Iterator[None]:
    """What runs inside gives Python workers Arrow batches of about ``batch_bytes``; None leaves the session's setting."""
    if batch_bytes is None:
        yield
        return
    before = spark.conf.get(_BATCH_BYTES, None)
    spark.conf.set(_BATCH_BYTES, batch_bytes)
    try:
        yield
    finally:
        spark.conf.unset(_BATCH_BYTES) if before is None else spark.conf.set(_BATCH_BYTES, before)


def stored(df: DataFrame, label: str, batch_bytes: int | None = None) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back.

    This cuts the lineage: what follows reads files that every executor can see,
    so a lost executor costs its running tasks and no finished work.  With
    ``batch_bytes`` Python workers get Arrow batches of about so many bytes, which
    bounds what executors and workers hold of long rows; else the session's setting holds.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    with batches_of(spark, batch_bytes):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.eventloom_path = path
    return out


def drop_stored(*frames: DataFrame) -> None:
    """Delete the files of ``stored`` frames that no plan reads any more."""
    for df in frames:
        jvm = df.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.eventloom_path)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def collect_garbage(spark: SparkSession) -> None:
    """Have executors collect garbage, so the heap that earlier stages made them take goes back to the system; a task a core."""
    cores = spark.sparkContext.defaultParallelism
    gone = F.java_method(F.lit("java.lang.System"), F.lit("gc"))
    spark.range(0, cores, 1, cores).select(gone.alias("gone")).write.format("noop").mode("overwrite").save()


def partitions(spark: SparkSession) -> int:
    """The session's shuffle partition count, which the cluster's owner sizes."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def word_count(text: Column) -> Column:
    """Number of words of a text, 0 for null; a JVM expression."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


#: The one cache that a Python worker process keeps between its tasks.
_KEPT: dict = {}


def kept(key: Hashable, make: Callable[[], Any]) -> Any:
    """What ``make`` gave for ``key``, kept in this worker process for later tasks.

    Only one key is kept: a task with another one lets the former's memory go, so
    stages that follow each other on one executor don't add up.
    """
    if key not in _KEPT:
        let_go()
        _KEPT[key] = make()
    return _KEPT[key]


def let_go() -> None:
    """Drop what this worker process keeps; for tasks that keep nothing and come after others that did."""
    if _KEPT:
        _KEPT.clear()
        gc.collect()
    trim()


def trim() -> None:
    """Hand memory that this worker process has freed back to the system; an idle worker else keeps it while others work."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:  # hand freed memory back where the C library can
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def pieces(batches: Iterator, column: str, most_bytes: int) -> Iterator:
    """Cut Arrow batches so that ``column`` of each cut holds about ``most_bytes``.

    A single longer value is a cut of its own; no value is ever divided.
    """
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        values = batch.column(batch.schema.get_field_index(column))
        n = batch.num_rows
        if n == 0:
            continue
        lengths = pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths, dtype=np.int64)
        start = 0
        while start < n:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + most_bytes, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
    trim()
