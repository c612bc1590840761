"""Text documents written by executors: a folder of whole documents, or parts that become one file.

Rows are texts in their order.  Executors write part files in that order; for a
single file the parts' bytes are then copied one after the other between the
document's head and tail, by the file system that the path names and a block at
a time, so no row reaches the driver's Python and nothing is held whole.
"""

from __future__ import annotations

import gzip
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = 1 << 20


def file_system(spark: SparkSession, path: str):
    """The file system of a path and the path, as Hadoop's objects."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def write_documents(rows: DataFrame, folder: str, head: str, tail: str, between: str = "") -> None:
    """A folder in which every part of ``rows`` (one text column) is a whole document."""

    def documents(batches: Iterator) -> Iterator:
        import pyarrow as pa

        first = True
        told = lambda texts: pa.RecordBatch.from_pydict({"value": pa.array(texts, pa.string())})
        for batch in batches:
            texts = batch.column(0).to_pylist()
            if texts:
                texts = [*([head] if first else []), (between if not first else "") + texts[0], *(between + x for x in texts[1:])]
                first = False
                yield told(texts)
        if not first:
            yield told([tail])

    rows.mapInArrow(documents, "value string").write.mode("overwrite").text(folder)


def write_file(sections: list[tuple[str, DataFrame | None, str]], path: str, tail: str) -> None:
    """One file (gzip if it ends in ``.gz``) of sections: a head, rows (one text column, in order) and what stands between rows; then ``tail``.

    Parts lie beside the file until they are copied; the file appears under its
    name when it is whole.  Where nothing stands between rows, executors zip their
    parts, and the file is made of several gzip members.
    """
    frames = [rows for _, rows, _ in sections if rows is not None]
    spark = frames[0].sparkSession
    jvm = spark.sparkContext._jvm
    fs, at = file_system(spark, path)
    folder = f"{path}.parts-{uuid.uuid4().hex}"
    _, parts = file_system(spark, folder)
    made = jvm.org.apache.hadoop.fs.Path(parts, "whole")
    members = path.endswith(".gz") and not any(between for _, _, between in sections)
    inner = lambda text: bytearray(gzip.compress(text.encode()) if members else text.encode())
    try:
        for i, (_, rows, between) in enumerate(sections):
            if rows is not None:
                rows.select(F.concat(F.lit(between), F.col(rows.columns[0])).alias("value")).write.text(f"{folder}/{i}", compression="gzip" if members else "none")
        out = fs.create(made, True)
        out = jvm.java.util.zip.GZIPOutputStream(out) if path.endswith(".gz") and not members else out
        for i, (head, rows, between) in enumerate(sections):
            out.write(inner(head))
            skip = len(between.encode())  # none stands before the first row
            if rows is None:
                continue
            for name in sorted(s.getPath().getName() for s in fs.listStatus(jvm.org.apache.hadoop.fs.Path(f"{folder}/{i}")) if s.getPath().getName().startswith("part-")):
                part = fs.open(jvm.org.apache.hadoop.fs.Path(f"{folder}/{i}/{name}"))
                if skip and part.available():
                    part.seek(skip)
                    skip = 0
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, BLOCK, False)
                part.close()
        out.write(inner(tail))
        out.close()
        fs.delete(at, False)
        if not fs.rename(made, at):
            raise OSError(f"can't name {path}")
    finally:
        fs.delete(parts, True)


def texts(rows: DataFrame, tell: Callable, *columns: str) -> DataFrame:
    """``tell(row)`` of every row, in order, as one text column; made in executors, a batch at a time."""

    def told(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_pydict({"value": pa.array([tell(r) for r in batch.to_pylist()], pa.string())})

    return rows.select(*columns or rows.columns).mapInArrow(told, "value string")
