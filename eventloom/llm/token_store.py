"""Token ids in binary shards, each document compressed on its own with a shared dictionary.

Layout below one folder: ``dictionary`` (zstandard dictionary), ``manifest.json``
(id width, end id, sha256 of the dictionary), ``shard-NNNNNN.ids`` (a head with the
dictionary's sha256, then one zstandard frame a document) and ``index`` (Parquet:
doc_id, shard, offset, length, n_tokens and the place of the document's first id
in its shard).  Shards follow each other in ascending doc_id order.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
from collections.abc import Iterator

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventloom.llm import bpe, common
from eventloom.llm.library_coder import library_cache

#: Id that ends every document.
END_ID = 2
#: The dictionary is trained on a slice of this many documents at most, those of least hash of id and text,
MAX_SAMPLES = 1000
#: each of this many characters at most, from a place that the hash chooses, and has this many bytes at most.
SAMPLE_CHARS = 4000
DICTIONARY_BYTES = 64 << 10
LEVEL = 3
#: Text encoded at once, and bytes written at once.
STEP_BYTES = 2 << 20
_HEAD = "<8sI32s"
_MAGIC = b"EVIDS01\n"
_HEAD_BYTES = struct.calcsize(_HEAD)
INDEX_SCHEMA = "shard int, offset long, length long, n_tokens long, shard_start long"


def _open(path: str):
    """pyarrow's file system of a path or uri, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _put(path: str, data: bytes) -> None:
    """Write a small file so that it is there whole or not at all."""
    store, at = _open(path)
    name = f"{at}.{uuid.uuid4().hex}"
    with store.open_output_stream(name) as out:
        out.write(data)
    store.move(name, at)


def _get(path: str) -> bytes:
    store, at = _open(path)
    with store.open_input_stream(at) as f:
        return f.read()


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A zstandard dictionary of serialized id arrays; raw content if there are too few to train on."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[:size]


def _codec(dictionary: bytes):
    import zstandard

    shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return (
        zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_content_size=True),
        zstandard.ZstdDecompressor(dict_data=shared),
    )


def write_tokens(docs: DataFrame, path: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID) -> None:
    """Encode every whole text and write it, in ascending doc_id order, below ``path``.

    A null or empty text has the end id only.  Null ids come first; rows that share
    an id follow each other in the order of their texts.  An empty table gives an
    empty index.  Other columns are ignored.  Tasks write a shard under a name of
    their own and move it when it is whole, so a task that runs again replaces the
    shard by an equal one.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    width = "<u2" if len(bpe.Vocabulary(tokenizer).bytes) <= 1 << 16 and end_id < 1 << 16 else "<u4"
    drawn = rows.filter("doc_id IS NOT NULL AND text IS NOT NULL").withColumn("hash", F.xxhash64("doc_id", "text"))
    chosen = drawn.select("doc_id", "hash").distinct().orderBy("hash", "doc_id").limit(MAX_SAMPLES)
    at = F.pmod(F.col("hash"), F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(0)) + 1) + 1
    slices = drawn.select("doc_id", "hash", F.substr("text", at.cast("int"), F.lit(SAMPLE_CHARS)).alias("text"))
    sampled = slices.join(F.broadcast(chosen), ["doc_id", "hash"], "left_semi").dropDuplicates(["doc_id", "hash"]).select("text")

    def serialized(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        cache = library_cache(tokenizer)
        for batch in common.pieces(batches, "text", STEP_BYTES):
            ids = [np.frombuffer(x, "<u4").astype(width).tobytes() for x in cache.encode([t or "" for t in batch.column(0).to_pylist()])]
            yield pa.RecordBatch.from_pydict({"ids": pa.array(ids, pa.binary())})

    samples = sampled.mapInArrow(serialized, "ids binary").toArrow().column(0).to_pylist()
    dictionary = train_dictionary(sorted(samples))
    sha = hashlib.sha256(dictionary).digest()
    root = path.rstrip("/")
    store, at = _open(root)
    store.create_dir(at, recursive=True)
    _put(f"{root}/dictionary", dictionary)
    _put(f"{root}/manifest.json", json.dumps({"dtype": width, "end_id": end_id, "dictionary_sha256": sha.hex()}).encode())

    def written(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        cache, shard = library_cache(tokenizer), TaskContext.get().partitionId()
        pack, _ = _codec(dictionary)
        end = np.asarray([end_id], width).tobytes()
        files, base = _open(root)
        name, out, offset, start = f"{base}/.{uuid.uuid4().hex}", None, _HEAD_BYTES, 0
        for batch in common.pieces(batches, "text", STEP_BYTES):
            if out is None:
                out = files.open_output_stream(name)
                out.write(struct.pack(_HEAD, _MAGIC, shard, sha))
            arrays = [np.frombuffer(x, "<u4").astype(width).tobytes() + end for x in cache.encode([t or "" for t in batch.column(1).to_pylist()])]
            frames = [pack.compress(x) for x in arrays]
            lengths, counts = [len(x) for x in frames], [len(x) // np.dtype(width).itemsize for x in arrays]
            ends, sums = np.cumsum(lengths, dtype=np.int64), np.cumsum(counts, dtype=np.int64)
            out.write(b"".join(frames))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([shard] * len(frames), pa.int32()),
                    pa.array(offset + ends - lengths, pa.int64()),
                    pa.array(lengths, pa.int64()),
                    pa.array(counts, pa.int64()),
                    pa.array(start + sums - counts, pa.int64()),
                ],
                names=["doc_id", "shard", "offset", "length", "n_tokens", "shard_start"],
            )
            offset, start = offset + int(ends[-1]), start + int(sums[-1])
        if out is not None:
            out.close()
            files.move(name, f"{base}/shard-{shard:06d}.ids")

    ranged = rows.repartitionByRange(common.partitions(spark), F.col("doc_id"), F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    ranged.mapInArrow(written, f"doc_id {kind}, {INDEX_SCHEMA}").write.parquet(f"{root}/index")


def index(spark: SparkSession, path: str) -> DataFrame:
    """The index of a written folder with ``start``, the ids of all documents before each."""
    found = spark.read.parquet(f"{path.rstrip('/')}/index")
    sums = found.groupBy("shard").agg(F.sum("n_tokens").alias("_n"))  # one row a shard
    before = F.coalesce(F.sum("_n").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return found.join(sums.select("shard", before.alias("_before")), "shard").withColumn("start", F.col("_before") + F.col("shard_start")).drop("_before")


def read_tokens(spark: SparkSession, path: str, chosen: DataFrame | None = None) -> DataFrame:
    """Read documents back from their shards: doc_id, start, n_tokens, ids (binary, uint32 little-endian).

    ``chosen`` (doc_id) reads those documents alone, each by its own frame.
    """
    rows = index(spark, path)
    if chosen is not None:
        rows = rows.join(chosen.select("doc_id").distinct(), "doc_id", "left_semi")
    rows = rows.select("doc_id", "shard", "offset", "length", "start", "n_tokens")
    kind, root = rows.schema["doc_id"].dataType.simpleString(), path.rstrip("/")

    def fetched(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        said, dictionary = json.loads(_get(f"{root}/manifest.json")), _get(f"{root}/dictionary")
        if hashlib.sha256(dictionary).hexdigest() != said["dictionary_sha256"]:
            raise ValueError(f"{root}: the dictionary isn't the one that its manifest names")
        _, unpack = _codec(dictionary)
        files, base = _open(root)
        shard, f = None, None
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                ids = []
                for number, offset, length in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                    if number != shard:
                        if f is not None:
                            f.close()
                        shard, f = number, files.open_input_file(f"{base}/shard-{number:06d}.ids")
                        if f.read_at(_HEAD_BYTES, 0) != struct.pack(_HEAD, _MAGIC, number, bytes.fromhex(said["dictionary_sha256"])):
                            raise ValueError(f"{root}: shard {number} has another head than expected")
                    ids.append(np.frombuffer(unpack.decompress(f.read_at(length, offset)), said["dtype"]).astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(4), batch.column(5), pa.array(ids, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])
        if f is not None:
            f.close()

    return rows.mapInArrow(fetched, f"doc_id {kind}, start long, n_tokens long, ids binary")


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` written as token ids and read back: doc_id, start, n_tokens, ids_crc32."""
    path = common.new_path(spark, "tokens")
    write_tokens(common.table(spark, sf_dir, "documents"), path, bpe.default_tokenizer())
    # crc32 of Spark is the same unsigned CRC-32 as zlib's
    return read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
