"""In how many documents of a corpus each shingle of a document is.

Texts go into blocks.  Of every block the distinct shingles travel, packed by hash
bucket, to where the bucket's shingles are counted; the classes of their counts
come back and meet the block's texts, which never leave their block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm import common

#: Text of a block in UTF-8 bytes, a longer text is a block of its own; and the most documents of one.
BLOCK_BYTES, BLOCK_ROWS = 2 << 20, 1 << 16
#: Shingles of a bucket take about so many bytes in the worker that counts them.
BUCKET_BYTES = 32 << 20
#: Fewest buckets, so that small inputs use all cores too.
LEAST_BUCKETS = 64
#: A block's texts: their bytes, ids (null: 0 and not known), numbers that go with them, lengths, and the texts themselves.
BLOCK = "block long, size long, ids binary, known binary, extras binary, lengths binary, texts binary"


def blocks(docs: DataFrame, extra: str = "xxhash64(text)") -> DataFrame:
    """The texts of ``docs`` (doc_id, text: string or binary) in blocks, written once: that fixes what is in a block.

    ``extra`` is a number that goes with every text.
    """

    def packed(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard

        common.let_go()
        number, pack = TaskContext.get().partitionId() << 32, zstandard.ZstdCompressor(level=1)
        for batch in common.pieces(batches, "text", BLOCK_BYTES):
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                known = np.array(part.column(0).is_valid().to_pylist(), "u1")
                ids = part.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype("<i8")
                raw = [t.encode("utf-8", "replace") if isinstance(t, str) else t or b"" for t in part.column(1).to_pylist()]
                values = [number, sum(map(len, raw)), ids.tobytes(), known.tobytes(), part.column(2).to_numpy().astype("<i8").tobytes(), np.array([len(r) for r in raw], "<i8").tobytes(), pack.compress(b"".join(raw))]
                yield pa.RecordBatch.from_arrays([pa.array([v], pa.binary() if i > 1 else pa.int64()) for i, v in enumerate(values)], names=["block", "size", "ids", "known", "extras", "lengths", "texts"])
                number += 1

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.expr(extra).cast("long").alias("extra"))
    return common.stored(rows.mapInArrow(packed, BLOCK), "blocks", BLOCK_BYTES)


def bucket_count(texts: DataFrame) -> int:
    """Buckets by the bytes of all texts: a shingle takes about as many bytes as its first word."""
    total = texts.agg(F.sum("size")).first()[0]
    return max(LEAST_BUCKETS, -(-int(total or 0) // BUCKET_BYTES))


def raw_texts(lengths: bytes, texts: bytes) -> list[bytes]:
    """The texts of a block."""
    import zstandard

    raw, ends = zstandard.ZstdDecompressor().decompress(texts), np.cumsum(np.frombuffer(lengths, "<i8"))
    return [raw[e - k : e] for e, k in zip(ends.tolist(), np.frombuffer(lengths, "<i8").tolist())]


def by_bucket(distinct: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of sorted hashes by bucket, and where each bucket begins.

    The low half of a hash tells the bucket, so inside a bucket the high halves rise.
    """
    place = ((distinct & np.uint64(0xFFFFFFFF)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(place.astype(np.uint16) if buckets <= 1 << 16 else place, kind="stable")
    return order, np.searchsorted(place[order], np.arange(buckets + 1))


def rising_packed(values: np.ndarray, pack) -> bytes:
    """Rising unsigned 32-bit integers as the bytes of their gaps, the highest bytes of all first, compressed by ``pack``: near ones take fewer bytes."""
    gaps = np.diff(values, prepend=values.dtype.type(0)).astype("<u4")
    return pack.compress(gaps.view("u1").reshape(-1, 4)[:, ::-1].T.tobytes())


def rising_unpacked(packed: bytes, unpack) -> np.ndarray:
    """What ``rising_packed`` was given."""
    planes = np.frombuffer(unpack.decompress(packed), "u1").reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes[::-1].T).view("<u4").ravel(), dtype=np.uint32)


def _documents(values: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values and in how many of the rows of the given sizes each is."""
    distinct, back, times = np.unique(values, return_inverse=True, return_counts=True)
    some = np.flatnonzero(times[back] > 1)
    owner, number = np.repeat(np.arange(len(sizes)), sizes)[some], back[some]
    order = np.lexsort((owner, number))
    owner, number = owner[order], number[order]
    again = (owner[1:] == owner[:-1]) & (number[1:] == number[:-1])
    return distinct, times - np.bincount(number[1:][again], minlength=len(distinct))


def with_classes(texts: DataFrame, features: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], use: Callable, schema: str) -> DataFrame:
    """What ``use`` makes of every block of ``texts`` (from ``blocks``) and the classes of its shingles.

    ``features`` gives the shingles of texts, one text after the other, and each
    text's number.  ``use(ids, known, extras, values, sizes, classes)`` returns the
    columns of ``schema``; the class of a shingle is floor(log2) of the number of rows
    that have it, where a block counts as 255 rows at most.  Class 0
    is a shingle that nothing else has.  A chance of a few in a thousand gives a
    shingle too great a class, the same one wherever it is.
    """
    buckets = bucket_count(texts)

    def packed(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard

        common.let_go()
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for block, lengths, packed_texts in zip(*(batch.column(i).to_pylist() for i in range(3))):
                distinct, times = _documents(*features(raw_texts(lengths, packed_texts)))
                order, cuts = by_bucket(distinct, buckets)
                high, times = (distinct[order] >> np.uint64(32)).astype("<u4"), np.minimum(times[order], 255).astype("u1")
                used = np.flatnonzero(cuts[1:] > cuts[:-1]).tolist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(used, pa.int32()), pa.array([block] * len(used), pa.int64()), pa.array([rising_packed(high[cuts[b] : cuts[b + 1]], pack) for b in used], pa.binary()), pa.array([times[cuts[b] : cuts[b + 1]].tobytes() for b in used], pa.binary())],
                    names=["bucket", "block", "tokens", "times"],
                )

    def counted(group):
        import pyarrow as pa
        import zstandard

        times, unpack = group.column("times").to_pylist(), zstandard.ZstdDecompressor()
        tokens = np.concatenate([rising_unpacked(x, unpack) for x in group.column("tokens").to_pylist()])
        distinct, back = np.unique(tokens, return_inverse=True)
        sums = np.bincount(back, weights=np.concatenate([np.frombuffer(x, "u1") for x in times]), minlength=len(distinct))
        classes = np.log2(sums).astype("u1")[back]
        ends = np.cumsum([len(x) for x in times]).tolist()
        own = [classes[e - len(x) : e].tobytes() for e, x in zip(ends, times)]
        return pa.table({"block": group.column("block"), "bucket": group.column("bucket"), "classes": pa.array(own, pa.binary())})

    def used(group):
        import pyarrow as pa

        columns = {c: group.column(c).to_pylist() for c in group.column_names}
        head = columns["bucket"].index(-1)
        values, sizes = features(raw_texts(columns["lengths"][head], columns["texts"][head]))
        distinct, back = np.unique(values, return_inverse=True)
        order, _ = by_bucket(distinct, buckets)
        told = sorted((b, c) for b, c in zip(columns["bucket"], columns["classes"]) if b >= 0)
        classes = np.empty(len(distinct), "u1")
        if told:
            classes[order] = np.frombuffer(b"".join(c for _, c in told), "u1")
        ids, extras = (np.frombuffer(columns[c][head], "<i8") for c in ("ids", "extras"))
        return use(ids, np.frombuffer(columns["known"][head], "u1") > 0, extras, values, sizes, classes[back])

    sent = texts.select("block", "lengths", "texts").mapInArrow(packed, "bucket int, block long, tokens binary, times binary")
    back = sent.groupBy("bucket").applyInArrow(counted, "block long, bucket int, classes binary")
    heads = texts.withColumns({"bucket": F.lit(-1), "classes": F.lit(None).cast("binary")})
    return back.unionByName(heads, allowMissingColumns=True).groupBy("block").applyInArrow(used, schema)
