"""What the operators on texts hold and move."""

from collections.abc import Iterator

import numpy as np
from pyspark.sql import functions as F

from eventloom.llm import common, frequencies, passages

BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_batches_of_long_rows_are_bounded_in_bytes(spark):
    def sizes(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["n", "size"])

    before = spark.conf.get(BATCH_BYTES, None)
    rows = spark.range(0, 2000, 1, 1).selectExpr("repeat(cast(id % 10 AS string), 4000) AS text").mapInArrow(sizes, "n long, size long")
    got = common.stored(rows, "test", 1 << 20)
    seen = got.collect()
    common.drop_stored(got)
    assert sum(r.n for r in seen) == 2000 and max(r.size for r in seen) < 2 << 20
    assert spark.conf.get(BATCH_BYTES, None) == before


def test_hashes_of_a_bucket_travel_as_their_gaps():
    import zstandard

    pack, unpack = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
    hashes = np.unique(np.random.default_rng(1).integers(0, 1 << 64, 350_000, dtype=np.uint64))
    order, cuts = frequencies.by_bucket(hashes, 64)
    high = (hashes[order] >> np.uint64(32)).astype("<u4")
    sent = 0
    for a, b in zip(cuts[:-1], cuts[1:]):
        packed = frequencies.rising_packed(high[a:b], pack)
        assert (np.diff(high[a:b].astype(np.int64)) >= 0).all() and (frequencies.rising_unpacked(packed, unpack) == high[a:b]).all()
        sent += len(packed)
    assert sent < 0.75 * 4 * len(hashes)
    edges = np.array([0, 0, 5, 2**32 - 1, 2**32 - 1], "<u4")
    assert (frequencies.rising_unpacked(frequencies.rising_packed(edges, pack), unpack) == edges).all()


def test_a_round_asks_only_for_what_the_last_one_left(spark):
    columns = "doc_id long, hash long, key long, f int, p int, l int, r int"
    of = lambda *ids: [(d, h, k, 0, 50, 0, 100) for k, d, h in ids]
    alone = spark.createDataFrame(of((1, 1, 7), (1, 1, 8), (1, 2, 0), (1, 3, 0), (1, 4, 0), (2, 5, 0), (3, 1, 7), (3, 9, 0), (4, 6, 1), (4, 6, 2)), columns)
    ranked = passages.ranked(alone).cache()
    got = {(r.key, r.doc_id, r.hash): r["rank"] for r in ranked.collect()}
    # keys 2 and 4 are in one document each
    assert got == {(1, 1, 7): 0, (1, 1, 8): 1, (1, 2, 0): 1, (1, 3, 0): 1, (1, 4, 0): 2, (3, 1, 7): 0, (3, 9, 0): 2}
    first = passages.met(ranked.filter("rank = 0"))
    assert {(r.key, r.source_id, r.source_hash) for r in first.collect()} == {(1, 1, 7), (3, 1, 7)}
    rest = ranked.filter("rank = 1").drop("rank")
    runs = spark.createDataFrame([(2, 0, 0, 0, 100)], "doc_id long, hash long, cell long, a int, b int")
    ask = lambda windows, taken: {(r.doc_id, r.hash) for r in passages.candidates(windows, rest, taken, runs, 46).collect()}
    everything = ranked.drop("rank")
    assert ask(everything, None) == {(1, 8), (3, 0)}
    assert ask(everything.filter("doc_id <= 3"), None) == {(1, 8)}
    taken = spark.createDataFrame([(1, 1, 8)], "key long, doc_id long, hash long").select("key", F.struct("doc_id", "hash").alias("taken"))
    assert ask(everything, taken) == {(3, 0)}


def test_keys_without_more_documents_are_asked_no_more(spark):
    new = spark.createDataFrame([(1, 3, 0), (1, 4, 8), (1, 4, 7), (2, 5, 0)], "key long, source_id long, source_hash long")
    assert [(r.key, tuple(r.taken)) for r in passages.last_taken(new, 3).collect()] == [(1, (4, 8))]
    assert passages.last_taken(new, 4).isEmpty()


def test_a_round_reads_what_is_left_in_one_join(spark):
    windows = spark.createDataFrame([(d, 0, k, f, 50, 0, 100) for d in range(1, 9) for f, k in ((0, 1), (1, 2))], "doc_id long, hash long, key long, f int, p int, l int, r int")
    taken = spark.createDataFrame([(1, 3, 0)], "key long, doc_id long, hash long").select("key", F.struct("doc_id", "hash").alias("taken"))
    runs = spark.createDataFrame([(5, 0, 0, 0, 100)], "doc_id long, hash long, cell long, a int, b int")
    got = passages.candidates(windows, windows.drop("f"), taken, runs, 46)
    # key 2 has no more documents; a run holds the windows of document 5
    assert sorted((r.key, r.doc_id) for r in got.collect()) == [(1, 4), (1, 6), (1, 7)]
    # one with the keys that go on, one with the runs
    assert sum("Join" in line for line in got._jdf.queryExecution().optimizedPlan().toString().splitlines()) == 2
