"""What tasks and stages leave behind in executors and workers."""

import pyarrow as pa
import pytest

import corpus_pipeline
from eventloom.llm import bpe, common, mixing, passages, quality, set_join


def test_garbage_is_collected_where_tasks_run(spark):
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    runs = lambda: sum(b.getCollectionCount() for b in beans)
    before = runs()
    common.collect_garbage(spark)
    assert runs() > before


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES[1:]])
def test_stages_begin_with_what_others_left_collected(spark, monkeypatch, stage):
    told = []
    monkeypatch.setattr(common, "collect_garbage", lambda spark: told.append("collected"))
    for module, names in ((quality, ("train", "keep_good")), (set_join, ("first_of_each",)), (passages, ("repeated_passages", "without_passages")), (mixing, ("mix", "repeated")), (bpe, ("encode_decode",))):
        for name in names:
            monkeypatch.setattr(module, name, lambda *a, name=name, **b: told.append(name))
    stage(spark, None, "")
    assert told[0] == "collected" and len(told) > 1


def test_workers_hand_memory_back_after_their_last_batch(monkeypatch):
    told = []
    monkeypatch.setattr(common, "trim", lambda: told.append("trimmed"))
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 10] * 8)], names=["text"])
    seen = []
    for cut in common.pieces(iter([batch]), "text", 30):
        assert not told
        seen.append(cut.num_rows)
    assert seen == [3, 3, 2] and told == ["trimmed"]


def test_counting_gets_batches_bounded_in_bytes(spark, monkeypatch):
    asked, real = [], common.batches_of
    monkeypatch.setattr(common, "batches_of", lambda spark, most: asked.append(most) or real(spark, most))
    texts = spark.createDataFrame([("one two two",), (None,)], "text string")
    assert bpe.frequent_pieces(texts, "text", 10, "") == [b" two"] and asked == [bpe.STEP_BYTES]
