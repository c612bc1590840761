"""A corpus pipeline of five stages; each result is written before the next stage reads it.

1. ``quality``: documents that the quality rules reject go.
2. ``near_duplicates``: of each group of similar documents the first stays.
3. ``passages``: passages repeated from an earlier document are cut out.
4. ``mixture``: sources are mixed to their target weights, whole documents at a time.
5. ``tokens``: texts are encoded, decoded and digested.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm import bpe, common, mixing, passages, quality, set_join


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: rows of ``docs`` that pass the rules and the classifier."""
    return quality.keep_good(docs, quality.train(docs, common.table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: one row of each component of similar documents."""
    common.collect_garbage(spark)
    return set_join.first_of_each(docs)


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: texts without passages that an earlier document has."""
    common.collect_garbage(spark)
    return passages.without_passages(docs, passages.repeated_passages(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: rows as often as the mix takes them."""
    common.collect_garbage(spark)
    size = common.word_count(F.col("text"))
    return mixing.repeated(docs, mixing.mix(docs, size, ["doc_id"]), ["doc_id"], size)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: doc_id, lang, source, n_tokens, ids_sha256, decoded_sha256 and ids."""
    common.collect_garbage(spark)
    return bpe.encode_decode(docs, "text", ["doc_id", "lang", "source"], bpe.default_tokenizer(), give=("ids",))


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", drop_near_duplicates),
    ("passages", cut_passages),
    ("mixture", mix_sources),
    ("tokens", encode),
]
#: SQL can't express the classifier, the window hashes or the encoding; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what goes between them is stored in the shared folder."""
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
