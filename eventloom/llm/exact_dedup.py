"""Exact duplicates by content-defined chunk recipes, with DataFrame operations only.

1. A text is cut where its own content says so: at the first sentence or line end
   after ``LEAST_CHUNK`` characters, at ``MOST_CHUNK`` at the latest.  Every chunk gets
   an identifier of 16 bytes; the ordered identifiers of a text are its recipe.
   Recipes are made where the text is read; texts don't move.
2. Texts with different recipes differ.  The chunks of texts whose recipes meet are
   deduplicated by content, each task for itself before any is sent, and no two
   unlike chunks may have one identifier.  Should that happen, all is done again
   with other identifiers, so those that are used are verified.
3. Then equal recipes are equal texts: recipes are grouped, and every row gets its
   group's size and the row that stays.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm import common, hot

#: Characters of a chunk.
LEAST_CHUNK, MOST_CHUNK = 256, 2048
#: A chunk ends after one of these.
ENDS = r"[.!?\n\x{3002}\x{FF01}\x{FF1F}]"
#: Text hashes up to this many are broadcast (8 bytes each), beyond it the chunks of all texts are verified.
BROADCAST_HASHES = 1_000_000


def chunks(text: Column) -> Column:
    """The chunks of a text, which joined give the text; none of an empty one."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{{LEAST_CHUNK - 1},{MOST_CHUNK - 1}}}?{ENDS}|.{{1,{MOST_CHUNK}}}"), F.lit(0))


def identifier(chunk: Column, turn: int) -> Column:
    """32 hexadecimal digits for a chunk, others each ``turn``."""
    return F.md5(F.concat(F.lit(f"{turn}:"), chunk))


def whole(text: str = "text") -> Column:
    """What is cut: the text, "" for null; bytes that aren't UTF-8 as digits behind a mark, which ``recipes`` tells from such a text."""
    return F.when(F.is_valid_utf8(F.coalesce(F.col(text), F.lit(""))), F.coalesce(F.col(text), F.lit(""))).otherwise(F.hex(F.col(text).cast("binary")))


def recipes(docs: DataFrame, turn: int = 0, identify: Callable[[Column, int], Column] = identifier) -> DataFrame:
    """doc_id, number (of the row), text_hash, text_sha256 and recipe of every row of ``docs`` (doc_id, text), stored."""
    valid = F.is_valid_utf8(F.coalesce(F.col("text"), F.lit("")))
    found = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.monotonically_increasing_id().alias("number"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"),
        F.unhex(F.concat(F.when(valid, "00").otherwise("01"), F.array_join(F.transform(chunks(whole()), lambda c: identify(c, turn)), ""))).alias("recipe"),
    )
    return common.stored(found, "recipes")


def unlike_chunks(docs: DataFrame, found: DataFrame, turn: int, identify: Callable[[Column, int], Column]) -> DataFrame:
    """Identifiers that unlike chunks have, among the texts of repeated recipes; the chunks of a text move once at most."""
    repeated = found.groupBy("recipe").agg(F.count("*").alias("n"), F.min("text_hash").alias("lo"), F.max("text_hash").alias("hi")).filter("n > 1")
    hashes = common.stored(repeated.select(F.explode(F.array("lo", "hi")).alias("text_hash")).distinct(), "repeated-texts")
    texts = docs.select("text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    # unlike texts of one recipe may hide behind a third hash: then lo and hi differ, and the next turn begins anyway
    if hashes.count() <= BROADCAST_HASHES:
        texts = texts.join(F.broadcast(hashes), "text_hash", "left_semi")
    parts = texts.select(F.explode(chunks(whole())).alias("chunk")).select(identify(F.col("chunk"), turn).alias("id"), "chunk")
    return parts.groupBy("id", "chunk").agg(F.lit(1).alias("one")).groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id")


def groups_of_equals(docs: DataFrame, identify: Callable[[Column, int], Column] = identifier) -> DataFrame:
    """Every row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept and text_sha256.

    Texts are equal if they are the same bytes; null counts as empty.  Of equal
    texts the row of the largest ``doc_id`` stays (``keep_id``); a null doc_id is less
    than any, and of rows that tie one stays, all others are dropped.

    * Of rows alone in their group ``kept`` is true and ``group_size`` 1.
    * An empty table gives no rows; other columns are ignored.
    * Texts of any length are cut whole; a group of any share of the rows is summed
      before it moves and told to its rows by broadcast (``hot.attached``).
    """
    turn = 0
    while True:
        found = recipes(docs, turn, identify)
        if unlike_chunks(docs, found, turn, identify).isEmpty():
            break
        common.drop_stored(found)
        turn += 1
    top = F.max(F.struct("doc_id", "number")).alias("top")
    repeated = found.groupBy("recipe").agg(F.count("*").alias("n"), top).filter("n > 1")
    repeated = common.stored(repeated.select("recipe", "n", F.col("n").alias("group_size"), F.col("top.doc_id").alias("keep_id"), F.col("top.number").alias("top")), "copies")
    told = hot.attached(found, repeated, ["recipe"], found.count(), "left")
    one = F.col("group_size").isNull()
    return told.select(
        "doc_id",
        F.when(one, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (one | (F.col("number") == F.col("top"))).alias("kept"),
        "text_sha256",
    )


def without_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of equal texts, that of the largest doc_id; all columns stay.

    Rows are told apart by their place in ``docs``, so this joins on doc_id and
    text hash and takes one row where rows tie.
    """
    kept = groups_of_equals(docs).filter("kept").select(F.col("doc_id").alias("__eventloom_id"), F.col("text_sha256").alias("__eventloom_sha")).distinct()
    same = F.col("__eventloom_id").eqNullSafe(F.col("doc_id").cast("long")) & (F.col("__eventloom_sha") == F.sha2(F.coalesce("text", F.lit("")), 256))
    out = docs.withColumn("__eventloom_sha2", F.sha2(F.coalesce("text", F.lit("")), 256)).join(kept, same, "left_semi")
    return out.dropDuplicates(["doc_id", "__eventloom_sha2"]).drop("__eventloom_sha2")


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents``: doc_id, keep_id, group_size, kept, text_sha256."""
    return groups_of_equals(common.table(spark, sf_dir, "documents"))


SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, CAST(count(*) OVER same AS BIGINT) AS group_size,
  row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents) WINDOW same AS (PARTITION BY t)"""
