"""Token counts kept as delta-maintained rollups.

Every batch of changes (inserts, deletes and revised counts, each as signed rows)
is summed by source, language and tokenizer version, and added to the totals so
far.  The new totals and the batch's name appear as the next version by one
rename, once: a batch whose name is there already is left alone.  Readers read
the last version only, whatever the number of batches.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm import bpe, common
from eventloom.llm.library_coder import library_cache

GROUP = ("source", "lang", "tokenizer")
#: Tokenizer versions that the query counts by.
WORDS, BPE = "words@1", "byte_bpe_50k@1"
STEP_BYTES = 2 << 20


def count_tokens(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Tokens of every whole text by version: doc_id, source, lang, tokenizer, tokens.

    Two rows a document, ``words@1`` (words) and ``byte_bpe_50k@1`` (ids by the
    tokenizers library, without added ones).  A null or empty text has 0 tokens;
    repeated rows count each; null sources and languages stay null.
    """
    rows = docs.select("doc_id", "source", "lang", "text")
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("doc_id", "source", "lang"))

    def counted(batches: Iterator) -> Iterator:
        import pyarrow as pa

        cache = library_cache(tokenizer)
        for batch in common.pieces(batches, "text", STEP_BYTES):
            texts = [t or "" for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:3],
                    pa.array([len(t.encode().split()) for t in texts], pa.int64()),
                    pa.array([len(x) // 4 for x in cache.encode(texts)], pa.int64()),
                ],
                names=["doc_id", "source", "lang", "words", "ids"],
            )

    both = F.map_from_arrays(F.array(F.lit(WORDS), F.lit(BPE)), F.array("words", "ids"))
    return rows.mapInArrow(counted, f"{kinds}, words long, ids long").select("doc_id", "source", "lang", F.explode(both).alias("tokenizer", "tokens"))


def signed(rows: DataFrame, sign: int) -> DataFrame:
    """Counted rows as changes: 1 adds them, -1 takes them away."""
    return rows.withColumn("sign", F.lit(sign))


def revised(before: DataFrame, after: DataFrame) -> DataFrame:
    """Counts that are replaced: the old rows taken away and the new ones added."""
    columns = [*GROUP, "tokens"]
    return signed(before.select(columns), -1).unionByName(signed(after.select(columns), 1))


class Rollup:
    """Additive totals below a folder: a folder ``v-<n>`` for each version, with its ``totals`` and the ``names`` of all its batches."""

    SCHEMA = "source string, lang string, tokenizer string, documents long, tokens long"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path
        return path(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def version(self) -> int:
        """The number of committed versions."""
        fs, path = self._fs()
        if not fs.exists(path(self.path)):
            return 0
        names = (x.getPath().getName() for x in fs.listStatus(path(self.path)))
        return max((int(n[2:]) for n in names if n.startswith("v-")), default=0)

    def _read(self, version: int, part: str, schema: str) -> DataFrame:
        if not version:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/v-{version}/{part}")

    def committed(self, batch: str) -> bool:
        """Whether a batch of this name is in the totals."""
        return not self._read(self.version(), "names", "batch string").filter(F.col("batch") == batch).isEmpty()

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add a batch of signed rows (source, lang, tokenizer, tokens, sign).

        False, with nothing changed, if a batch of this name is there already.  The
        changes are summed once; when another commit takes the next version first,
        only the addition is done again, on top of it.  A run that was lost can be
        repeated.  A null count adds 0 tokens (and its sign to the documents).  An
        empty batch is committed too.  Of the versions before, the last one stays
        for readers that are under way.
        """
        if self.committed(batch):
            return False
        sums = changes.groupBy(*GROUP).agg(
            F.sum(F.col("sign").cast("long")).alias("documents"),
            F.sum(F.col("sign") * F.coalesce("tokens", F.lit(0))).cast("long").alias("tokens"),
        )
        sums = common.stored(sums, "batch")
        fs, path = self._fs()
        try:
            while not self.committed(batch):
                version, aside = self.version(), f"aside-{uuid.uuid4().hex}"
                every = self._read(version, "totals", self.SCHEMA).unionByName(sums).groupBy(*GROUP)
                every = every.agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens")).filter("documents != 0 OR tokens != 0")
                every.coalesce(1).write.parquet(f"{self.path}/{aside}/totals")
                names = self._read(version, "names", "batch string").unionByName(self.spark.createDataFrame([(batch,)], "batch string"))
                names.coalesce(1).write.parquet(f"{self.path}/{aside}/names")
                to = path(f"{self.path}/v-{version + 1}")
                # a rename onto a folder moves below it, where no reader looks
                if not fs.exists(to) and fs.rename(path(f"{self.path}/{aside}"), to) and not fs.exists(path(f"{self.path}/v-{version + 1}/{aside}")):
                    if version > 1:
                        fs.delete(path(f"{self.path}/v-{version - 1}"), True)
                    return True
                for lost in (f"{self.path}/{aside}", f"{self.path}/v-{version + 1}/{aside}"):
                    fs.delete(path(lost), True)
            return False
        finally:
            common.drop_stored(sums)

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, documents, tokens of all batches; groups that nothing is left of are gone."""
        return self._read(self.version(), "totals", self.SCHEMA)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals by source, language and tokenizer version of all ``documents`` that aren't withdrawn.

    All documents are inserted, first with their words as a guess of the BPE counts;
    the batch is delivered a second time, which changes nothing; then the guesses
    are revised to the true counts, and documents that ``labels`` calls toxic are
    deleted.
    """
    counted = common.stored(count_tokens(common.table(spark, sf_dir, "documents"), bpe.default_tokenizer()), "counted")
    words, ids = counted.filter(F.col("tokenizer") == WORDS), counted.filter(F.col("tokenizer") == BPE)
    guessed = words.withColumn("tokenizer", F.lit(BPE))
    toxic = common.table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id").distinct()
    rollup = Rollup(spark, common.new_path(spark, "rollup"))
    for _ in range(2):
        rollup.commit("insert-1", signed(words.unionByName(guessed), 1))
    rollup.commit("revise-1", revised(guessed, ids))
    rollup.commit("delete-1", signed(counted.join(toxic, "doc_id", "left_semi"), -1))
    common.drop_stored(counted)
    return rollup.totals()
