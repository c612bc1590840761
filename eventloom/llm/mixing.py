"""Mixing sources to target weights, with DataFrame operations only.

Every row gets a hash-random key; rows are range-sorted by (source, key); running
token counts are built from per-range sums and sums inside a range; each source is
cut at its exact budget after as many whole epochs as the budget holds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventloom.llm import common

#: Weights of the sources in code point order (null last), repeating.
WEIGHTS = (5, 2, 1)
#: A source gives at most this many times its own size.
MOST_EPOCHS = 3
#: Keys up to this many are broadcast (some 20 bytes each), more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Changes every hash-random order.
SEED = "mix-1"


def source_targets(sizes: DataFrame, source: str, weights: Sequence[int], most: int) -> DataFrame:
    """Targets of the sources of ``sizes`` (source, source_size): one row a source.

    The sources share the total by weight; a target above ``most`` times its
    source's size stops there and the excess is shared again by weight.  That
    fixed point is min(most * size, level * weight), found here in one pass over
    the sources in the order in which a rising level fills them.  All sums are of
    integers, so a target is one rounded division.
    """
    order = W.orderBy(F.col(source).asc_nulls_last())
    n = len(weights)
    numbered = sizes.withColumn("_i", F.row_number().over(order) - 1).withColumn(
        "_w", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("_i") % n + 1).cast("int")).cast("long")
    )
    every = W.partitionBy()
    # filled first: the least size for each unit of weight
    rising = W.orderBy((F.col("source_size") / F.col("_w")), F.col("_i"))
    before = rising.rowsBetween(W.unboundedPreceding, -1)
    level = numbered.withColumns(
        {
            "_left": F.sum("source_size").over(every) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0)),
            "_weights": F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0)),
        }
    )
    # with all before it full, is this one full too?  Once one is not, none after it is.
    level = level.withColumn("_full", most * F.col("source_size") * F.col("_weights") <= F.col("_left") * F.col("_w"))
    first = W.orderBy((F.col("source_size") / F.col("_w")), F.col("_i")).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    level = level.withColumns(
        {
            "_l": F.first(F.when(~F.col("_full"), F.col("_left")), ignorenulls=True).over(first),
            "_s": F.first(F.when(~F.col("_full"), F.col("_weights")), ignorenulls=True).over(first),
        }
    )
    target = F.when(F.col("_full"), (most * F.col("source_size")).cast("double")).otherwise(
        (F.col("_l") * F.col("_w")).cast("double") / F.col("_s")
    )
    return level.select(source, "source_size", target.alias("target"))


def mix(
    rows: DataFrame,
    size: Column,
    keys: Sequence[str],
    source: str = "source",
    weights: Sequence[int] = WEIGHTS,
    most: int = MOST_EPOCHS,
    seed: str = SEED,
) -> DataFrame:
    """Tokens that a weighted mix takes of every row.

    Returns ``keys``, ``source``, size, source_size, target (double) and taken:
    whole epochs times the size, and of the rest of the budget what the row's
    place in its source's random order leaves, so the taken tokens of a source
    add up to its target rounded to an integer.

    * A null size is not expected (``word_count`` gives 0 for null texts); a null
      source is a source of its own, the last in order.
    * The order in a source is by md5 of seed and keys, then by keys and size, so
      reruns agree and rows that tie are alike in everything returned.
    * Sources of no tokens have target 0; an empty table gives no rows.
    * A source of any share of the rows is spread over ranges of the random key;
      only per-range sums (one row a range and source) meet in one task.
    """
    spark = rows.sparkSession
    key = F.md5(F.concat_ws("\x00", F.lit(seed), *[F.coalesce(F.col(k).cast("string"), F.lit("\x01")) for k in keys]))
    thin = rows.select(*keys, F.col(source).alias("_source"), size.alias("size"), key.alias("_key"))
    order = ["_source", "_key", *keys, "size"]
    ranged = thin.repartitionByRange(common.partitions(spark), *order).withColumn("_range", F.spark_partition_id())
    ranged = common.stored(ranged, "mix-ranges")
    by_range = ranged.groupBy("_source", "_range").agg(F.sum("size").alias("_sum"))
    sizes = by_range.groupBy("_source").agg(F.sum("_sum").alias("source_size"))
    plan = source_targets(sizes.withColumnRenamed("_source", source), source, weights, most).withColumnRenamed(source, "_source")
    starts = by_range.select(
        "_source",
        "_range",
        F.coalesce(
            F.sum("_sum").over(W.partitionBy("_source").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
        ).alias("_start"),
    )
    starts = starts.join(plan.withColumnRenamed("_source", "_planned"), F.col("_source").eqNullSafe(F.col("_planned"))).drop("_planned")
    starts = starts.select(F.col("_source").alias("_s"), F.col("_range").alias("_r"), "_start", "source_size", "target")
    inside = W.partitionBy("_source", "_range").orderBy("_key", *keys, "size").rowsBetween(W.unboundedPreceding, -1)
    placed = ranged.withColumn("_before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(starts, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_range") == F.col("_r")))
    budget = F.floor(F.col("target") + 0.5)
    whole = F.when(F.col("source_size") > 0, F.expr("CAST(floor(target + 0.5) AS BIGINT) div source_size")).otherwise(0)
    rest = budget - whole * F.col("source_size") - F.col("_start") - F.col("_before")
    taken = whole * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest))
    return placed.select(*keys, F.col("_source").alias(source), "size", "source_size", "target", taken.cast("long").alias("taken"))


def repeated(rows: DataFrame, mixed: DataFrame, keys: Sequence[str], size: Column | None = None) -> DataFrame:
    """Rows of ``rows`` as often as the mix takes them, whole.

    Null is a key like another.  ``keys`` must tell the rows of ``rows`` apart,
    unless ``size`` is given as in ``mix``: then rows of equal keys and source are
    told apart by size, and those alike in all of them get one share of the mix
    each.  The row in which a budget ends is given whole in that epoch; rows that
    the mix takes nothing of are left out.
    """
    times = F.when(F.col("size") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    if size is None:
        on = {k: f"__eventloom_{i}" for i, k in enumerate(keys)}
    else:
        source = next(c for c in mixed.columns if c not in (*keys, "size", "source_size", "target", "taken"))
        on = {k: f"__eventloom_{i}" for i, k in enumerate([*keys, source, "__eventloom_size"])}
        mixed, rows = mixed.withColumn("__eventloom_size", F.col("size")), rows.withColumn("__eventloom_size", size)
    often = common.stored(mixed.select(*[F.col(k).alias(a) for k, a in on.items()], times.alias("__eventloom_times")), "times")
    if size is not None and not often.groupBy(*on.values()).count().filter("count > 1").isEmpty():
        often = often.withColumn("__eventloom_n", F.row_number().over(W.partitionBy(*on.values()).orderBy(F.desc("__eventloom_times"))))
        rows = rows.withColumn("__eventloom_m", F.row_number().over(W.partitionBy(*on).orderBy(F.xxhash64(*rows.columns))))
        on["__eventloom_m"] = "__eventloom_n"
    often = often.filter("__eventloom_times > 0")
    if often.count() <= BROADCAST_ROWS:
        often = F.broadcast(often)
    same = [F.col(k).eqNullSafe(F.col(a)) for k, a in on.items()]
    joined = rows.join(often, same).withColumn("__eventloom_copy", F.explode(F.sequence(F.lit(1), F.col("__eventloom_times"))))
    return joined.drop("__eventloom_copy", "__eventloom_times", "__eventloom_size", "__eventloom_m", *on.values())


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` mixed: doc_id, size, source_size, target, taken (source follows)."""
    docs = common.table(spark, sf_dir, "documents")
    out = mix(docs, common.word_count(F.col("text")), ["doc_id"])
    return out.select("doc_id", "size", "source_size", "target", "taken", "source")


SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, source, coalesce(length(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
  md5('{SEED}' || chr(0) || coalesce(CAST(doc_id AS VARCHAR), chr(1))) AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
  CAST([{", ".join(map(str, WEIGHTS))}][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)}] AS BIGINT) AS w FROM d GROUP BY source),
-- reshare until no target is above its stop: capped holds the sources that stopped
r AS (SELECT 0 AS round, source, source_size, w, false AS capped FROM s
  UNION ALL
  SELECT round + 1, source, source_size, w, capped OR {MOST_EPOCHS} * source_size * free <= rest * w FROM (
    SELECT *, sum(source_size) OVER () - sum(CASE WHEN capped THEN {MOST_EPOCHS} * source_size ELSE 0 END) OVER () AS rest,
      sum(CASE WHEN capped THEN 0 ELSE w END) OVER () AS free FROM r) WHERE round < 40),
f AS (SELECT source, source_size, CASE WHEN capped THEN CAST({MOST_EPOCHS} * source_size AS DOUBLE) ELSE
  CAST((sum(source_size) OVER () - sum(CASE WHEN capped THEN {MOST_EPOCHS} * source_size ELSE 0 END) OVER ()) * w AS DOUBLE)
  / CAST(sum(CASE WHEN capped THEN 0 ELSE w END) OVER () AS DOUBLE) END AS target FROM r WHERE round = 40),
p AS (SELECT d.doc_id, d.source, size, source_size, target, CAST(floor(target + 0.5) AS BIGINT) AS budget,
  coalesce(CAST(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS before
  FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CASE WHEN source_size = 0 THEN 0 ELSE CAST(
  (budget // source_size) * size + greatest(0, least(size, budget % source_size - before)) AS BIGINT) END AS taken, source FROM p"""
