"""The trie of conversations' prefixes by prefix-doubling names.

1. Turns are numbered along their conversation by a range sort with offsets, and
   conversations are rebuilt on the turns of the first of their twenty.
2. Blocks of 1, 2, 4, ... turns that begin at multiples of their length get dense
   names, equal for equal blocks: a block is named by the names of its two halves, so
   that each round of a join has half the rows of the one before.
3. A prefix of d turns is the sequence of the blocks that the binary digits of d
   give, from the greatest; going down the levels each prefix takes the name of
   one more block where its digit is set.  Prefixes of equal length and names are
   one node.
4. A node is known by its smallest member.  What a conversation's nodes add to
   the subtrees above them is a running sum along the conversation, summed over
   the members of each node; so no node's subtree is ever gathered.

Turns are compared by the SHA-256 of role and text, and texts never move.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventloom.llm import common, hot

#: Conversations of so many ids in a row share the first turns of the first of them, up to one fewer than the other number.
FAMILY, MOST_SHARED = 20, 4
#: Turns of a conversation that one task sums.
SEGMENT = 4096
#: Ids of a node's ends that are joined into one text at a time.
ENDS = 65_536


def numbered(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """``rows`` with pos, their place from 1 in ``group`` by ``order`` (nulls first), stored.

    Rows are range-sorted by all of these, so a group of any size is spread over
    ranges; only a row a group and range meets in one task.
    """
    ranged = rows.repartitionByRange(common.partitions(rows.sparkSession), group, *order).withColumn("_range", F.spark_partition_id())
    ranged = common.stored(ranged, "turn-ranges")
    counts = ranged.groupBy(group, "_range").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy(group).orderBy("_range").rowsBetween(W.unboundedPreceding, -1))
    starts = counts.withColumn("_start", F.coalesce(before, F.lit(0))).drop("_n")
    inside = F.row_number().over(W.partitionBy(group, "_range").orderBy(*order))
    out = common.stored(ranged.withColumn("_row", inside).join(starts, [group, "_range"]).withColumn("pos", F.col("_start") + F.col("_row")).drop("_range", "_row", "_start"), "turns")
    common.drop_stored(ranged)
    return out


def dense_names(rows: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """``rows`` (stored) with ``name`` in place of ``keys``: numbers from 0 without gaps, equal for equal keys; stored."""
    counted = rows.groupBy(*keys).agg(F.count("*").alias("n")).withColumn("_at", F.monotonically_increasing_id())
    counted = common.stored(counted, "names")  # the number holds the task and the row in it; stored, they stay
    task, row = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = counted.groupBy(task.alias("_task")).agg(F.count("*").alias("_n"), F.sum("n").alias("_rows"))
    starts = sizes.select("_task", F.coalesce(F.sum("_n").over(W.orderBy("_task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    total = sizes.agg(F.sum("_rows")).first()[0] or 0
    # a row a task of the step before
    names = counted.withColumn("_task", task).join(F.broadcast(starts), "_task").select(*keys, "n", (F.col("_start") + row).alias(name))
    out = common.stored(hot.attached(rows, names, keys, total).drop(*keys), "named")
    common.drop_stored(counted)
    return out


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rebuilt conversations of ``turns`` (conv_id, turn, digest, words): their turns (conv_id, i from 0, digest, words) and all (conv_id, n_turns); both stored.

    With h the unsigned crc32 of the decimal conv_id modulo 4, conversation c is the
    first h turns of conversation c - c % 20, then its own turns after its first h.
    """
    own = numbered(turns, "conv_id", ["turn", "digest", "words"])
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST_SHARED
    heads = own.filter(F.col("pos") < MOST_SHARED).select(F.col("conv_id").alias("base"), F.col("pos").alias("at"), F.col("digest").alias("d"), F.col("words").alias("w"))
    convs = own.groupBy("conv_id").agg(F.count("*").alias("n_own")).withColumn("h", head).withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY)
    convs = common.stored(convs, "conversations")
    lengths = heads.groupBy("base").agg(F.count("*").alias("n_base"))
    # FAMILY conversations at most ask for one base
    shared = convs.join(heads, "base").filter("at <= h").select("conv_id", (F.col("at") - 1).alias("i"), F.col("d").alias("digest"), F.col("w").alias("words"))
    convs = convs.join(lengths, "base", "left").withColumn("given", F.least("h", F.coalesce("n_base", F.lit(0))))
    after = F.greatest(F.col("n_own") - F.col("h"), F.lit(0))
    whole = common.stored(convs.select("conv_id", (F.col("given") + after).alias("n_turns"), (F.col("h") - F.col("given")).alias("less"), "h"), "rebuilt")
    rest = own.join(whole.select("conv_id", "less", "h"), "conv_id").filter(F.col("pos") > F.col("h")).select("conv_id", (F.col("pos") - F.col("less") - 1).alias("i"), "digest", "words")
    return common.stored(shared.unionByName(rest), "rebuilt-turns"), whole.select("conv_id", "n_turns")


def named_prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, depth and names of every prefix of one turn or more of ``turns`` (conv_id, i, digest), stored."""
    level = dense_names(turns.select("conv_id", "i", "digest"), ["digest"], "name")
    levels = [level]
    while not level.filter("i > 0").isEmpty():  # each round has half the rows
        left = level.filter("i % 2 = 0").select("conv_id", F.shiftright("i", 1).alias("i"), F.col("name").alias("left"))
        right = level.filter("i % 2 = 1").select("conv_id", F.shiftright("i", 1).alias("i"), F.col("name").alias("right"))
        pairs = common.stored(left.join(right, ["conv_id", "i"]), "blocks")
        level = dense_names(pairs, ["left", "right"], "name")
        common.drop_stored(pairs)
        levels.append(level)
    # prefixes of j blocks of a level, from the greatest; j = 0 is the root
    found = None
    for level in reversed(levels):
        ends = level.filter("i % 2 = 0").select("conv_id", F.shiftright("i", 1).alias("j"), "name")
        if found is None:
            grown = ends.select("conv_id", (2 * F.col("j") + 1).alias("j"), F.array("name").alias("names"))
        else:
            one = ends.join(found, ["conv_id", "j"], "left").select("conv_id", (2 * F.col("j") + 1).alias("j"), F.concat(F.coalesce("names", F.array().cast("array<long>")), F.array("name")).alias("names"))
            grown = found.withColumn("j", 2 * F.col("j")).unionByName(one)
        before, found = found, common.stored(grown, "prefixes")
        if before is not None:
            common.drop_stored(before)
    common.drop_stored(*levels)
    out = common.stored(found.select("conv_id", F.col("j").alias("depth"), "names"), "prefixes")
    common.drop_stored(found)
    return out


def ends_digests(ends: DataFrame) -> DataFrame:
    """top, depth and ends_sha256 of the nodes at which ``ends`` (top, depth, conv_id) end: of their ids in order, joined by commas.

    Ids are range-sorted and joined a range at a time; a digest needs its node's texts in
    order, so these, and not the ids, are read by one task, one after the other.
    """
    n = common.partitions(ends.sparkSession)

    def joined(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = ["top", "depth", "first", "ids"]
        key, first, ids = None, None, []

        def out():
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()), pa.array([first], pa.int64()), pa.array([",".join(map(str, ids))])], names=names)

        for batch in batches:
            for top, depth, conv in zip(*(c.to_pylist() for c in batch.columns)):
                if key != (top, depth) or len(ids) >= ENDS:
                    if key is not None:
                        yield out()
                    key, first, ids = (top, depth), conv, []
                ids.append(conv)
        if key is not None:
            yield out()

    def digested(batches: Iterator) -> Iterator:
        import pyarrow as pa

        rows, key, state = [], None, None

        def out():
            done = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))], names=["top", "depth", "ends_sha256"])
            rows.clear()
            return done

        for batch in batches:
            for top, depth, ids in zip(*(batch.column(c).to_pylist() for c in (0, 1, 3))):
                if key == (top, depth):
                    state.update(b"," + ids.encode())
                    continue
                if key is not None:
                    rows.append((*key, state.hexdigest()))
                key, state = (top, depth), hashlib.sha256(ids.encode())
            yield out()
        if key is not None:
            rows.append((*key, state.hexdigest()))
            yield out()

    ranged = ends.select("top", "depth", "conv_id").repartitionByRange(n, "top", "depth", "conv_id").sortWithinPartitions("top", "depth", "conv_id")
    texts = ranged.mapInArrow(joined, "top long, depth long, first long, ids string")
    return texts.repartition(n, "top", "depth").sortWithinPartitions("top", "depth", "first").mapInArrow(digested, "top long, depth long, ends_sha256 string")


def trie(rows: DataFrame) -> DataFrame:
    """The nodes of the rebuilt conversations of ``rows`` (conv_id, turn, role, text): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A node is a distinct sequence of (role, text), its members the conversations that
    start with it; ``conv_id`` is the smallest member and, with depth, names the node.

    * Turns are ordered by ``turn``, null first; those that tie by the SHA-256 of role
      and text, so repeated rows are turns of their own.  Null role or text is empty.
    * Rows of null conv_id belong to no conversation and are left out.
    * No conversation, no row: an empty table has no root.  Other columns are ignored.
    * A conversation, a turn or a node may have any share of the rows: places and sums
      along a conversation are made by ranges and segments, names of hot turns are broadcast.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    thin = rows.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"), common.word_count(F.col("text")).alias("words"))
    turns, convs = rebuilt(thin)
    prefixes = named_prefixes(turns)
    key = ["depth", "names"]
    above = prefixes.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("names").alias("parent"))
    words = turns.select("conv_id", (F.col("i") + 1).alias("depth"), "words")
    # rows of a conversation and a depth meet once
    paths = prefixes.join(words, ["conv_id", "depth"]).join(above, ["conv_id", "depth"], "left").withColumn("parent", F.coalesce("parent", F.array().cast("array<long>")))
    paths = common.stored(paths, "paths")
    common.drop_stored(prefixes)
    nodes = paths.groupBy(*key).agg(F.count("*").alias("n"), F.min("conv_id").alias("top"), F.max("words").alias("words"), F.max("parent").alias("parent"))
    nodes = common.stored(nodes, "nodes")
    children = nodes.groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("names")).agg(F.count("*").alias("n_children"))
    family = nodes.select(*key, "n", F.col("n").alias("n_convs"), "top", F.col("words").alias("node_words")).join(children, key, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    family = common.stored(family, "families")
    total = paths.count()
    members = common.stored(hot.attached(paths.drop("parent", "words"), family, key, total), "members").drop("names")
    # what the nodes that a conversation is the smallest member of add to those above: they are the last of its path
    own = F.col("conv_id") == F.col("top")
    value = members.select("conv_id", "depth", "top", F.floor((F.col("depth") - 1) / SEGMENT).alias("segment"), (own & (F.col("n_children") == 0)).cast("long").alias("leaf"), F.when(own, (F.col("n_convs") - 1) * F.col("node_words")).otherwise(F.lit(0)).alias("saved"))
    sums = value.groupBy("conv_id", "segment").agg(F.sum("leaf").alias("later_leaves"), F.sum("saved").alias("later_saved"))
    later = W.partitionBy("conv_id").orderBy(F.desc("segment")).rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("conv_id", "segment", *(F.coalesce(F.sum(c).over(later), F.lit(0)).alias(c) for c in ("later_leaves", "later_saved")))
    inside = W.partitionBy("conv_id", "segment").orderBy(F.desc("depth")).rowsBetween(W.unboundedPreceding, 0)
    below = value.withColumns({c: F.sum(c).over(inside) for c in ("leaf", "saved")}).join(sums, ["conv_id", "segment"])
    totals = below.groupBy("top", "depth").agg(F.sum(F.col("leaf") + F.col("later_leaves")).alias("n_leaves"), F.sum(F.col("saved") + F.col("later_saved")).alias("saved_tokens"))
    facts = members.filter(own).select("top", "depth", "n_convs", "n_children")
    # a parent's smallest member is that of the row above on the smallest member's path
    parents = members.select(F.col("conv_id").alias("top"), (F.col("depth") + 1).alias("depth"), F.col("top").alias("parent_conv_id"))
    ends = members.join(convs.filter("n_turns > 0"), (members["conv_id"] == convs["conv_id"]) & (members["depth"] == convs["n_turns"])).select("top", "depth", members["conv_id"])
    root = common.stored(convs.agg(F.min("conv_id").alias("top"), F.count("*").alias("n_convs")), "root")
    top = root.first()[0]
    digests = common.stored(ends_digests(ends.unionByName(convs.filter("n_turns = 0").select(F.lit(top).cast("long").alias("top"), F.lit(0).cast("long").alias("depth"), "conv_id"))), "ends")
    deep = facts.join(totals, ["top", "depth"]).join(parents, ["top", "depth"], "left").withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.lit(top)).otherwise(F.col("parent_conv_id")))
    deep = common.stored(deep, "deep")
    whole = deep.filter("depth = 1").agg(F.count("*").alias("n_children"), F.coalesce(F.sum("n_leaves"), F.lit(1)).alias("n_leaves"), F.coalesce(F.sum("saved_tokens"), F.lit(0)).alias("saved_tokens"))
    start = root.filter("top IS NOT NULL").crossJoin(whole).withColumns({"depth": F.lit(0).cast("long"), "parent_conv_id": F.lit(None).cast("long")})  # one row
    every = deep.unionByName(start).join(digests, ["top", "depth"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())))
    return every.select(F.col("top").alias("conv_id"), "depth", "parent_conv_id", *(F.col(c).cast("long").alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")), "ends_sha256")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all ``conversations``."""
    return trie(common.table(spark, sf_dir, "conversations"))


SQL = rf"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos FROM conversations WHERE conv_id IS NOT NULL),
-- crc32 bit by bit: a number from 0 on is a byte to take in, -1 a bit to shift out
c AS (SELECT conv_id, xor(4294967295, list_reduce(list_concat([4294967295], flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: [ord(x), -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)) % {MOST_SHARED} AS h FROM (SELECT DISTINCT conv_id FROM t)),
b AS (SELECT c.conv_id, t.pos, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % {FAMILY} AND t.pos <= c.h
  UNION ALL SELECT t.conv_id, t.pos, t.role, t.text FROM t JOIN c ON c.conv_id = t.conv_id AND t.pos > c.h),
l AS (SELECT c.conv_id, list(CASE WHEN b.pos IS NULL THEN NULL ELSE [b.role, b.text] END ORDER BY b.pos) FILTER (b.pos IS NOT NULL) AS ts FROM c LEFT JOIN b ON b.conv_id = c.conv_id GROUP BY c.conv_id),
p AS (SELECT conv_id, d, coalesce(len(ts), 0) AS n, coalesce(ts, [])[1 : d] AS k FROM (SELECT *, unnest(range(0, coalesce(len(ts), 0) + 1)) AS d FROM l)),
n AS (SELECT d, k, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = d), '') AS ends,
  CASE WHEN d = 0 THEN 0 ELSE length(regexp_extract_all(k[d][2], '[^\x20\x09-\x0D]+')) END AS words FROM p GROUP BY d, k),
f AS (SELECT d, k, count(*) AS n_children FROM (SELECT d - 1 AS d, k[1 : d - 1] AS k FROM n WHERE d > 0) GROUP BY d, k),
m AS (SELECT n.*, coalesce(f.n_children, 0) AS n_children FROM n LEFT JOIN f ON f.d = n.d AND f.k = n.k),
-- every node once for each node above it and for itself
u AS (SELECT g AS d, k[1 : g] AS k, n_children, (n_convs - 1) * words AS saved FROM (SELECT *, unnest(range(0, d + 1)) AS g FROM m)),
s AS (SELECT d, k, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(saved) AS saved FROM u GROUP BY d, k)
SELECT m.conv_id, m.d AS depth, q.conv_id AS parent_conv_id, m.n_convs, m.n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(m.ends) AS ends_sha256
FROM m JOIN s ON s.d = m.d AND s.k = m.k LEFT JOIN m q ON q.d = m.d - 1 AND q.k = m.k[1 : m.d - 1]"""
