"""Exact n-gram Jaccard join of documents by grouped prefixes.

1. One pass over the texts counts how many of a document's shingles any other
   document has.  A partner at similarity t shares at least the part t of either
   set, so all documents below that are done.
2. Documents with equal sets become one class.
3. Shingles are ordered by the rising number of classes that have them (its power
   of two, then the hash).  Two sets of similarity t share a shingle in their prefixes of
   |x| - ceil(t|x|) + 1.  Classes with the same prefix and size are collapsed into
   one group.
4. For each prefix shingle the groups, and the members of each group, are first
   verified against one pivot of like size, a few times against other ones, which
   joins almost all that belongs together in as many checks as there are members.  Then pairs of groups that
   share a prefix shingle, pass the filters by size and position and aren't in one
   component yet are expanded to members of unlike components, which are verified
   too, so no link between components is lost.  Groups of one member are first
   held against each other by the parities of their shingles' hashes, which bound
   in how many shingles the sets differ.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm import common, frequencies
from eventloom.llm.components import components
from eventloom.llm.shingles import shingle_sets

#: Words of a shingle, and least similarity of a link as a fraction of integers.
N, T_NUM, T_DEN = 5, 75, 100
#: Ids up to this many are broadcast (8 bytes each), more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Times that rows are compared with pivots before all pairs of components are.
PIVOT_TURNS = 3
#: Bits of a set's parities.
BITS = 256
#: Packed rows are handled about this many bytes at a time.
STEP_BYTES = 4 << 20


def _set_features(raw: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingle sets of texts, one after the other, and their sizes."""
    sets = shingle_sets(raw, n)
    return np.concatenate(sets) if sets else np.empty(0, np.uint64), np.array([len(s) for s in sets], np.int64)


def shared_sets(docs: DataFrame, n: int) -> DataFrame:
    """Every row of ``docs``: doc_id and size (of its set); and of those that may have partners cid and tokens.

    ``cid`` is equal for equal sets; ``tokens`` are the shingles that other rows have too, packed.
    """

    def found(ids, known, extras, values, sizes, classes):
        import pyarrow as pa

        ends = np.cumsum(sizes)
        upto = np.concatenate(([0], np.cumsum(classes > 0)))
        shared = upto[ends] - upto[ends - sizes]
        some = known & (sizes > 0) & (T_DEN * shared >= T_NUM * sizes)
        cids, tokens = [None] * len(sizes), [None] * len(sizes)
        for i in np.flatnonzero(some).tolist():
            part = slice(int(ends[i] - sizes[i]), int(ends[i]))
            cids[i] = int.from_bytes(hashlib.blake2b(values[part].tobytes(), digest_size=8).digest(), "little", signed=True)
            tokens[i] = values[part][classes[part] > 0].tobytes()
        return pa.table({"doc_id": pa.array(ids, pa.int64(), mask=~known), "size": pa.array(sizes, pa.int64()), "cid": pa.array(cids, pa.int64()), "tokens": pa.array(tokens, pa.binary())})

    texts = frequencies.blocks(docs)
    out = common.stored(frequencies.with_classes(texts, partial(_set_features, n=n), found, "doc_id long, size long, cid long, tokens binary"), "sets", STEP_BYTES)
    common.drop_stored(texts)
    return out


def _token_features(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Packed shingles, one set after the other, and their sizes."""
    return np.frombuffer(b"".join(raw), "<u8").astype(np.uint64), np.array([len(r) // 8 for r in raw], np.int64)


def parities(tokens: np.ndarray) -> list[int]:
    """For each of ``BITS`` hash values whether an odd number of shingles has it, packed in longs."""
    odd = np.bincount((tokens >> np.uint64(20)).astype(np.int64) % BITS, minlength=BITS).astype(np.uint8) & 1
    return np.packbits(odd).view("<i8").tolist()


def prefixes(sets: DataFrame) -> DataFrame:
    """The prefixes of ``sets`` (id, size, tokens): id, size, group, prefix, skipped, n_tokens and bits.

    ``group`` is equal for equal prefix and size; ``prefix`` has those of the
    prefix's shingles that other sets have too, in order; ``skipped`` others stand
    before them.  ``bits`` are the tokens' ``parities``.
    """

    def found(ids, known, extras, values, sizes, classes):
        import pyarrow as pa

        columns: list[list] = [[], [], [], [], []]
        ends = np.cumsum(sizes).tolist()
        for cid, size, end, n in zip(ids.tolist(), extras.tolist(), ends, sizes.tolist()):
            own, rank = values[end - n : end], classes[end - n : end]
            # shingles that no other row has stand first; they aren't among the tokens
            length = max(0, size - -(-T_NUM * size // T_DEN) + 1 - (size - n))
            first = np.lexsort((own, rank))[:length]
            alone = int((rank[first] == 0).sum())
            key = own[first].tobytes() if n == size else cid.to_bytes(8, "little", signed=True)
            columns[0].append(hashlib.blake2b(key + size.to_bytes(8, "little"), digest_size=16).digest())
            columns[1].append(own[first][alone:].view("<i8"))
            columns[2].append(size - n + alone)
            columns[3].append(n)
            columns[4].append(parities(own))
        kinds = {"group": pa.binary(), "prefix": pa.list_(pa.int64()), "skipped": pa.int32(), "n_tokens": pa.int32(), "bits": pa.list_(pa.int64())}
        return pa.table({"id": pa.array(ids, pa.int64()), "size": pa.array(extras, pa.int64()), **{k: pa.array(c, t) for (k, t), c in zip(kinds.items(), columns)}})

    packed = frequencies.blocks(sets.select(F.col("id").alias("doc_id"), F.col("tokens").alias("text"), "size"), "size")
    out = common.stored(frequencies.with_classes(packed, _token_features, found, "id long, size long, group binary, prefix array<long>, skipped int, n_tokens int, bits array<long>"), "prefixes", STEP_BYTES)
    common.drop_stored(packed)
    return out


def entries(rows: DataFrame, *more: str) -> DataFrame:
    """The prefix shingles of rows: token, pos (in the whole prefix), id, size and ``more``."""
    return rows.select("id", "size", "skipped", *more, F.posexplode("prefix").alias("pos", "token")).select("token", (F.col("pos") + F.col("skipped")).alias("pos"), "id", "size", *more)


def may_be_similar(size: Column, pos: Column, other_size: Column, other_pos: Column) -> Column:
    """What sizes and places of a shingle allow, were it the first that two sets have in common."""
    alike = T_DEN * F.least(size, other_size) >= T_NUM * F.greatest(size, other_size)
    most = F.least(size - pos, other_size - other_pos)
    return alike & ((T_NUM + T_DEN) * most >= T_NUM * (size + other_size))


def pivot_pairs(rows: DataFrame, turn: int = 0) -> DataFrame:
    """Pairs (a, b) of each row (id, size, prefix, skipped, label) and a pivot that has the shingle, a size of the same band and another label.

    The greatest size of a band is under 4/3 of the least.  The first turn takes as
    few pivots as it can; every other ``turn`` takes other ones, and another one for
    each shingle, so that rows that the pivots before missed meet many.
    """
    drawn = F.xxhash64("id", F.lit(turn), *(["token"] if turn else []))
    every = entries(rows, "label").withColumn("band", F.floor(F.log(F.col("size").cast("double")) / F.log(F.lit(T_DEN / T_NUM))))
    pivot = F.min(F.struct(drawn.alias("h"), "id", "size", "pos", "label")).alias("p")
    pivots = every.groupBy("token", "band").agg(pivot, F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo != hi").drop("lo", "hi")
    met = every.join(pivots, ["token", "band"]).filter(F.col("label") != F.col("p.label"))
    return met.filter(may_be_similar(F.col("size"), F.col("pos"), F.col("p.size"), F.col("p.pos"))).select(F.least("p.id", "id").alias("a"), F.greatest("p.id", "id").alias("b")).distinct()


def joined(labelled: DataFrame, links: DataFrame) -> DataFrame:
    """``labelled`` (id, leader, label) with the labels of ``links`` (a, b) made one, stored."""
    of = labelled.select("id", "label")
    edges = links.join(of.toDF("a", "la"), "a").join(of.toDF("b", "lb"), "b").select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct()
    above = components(edges).select(F.col("id").alias("label"), F.col("label").alias("top"))
    return common.stored(labelled.join(above, "label", "left").select("id", "leader", F.coalesce("top", "label").alias("label")), "labels")


def near_enough(size: Column, n_tokens: Column, bits: Column, other_size: Column, other_n: Column, other_bits: Column) -> Column:
    """What parities of two sets' shingles allow: where they differ, one of the sets has a shingle that the other lacks.

    Shingles that aren't among the tokens no other set has.
    """
    apart = reduce(lambda a, b: a + b, (F.bit_count(bits[i].bitwiseXOR(other_bits[i])) for i in range(BITS // 64)))
    return (T_NUM + T_DEN) * (apart + size - n_tokens + other_size - other_n) <= (T_DEN - T_NUM) * (size + other_size)


def group_pairs(groups: DataFrame) -> DataFrame:
    """Pairs (a, b) of groups (id, size, prefix, skipped, n_tokens, bits, members, lo and hi: least and greatest label of their members) that may link components.

    Of two members with unlike labels one hasn't the label that a shingle's groups
    are compared with.  The least label is that of the largest component as often
    as its share of the groups, so what is paired with all is mostly little.
    """
    every = entries(groups, "lo", "hi", "n_tokens", "bits", "members")
    mixed = every.groupBy("token").agg(F.min("lo").alias("usual"), F.max("hi").alias("top")).filter("usual < top").select("token", "usual")
    every = every.join(mixed, "token").withColumn("odd", (F.col("lo") != F.col("usual")) | (F.col("hi") != F.col("usual")))
    x, y = every.filter("odd").alias("x"), every.alias("y")
    met = x.join(y, F.col("x.token") == F.col("y.token")).filter("x.id != y.id AND (NOT y.odd OR x.id < y.id) AND NOT (x.lo = x.hi AND y.lo = y.hi AND x.lo = y.lo)")
    met = met.filter(may_be_similar(F.col("x.size"), F.col("x.pos"), F.col("y.size"), F.col("y.pos")))
    one = (F.col("x.members") == 1) & (F.col("y.members") == 1)
    met = met.filter(~one | near_enough(*(F.col(f"{t}.{c}") for t in "xy" for c in ("size", "n_tokens", "bits"))))
    inside = groups.filter("lo < hi").select(F.col("id").alias("a"), F.col("id").alias("b"))
    return met.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct().unionByName(inside)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of ``sets`` (id, size, tokens) that are similar enough."""
    left = sets.select(F.col("id").alias("a"), F.col("size").alias("m"), F.col("tokens").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("size").alias("n"), F.col("tokens").alias("y"))

    def checked(batches: Iterator) -> Iterator:
        import pyarrow as pa

        common.let_go()
        for batch in common.pieces(batches, "x", STEP_BYTES):
            good = []
            for m, x, n, y in zip(*(batch.column(i).to_pylist() for i in range(2, 6))):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                small, large = (x, y) if len(x) <= len(y) else (y, x)
                both = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
                good.append(T_DEN * both >= T_NUM * (m + n - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "m", "x", "n", "y").mapInArrow(checked, "a long, b long")


def similar_components(docs: DataFrame, n: int = N) -> DataFrame:
    """Components of documents linked by a Jaccard similarity of their shingle sets of 0.75 or more.

    Returns a row for every row of ``docs`` (doc_id, text): doc_id, n_shingles and
    component_id, the smallest doc_id that links lead to.

    * A null or empty text, or one without words, has an empty set and no link.
    * Rows that share a doc_id count as one document with the links of each.
    * A null doc_id is linked with nothing and gets a null component.
    * An empty table gives no rows; other columns are ignored.
    * Sets hold 64-bit hashes of shingles.
    """
    every = shared_sets(docs, n)
    own = every.filter("cid IS NOT NULL")
    ids = common.stored(own.select("doc_id", "cid").distinct(), "classes")
    sets = common.stored(own.select(F.col("cid").alias("id"), "size", "tokens").dropDuplicates(["id"]), "sets")
    counts = common.stored(every.select("doc_id", F.col("size").alias("n_shingles")), "counts")
    common.drop_stored(every)
    # rows of one doc_id with unlike sets hold together
    same = ids.join(ids.groupBy("doc_id").agg(F.min("cid").alias("a"), F.max("cid").alias("z")).filter("a != z"), "doc_id").filter("cid != a").select("a", F.col("cid").alias("b"))
    ordered = prefixes(sets)
    leaders = ordered.groupBy("group").agg(F.min("id").alias("leader"))
    members = common.stored(ordered.select("id", "group").join(leaders, "group").select("id", "leader"), "groups")
    heads = ordered.join(members.filter("id = leader").select("id"), "id", "left_semi")
    inside = members.filter("id != leader").select(F.col("leader").alias("a"), F.col("id").alias("b"))
    alone = members.withColumn("label", F.col("id"))
    with_labels = lambda frame: heads.join(frame.select("id", "label"), "id")
    links = common.stored(verified(pivot_pairs(with_labels(alone)).unionByName(inside).distinct(), sets).unionByName(same), "links", STEP_BYTES)
    labelled = joined(alone, links)
    for turn in range(1, PIVOT_TURNS):
        more = common.stored(verified(pivot_pairs(with_labels(labelled), turn), sets), "links", STEP_BYTES)
        before, labelled = labelled, joined(labelled, more)
        common.drop_stored(before, more)
    bounds = labelled.groupBy(F.col("leader").alias("id")).agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("members"))
    pairs = group_pairs(heads.join(bounds, "id"))
    one = labelled.select(F.col("leader").alias("a"), F.col("id").alias("u"), F.col("label").alias("lu"))
    other = labelled.select(F.col("leader").alias("b"), F.col("id").alias("v"), F.col("label").alias("lv"))
    met = pairs.join(one, "a").join(other, "b").filter("lu != lv AND (a != b OR u < v)")
    last = joined(labelled, verified(met.select(F.col("u").alias("a"), F.col("v").alias("b")), sets))
    final = last.select(F.col("id").alias("cid"), F.col("label").alias("top"))
    tops = ids.join(final, "cid").select("doc_id", "top")
    least = tops.groupBy("top").agg(F.min("doc_id").alias("component_id"))
    moved = tops.join(least, "top").filter("doc_id != component_id").select("doc_id", "component_id").distinct()
    moved = common.stored(moved, "moved")
    common.drop_stored(sets, ordered, links, ids, members, labelled, last)
    out = counts.join(F.broadcast(moved) if moved.count() <= BROADCAST_IDS else moved, "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def first_of_each(docs: DataFrame, n: int = N) -> DataFrame:
    """``docs`` with one row of each component, that of the smallest doc_id; all columns stay.

    Rows that share a doc_id are one document, of which one row stays.  Rows
    without words or without a doc_id are linked with nothing and stay.
    """
    found = common.stored(similar_components(docs, n), "components")
    gone = found.filter("component_id != doc_id").select("doc_id").distinct()
    twice = found.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    gone, twice = common.stored(gone, "gone"), common.stored(twice, "twice")
    out = docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, "doc_id", "left_anti")
    if twice.isEmpty():
        return out
    return out.join(twice, "doc_id", "left_anti").unionByName(out.join(twice, "doc_id", "left_semi").dropDuplicates(["doc_id"]))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents``: doc_id, n_shingles, component_id."""
    return similar_components(common.table(spark, sf_dir, "documents"))


SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN length(ws) = 0 OR ws IS NULL THEN [] WHEN length(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, length(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
x AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b USING (g) WHERE a.doc_id != b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM x JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE {T_DEN} * i >= {T_NUM} * (na.n + nb.n - i)),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.c)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, min(c) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY doc_id, n.n"""
