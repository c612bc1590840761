"""Passages that documents repeat, found by compact windows over min-hashes.

Under one hash function all stretches of a text that share the position of their
least hash form one compact window; the windows are the nodes of the Cartesian
tree over the hashes, and those wide enough for a passage are few.  Stretches of
two documents with equal least hash meet at equal window keys.

1. A shingle's hashes are those of a weighted min-hash: the more documents have
   it, the more rarely it is the least, and one that no other document has never
   is.  Common phrases so make few keys.
2. A stretch as wide as the shortest passage in which too many shingles are in no
   other document can't be similar enough to one of as many shingles; windows
   without any other stretch are left out, and so are documents without windows.
3. Every window meets the first document of its key.  Where windows of enough
   functions towards one document lie over each other, the stretch is a
   candidate, which is verified shingle by shingle and cut to what is repeated.
4. A window is done when almost all of its shared shingles are inside verified
   passages.  A window that a source has word by word tells nothing that its
   source doesn't tell, and is a source no more; a done window that differs from
   its source, as near copies do, still is one for windows that aren't done.
   Step 3 follows for the next documents of their keys, more of them each
   round, until no window that isn't done has an earlier one that it hasn't met.

Rows of equal texts are one document for all this, that of the smallest doc_id;
the others repeat it as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventloom.llm import common, frequencies, hot
from eventloom.llm.set_join import N, T_DEN, T_NUM
from eventloom.llm.shingles import mixed, shingle_rows

#: Words of the shortest passage.
LEAST_WORDS = 50
#: Hash functions, and how many of them must agree on a stretch.  Equal passages
#: agree on all; at a similarity of 0.75 two of five agree with probability 0.98.
FUNCTIONS, AGREE = 5, 2
#: Matching shingles this far apart may belong to one passage; the similarity decides.
MOST_GAP = 24
#: Documents with spans up to this many are broadcast (about 100 bytes each), more are joined by a shuffle.
BROADCAST_SPANS = 200_000
#: Packed rows are handled about this many bytes at a time.
STEP_BYTES = 4 << 20
_INDEX_BITS = 28
#: A window: key, function, place of the least hash, first and last shingle.
WINDOW = [("key", "<i8"), ("f", "<i4"), ("p", "<i4"), ("l", "<i4"), ("r", "<i4")]
PASSAGE = "doc_id long, hash long, source_id long, start_word long, end_word long, source_start long, source_end long, similarity double, runs array<struct<a:int,b:int>>"
#: When so few keys are open that they are broadcast (16 bytes each, 40 after the first round), the candidates' windows aren't shuffled for them.
FEW_KEYS = 50_000
#: Each round of step 4 takes this many times as many documents of a key as the one before.
ROUND_GROWTH = 64
#: Places of windows are compared by cells of so many shingles.
CELL = 64
#: Windows of one key are joined in parts of about this many; hot keys up to so many are broadcast (12 bytes each).
KEY_PART, BROADCAST_KEYS = 5_000, 1_000_000


def least_shared(width: int) -> int:
    """Shingles that a stretch of ``width`` has in common with another of as many at least, to be similar enough."""
    return -(-2 * T_NUM * width // (T_NUM + T_DEN))


def compact_windows(values: np.ndarray, sizes: np.ndarray, width: int, functions: int = FUNCTIONS, classes: np.ndarray | None = None) -> list[tuple[np.ndarray, ...]]:
    """Compact windows of at least ``width`` shingles, by function: (row, place, first, last, key).

    ``values`` holds the shingles of rows of the given sizes.  Places count within
    the row.  Ties go to the leftmost of equal hashes.  With ``classes`` hashes are
    exponential variates with the rate 2**-class, and infinite for class 0.
    """
    # rows stand one after the other with a guard, less than every hash, before each and at the end
    starts = np.cumsum(sizes + 1) - sizes
    total = int(sizes.sum()) + len(sizes) + 1
    guard = np.zeros(total, bool)
    guard[starts - 1] = guard[total - 1] = True
    place, mask = np.arange(total, dtype=np.uint64), np.uint64((1 << _INDEX_BITS) - 1)
    out = []
    for f in range(functions):
        hashes, spread = np.zeros(total, np.uint64), mixed(values + np.uint64(0xD1B54A32D192ED03 * (f + 1) & 0xFFFFFFFFFFFFFFFF))
        hashes[~guard] = spread
        ranks = hashes
        if classes is not None:
            rate = np.where(classes > 0, np.exp2(-classes.astype(np.float64)), 0)
            with np.errstate(divide="ignore"):
                variate = -np.log(((spread >> np.uint64(11)) + np.float64(0.5)) / 2.0**53) / rate
            ranks = np.zeros(total, np.uint64)
            ranks[~guard] = variate.view(np.uint64)  # positive numbers are in the order of their bits
        order = (ranks & ~mask) | place
        if classes is not None:
            order[~guard] &= np.where(classes > 0, ~np.uint64(0), ~mask)  # those of class 0 are one run, which isn't real
        order[guard] = place[guard]
        least, reach = order, 1
        while reach * 2 <= width and len(least) > reach:
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        if (more := width - reach) and len(least) > more:
            least = np.minimum(least[:-more], least[more:])
        if total < width:
            least = order[:0]
        first = np.flatnonzero(np.append(True, least[1:] != least[:-1])) if len(least) else np.empty(0, np.int64)
        last = np.append(first[1:], len(least)) - 1 if len(first) else first
        at = (least[first] & mask).astype(np.int64)
        # a window that goes on beyond the width ends at the next candidate that is less
        left, right = _smaller(least[first].tolist(), at.tolist(), total)
        lo = np.where(first > at - width + 1, first, np.asarray(left, np.int64) + 1)
        hi = np.where(last < at, last + width - 1, np.asarray(right, np.int64) - 1)
        real = ~guard[at]
        at, lo, hi = at[real], lo[real], hi[real]
        row = np.searchsorted(starts, at, side="right") - 1
        out.append((row, at - starts[row], lo - starts[row], hi - starts[row], mixed(hashes[at] ^ np.uint64(f + 1))))
    return out


def _smaller(keys: list[int], places: list[int], end: int) -> tuple[list[int], list[int]]:
    """Places of the nearest smaller keys on the left and on the right."""
    left, right, stack = [-1] * len(keys), [end] * len(keys), []
    for i, k in enumerate(keys):
        while stack and keys[stack[-1]] > k:
            right[stack.pop()] = places[i]
        if stack:
            left[i] = places[stack[-1]]
        stack.append(i)
    return left, right


def repeating(texts: DataFrame, n: int, least_words: int, functions: int) -> DataFrame:
    """Documents with stretches that may be repeated: doc_id, hash (of the text), tokens, shared and windows, all packed.

    ``tokens`` are the shingles, as unsigned 32-bit integers; ``shared`` a bit for each: it is in
    a stretch that may be repeated, and in another document; ``windows`` are ``WINDOW``s.
    """
    width = least_words - n + 1
    least = least_shared(width)

    def found(ids, known, hashes, values, sizes, classes):
        import pyarrow as pa

        ends = np.cumsum(sizes)
        total = int(sizes.sum())
        upto = np.concatenate(([0], np.cumsum(classes > 0)))
        # the first places of stretches with enough shared shingles
        dense = np.zeros(total + 1, np.int64)
        if total >= width:
            dense[: total - width + 1] = upto[width:] - upto[:-width] >= least
        inside = np.arange(total) + width <= np.repeat(ends, sizes)
        dense[:-1] &= inside
        before = np.concatenate(([0], np.cumsum(dense)))
        some = (before[ends] > before[ends - sizes]) & known
        chosen = np.repeat(some, sizes)
        step = np.concatenate((dense[:-1], np.zeros(width, np.int64)))
        step[width:] -= dense[:-1]
        shared = (np.cumsum(step)[:total] > 0) & (classes > 0)
        rows = np.flatnonzero(some)
        values, classes, shared, dense, sizes = values[chosen], classes[chosen], shared[chosen], dense[:-1][chosen], sizes[some]
        before, first = np.concatenate(([0], np.cumsum(dense))), np.cumsum(sizes) - sizes
        packed: list[list[np.ndarray]] = [[] for _ in rows]
        for f, (row, place, lo, hi, key) in enumerate(compact_windows(values, sizes, width, functions, classes)):
            at = first[row]
            # a stretch with enough shared shingles must hold the place itself
            real = np.flatnonzero(before[at + np.minimum(hi - width + 1, place) + 1] > before[at + np.maximum(lo, place - width + 1)])
            own = np.zeros(len(real), WINDOW)
            own["key"], own["f"], own["p"], own["l"], own["r"] = key[real].view("<i8"), f, place[real], lo[real], hi[real]
            cuts = np.searchsorted(row[real], np.arange(len(rows) + 1))
            for k in range(len(rows)):
                packed[k].append(own[cuts[k] : cuts[k + 1]])
        tokens, spans = values.astype("<u4"), list(zip(first.tolist(), (first + sizes).tolist()))
        columns = ([tokens[a:b].tobytes() for a, b in spans], [np.packbits(shared[a:b]).tobytes() for a, b in spans], [np.concatenate(x).tobytes() for x in packed])
        return pa.table({"doc_id": pa.array(ids[rows]), "hash": pa.array(hashes[rows]), **{k: pa.array(c, pa.binary()) for k, c in zip(("tokens", "shared", "windows"), columns)}})

    return frequencies.with_classes(texts, partial(shingle_rows, n=n), found, "doc_id long, hash long, tokens binary, shared binary, windows binary")


def overlaid(anchors: np.ndarray, width: int, agree: int) -> list[tuple[int, int, int, int]]:
    """Stretches of at least ``width`` shingles over which windows of ``agree`` functions lie: first, last, source's first, source's last.

    ``anchors`` has a row a window: function, first, last, source's first, source's last.
    """
    start, end, out = int(anchors[:, 1].min()), int(anchors[:, 2].max()), []
    over = np.zeros(end - start + 2, np.int64)
    for f in np.unique(anchors[:, 0]):
        mine, step = anchors[anchors[:, 0] == f], np.zeros(end - start + 2, np.int64)
        np.add.at(step, mine[:, 1] - start, 1)
        np.add.at(step, mine[:, 2] + 1 - start, -1)
        over += np.cumsum(step) > 0
    edge = np.flatnonzero(np.diff(np.concatenate(([False], over[:-1] >= agree, [False])).astype(np.int8)))
    for lo, hi in zip((edge[::2] + start).tolist(), (edge[1::2] - 1 + start).tolist()):
        if hi - lo + 1 >= width:
            near = anchors[(anchors[:, 1] <= hi) & (anchors[:, 2] >= lo)]
            out.append((lo, hi, int(near[:, 3].min()), int(near[:, 4].max())))
    return out


def matched(own: np.ndarray, other: np.ndarray, width: int) -> list[tuple[int, int, int, int, float, np.ndarray]]:
    """Stretches of ``own`` that repeat a stretch of ``other``: first, last, other's first, other's last, similarity, and the places in ``own`` that match."""
    return [x[:6] for x in matched_places(own, other, width)]


def matched_places(own: np.ndarray, other: np.ndarray, width: int) -> list[tuple[int, int, int, int, float, np.ndarray, np.ndarray]]:
    """``matched``, with the places in ``other`` that match, too.

    Matching shingles at most ``MOST_GAP`` apart make a stretch; it counts from
    ``width`` shingles and a similarity of 0.75 on, and is divided at its widest
    gap until it does or is too short.
    """
    least = -(-T_NUM * width // T_DEN)  # what similarity needs of the shortest stretch
    order = np.argsort(other, kind="stable")
    ranked = other[order]
    at = np.minimum(np.searchsorted(ranked, own), len(ranked) - 1) if len(ranked) else np.zeros(len(own), np.int64)
    hits = np.flatnonzero(ranked[at] == own) if len(ranked) else np.empty(0, np.int64)
    if len(hits) < least:
        return []
    there = order[at[hits]]
    edges = [0, *(np.flatnonzero(np.diff(hits) > MOST_GAP) + 1).tolist(), len(hits)]
    out, todo = [], [(i, j) for i, j in zip(edges[:-1], edges[1:]) if j - i >= least]
    while todo:
        i, j = todo.pop()
        first, last = int(hits[i]), int(hits[j - 1])
        if last - first + 1 < width or j - i < least:
            continue
        mine = np.unique(own[first : last + 1])
        # the similarity is at most the share of the own shingles that match
        if T_DEN * (j - i) >= T_NUM * len(mine):
            # where the stretch is in ``other``: by its ends, by its usual shift, or by all that matches
            shift = int(np.median(there[i:j] - hits[i:j]))
            sides = [(int(there[i]), int(there[j - 1])), (max(0, first + shift), min(len(other) - 1, last + shift)), (int(there[i:j].min()), int(there[i:j].max()))]
            alike, lo, hi = max((_jaccard(mine, np.unique(other[x : y + 1])), x, y) for x, y in dict.fromkeys(sides) if x <= y)
            if T_DEN * alike >= T_NUM:
                out.append((first, last, lo, hi, alike, hits[i:j], there[i:j]))
                continue
        if j - i < 2:
            continue
        gaps = np.diff(hits[i:j])
        cut = i + int(np.argmax(gaps)) + 1
        todo += [(i, cut), (cut, j)] if gaps.max() > 1 else [(i, (i + j) // 2), ((i + j) // 2, j)]
    return out


def _jaccard(x: np.ndarray, y: np.ndarray) -> float:
    """Similarity of two sorted arrays of distinct values."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / max(1, len(x) + len(y) - both)


def open_windows(docs: DataFrame, covered: DataFrame | None, width: int) -> DataFrame:
    """Windows of ``repeating`` documents that aren't done, cut to stretches that aren't: doc_id, hash, key, f, p, l, r.

    ``covered`` (doc_id, hash, spans) has the verified passages of documents (first and last shingle).
    """
    rows = docs.select("doc_id", "hash", "shared", "windows")
    rows = rows.withColumn("spans", F.lit(None).cast("array<struct<a:int,b:int>>")) if covered is None else rows.join(covered, ["doc_id", "hash"], "left")
    least_open = width - least_shared(width) + 1

    def unpacked(batches: Iterator) -> Iterator:
        import pyarrow as pa

        common.let_go()
        for batch in common.pieces(batches, "windows", STEP_BYTES):
            parts, owners = [], []
            for i, (bits, raw, spans) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(2, 5)))):
                own = np.frombuffer(raw, WINDOW)
                if spans:
                    own = still_open(own, np.unpackbits(np.frombuffer(bits, "u1")), spans, width, least_open)
                parts.append(own), owners.append(np.full(len(own), i))
            every, at = np.concatenate(parts), pa.array(np.concatenate(owners))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *(pa.array(np.ascontiguousarray(every[name])) for name, _ in WINDOW)], names=["doc_id", "hash", *(name for name, _ in WINDOW)])

    return rows.mapInArrow(unpacked, "doc_id long, hash long, key long, f int, p int, l int, r int")


def still_open(own: np.ndarray, left: np.ndarray, spans: list, width: int, least_open: int) -> np.ndarray:
    """The windows of a document over stretches that aren't done, cut to these.

    ``left`` are the shared shingles, ``spans`` the verified passages.
    """
    for s in spans:
        left[s["a"] : s["b"] + 1] = 0
    upto = np.concatenate(([0], np.cumsum(left, dtype=np.int64)))
    # of a window, what the narrowest of its stretches reach
    l, r = np.maximum(own["l"], own["p"] - width + 1), np.minimum(own["r"], own["p"] + width - 1)
    todo = upto[r + 1] - upto[l] >= least_open
    # runs of places where the stretches of unfinished windows begin; windows over them are cut to those
    begins = np.zeros(len(left) + 2, np.int64)
    np.add.at(begins, l[todo], 1)
    np.add.at(begins, r[todo] - width + 2, -1)
    edges = np.flatnonzero(np.diff(np.concatenate(([False], np.cumsum(begins) > 0, [False])).astype(np.int8)))
    head, end = edges[::2], edges[1::2]
    first = np.searchsorted(end, own["l"], side="right")
    number = np.maximum(np.searchsorted(head, own["r"] - width + 1, side="right") - first, 0)
    run = np.repeat(first, number) + np.arange(int(number.sum())) - np.repeat(np.cumsum(number) - number, number)
    own = np.repeat(own, number)
    own["l"], own["r"] = np.maximum(own["l"], head[run]), np.minimum(own["r"], end[run] + width - 2)
    return own


def ranked(alone: DataFrame) -> DataFrame:
    """The windows of ``alone`` whose key several documents have, and their document's place among these: rank 0 is the first, 2 any row of the last doc_id, 1 those between."""
    keys = alone.groupBy("key").agg(F.min(F.struct("doc_id", "hash")).alias("lo"), F.max("doc_id").alias("hi")).filter("lo.doc_id < hi")
    rank = F.when(F.struct("doc_id", "hash") == F.col("lo"), 0).when(F.col("doc_id") < F.col("hi"), 1).otherwise(2)
    return alone.join(common.stored(keys, "keys"), "key").select(*alone.columns, rank.cast("byte").alias("rank"))


def met(rows: DataFrame) -> DataFrame:
    """The documents of window rows by key: key, source_id, source_hash, source_l, source_r."""
    return rows.groupBy("key", F.col("doc_id").alias("source_id"), F.col("hash").alias("source_hash")).agg(F.min("l").alias("source_l"), F.max("r").alias("source_r"))


def candidates(windows: DataFrame, rest: DataFrame, taken: DataFrame | None, runs: DataFrame, width: int) -> DataFrame:
    """The windows of ``rest`` whose document may still be a source: it comes after those ``taken`` of the key, and a later one of the open ``windows`` follows.

    Those that one of ``runs`` (doc_id, hash, cell, a, b: what a source has word by word, by cells of
    its places) holds are left out: that source tells the same.  Open windows get fewer and runs more,
    so no window that a round leaves out has to be asked again: the next one asks these.  ``taken``
    has the last document that is a source of each key with more of them (``last_taken``); None where
    all of ``rest`` come later.
    """
    open_keys, wanted = windows.groupBy("key").agg(F.max("doc_id").alias("last")), F.col("doc_id") < F.col("last")
    if taken is not None:
        open_keys, wanted = open_keys.join(taken, "key"), wanted & (F.struct("doc_id", "hash") > F.col("taken"))
    rows = rest.join(few(open_keys, FEW_KEYS), "key").filter(wanted).select(*rest.columns)
    low, high = F.greatest(F.col("l"), F.col("p") - (width - 1)), F.least(F.col("r"), F.col("p") + (width - 1))
    placed = rows.withColumns({"low": low, "high": high, "cell": F.floor(low / CELL)})
    held = (F.col("x.doc_id") == F.col("r.doc_id")) & (F.col("x.hash") == F.col("r.hash")) & (F.col("x.cell") == F.col("r.cell")) & (F.col("a") <= F.col("low")) & (F.col("b") >= F.col("high"))
    return placed.alias("x").join(runs.alias("r"), held, "left_anti").select(*rows.columns)


def first_sources(unmet: DataFrame, number: int) -> DataFrame:
    """The first ``number`` documents of each key."""
    return unmet.withColumn("place", F.row_number().over(W.partitionBy("key").orderBy("source_id", "source_hash"))).filter(F.col("place") <= number).drop("place")


def last_taken(new: DataFrame, number: int) -> DataFrame:
    """The last of the ``new`` sources of each key that has ``number`` of them; the others have no more documents: key, taken."""
    last = F.max(F.struct(F.col("source_id").alias("doc_id"), F.col("source_hash").alias("hash"))).alias("taken")
    return new.groupBy("key").agg(last, F.count("*").alias("n")).filter(F.col("n") >= number).drop("n")


def live_windows(windows: DataFrame, unmet: DataFrame) -> DataFrame:
    """Open windows whose key has unmet sources, and those that may lie over such a one.

    A stretch that two functions agree on is inside the windows of both and holds
    the places of both, so the place of the other is inside the one's window;
    places are compared by cells of ``CELL`` shingles.
    """
    cell = lambda c: F.floor(F.col(c) / CELL)
    near = windows.join(unmet.select("key").distinct(), "key", "left_semi").select("doc_id", "hash", F.explode(F.sequence(cell("l"), cell("r"))).alias("cell")).distinct()
    # a key's own window holds its place
    return windows.withColumn("cell", cell("p")).join(few(near), ["doc_id", "hash", "cell"], "left_semi").drop("cell")


def few(rows: DataFrame, most: int = BROADCAST_SPANS) -> DataFrame:
    """``rows``, stored; broadcast if they are no more than ``most``."""
    rows = common.stored(rows, "few")
    return F.broadcast(rows) if rows.count() <= most else rows


def hot_windows(windows: DataFrame) -> DataFrame:
    """The keys of more than ``KEY_PART`` windows and in how many parts they are joined: key, parts."""
    many = windows.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > KEY_PART).select("key", (F.col("n") / KEY_PART).cast("int").alias("parts"))
    many = common.stored(many, "hot-keys")
    return F.broadcast(many) if many.count() <= BROADCAST_KEYS else many


def stretches(windows: DataFrame, sources: DataFrame, many: DataFrame, width: int, agree: int) -> DataFrame:
    """Stretches of ``windows`` towards ``sources`` (with new) of smaller id: doc_id, hash, first, last, source_id, source_hash, source_first, source_last.

    Pairs of documents that meet at no new source are left out.  The windows of
    keys that ``many`` lists are joined in parts.
    """
    part = F.coalesce(F.pmod(F.xxhash64("doc_id", "hash", "p"), F.col("parts") + 1), F.lit(0))
    split = windows.join(many, "key", "left").withColumn("part", part.cast("int")).drop("parts")
    copied = sources.join(many, "key", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(0))))).drop("parts")
    met = split.join(copied, ["key", "part"]).filter("source_id < doc_id").groupBy("doc_id", "hash", "source_id", "source_hash")
    met = met.agg(F.max("new").alias("new"), F.collect_set("f").alias("fs"), F.collect_list(F.struct("f", "l", "r", "source_l", "source_r")).alias("met"))
    met = met.filter(F.col("new") & (F.size("fs") >= agree)).drop("new", "fs")

    def laid(batches: Iterator) -> Iterator:
        import pyarrow as pa

        common.let_go()
        for batch in batches:
            lists = batch.column(4)
            every = np.stack([c.to_numpy(zero_copy_only=False) for c in lists.values.flatten()], axis=1).astype(np.int64)
            ends, owners, found = lists.offsets.to_numpy().tolist(), [], []
            for k, (i, j) in enumerate(zip(ends[:-1], ends[1:])):
                some = overlaid(every[i:j], width, agree)
                found += some
                owners += [k] * len(some)
            at, spans = pa.array(owners, pa.int64()), np.array(found, np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([*(c.take(at) for c in batch.columns[:4]), *(pa.array(np.ascontiguousarray(spans[:, i])) for i in range(4))], names=["doc_id", "hash", "source_id", "source_hash", "first", "last", "source_first", "source_last"])

    return met.mapInArrow(laid, "doc_id long, hash long, source_id long, source_hash long, first long, last long, source_first long, source_last long")


def verified(found: DataFrame, docs: DataFrame, n: int, width: int) -> DataFrame:
    """What is really repeated of ``stretches``: the columns of ``repeated_passages`` and runs (of shingles that the source has word by word)."""

    def sliced(tokens: str, first: str, last: str):
        # with a margin on both sides, as windows are cut at the width of one function
        return F.expr(f"substring({tokens}, cast(4 * greatest(0, {first} - {width}) + 1 as int), cast(4 * ({last} - greatest(0, {first} - {width}) + 1 + {width}) as int))")

    def checked(batches: Iterator) -> Iterator:
        import pyarrow as pa

        common.let_go()
        for batch in common.pieces(batches, "other", STEP_BYTES):
            owners, out = [], []
            for k, (first, lo, own, other) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("first", "source_first", "own", "other")))):
                first, lo = max(0, first - width), max(0, lo - width)
                for a, b, c, d, alike, hits, there in matched_places(np.frombuffer(own, "<u4"), np.frombuffer(other, "<u4"), width):
                    cuts = np.flatnonzero((np.diff(hits) != 1) | (np.diff(there) != 1))
                    runs = zip(hits[np.append(0, cuts + 1)].tolist(), hits[np.append(cuts, len(hits) - 1)].tolist())
                    owners.append(k), out.append((first + a, first + b + n, lo + c, lo + d + n, alike, [{"a": first + x, "b": first + y} for x, y in runs]))
            at = pa.array(owners, pa.int64())
            columns = list(zip(*out)) if out else [[]] * 6
            kinds = [pa.int64()] * 4 + [pa.float64(), pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), batch.column("hash").take(at), batch.column("source_id").take(at), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=["doc_id", "hash", "source_id", "start_word", "end_word", "source_start", "source_end", "similarity", "runs"])

    found = common.stored(found, "stretches", STEP_BYTES)
    number = found.count()
    asked = F.broadcast(found) if number <= BROADCAST_SPANS else found
    # slices of the sources go to the document, whose tokens go once, however many sources it has
    other = docs.select(F.col("doc_id").alias("source_id"), F.col("hash").alias("source_hash"), "tokens").join(asked, ["source_id", "source_hash"])
    other = other.select("doc_id", "hash", "source_id", "first", "last", "source_first", sliced("tokens", "source_first", "source_last").alias("other"))
    own = docs.select("doc_id", "hash", "tokens")
    if number <= BROADCAST_SPANS:
        own = own.join(F.broadcast(found.select("doc_id", "hash").distinct()), ["doc_id", "hash"], "left_semi")
    both = other.join(own, ["doc_id", "hash"]).select("doc_id", "hash", "source_id", "first", "source_first", sliced("tokens", "first", "last").alias("own"), "other")
    return both.mapInArrow(checked, PASSAGE)


def first_of_equals(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``docs`` (doc_id, text) without rows of equal text but the one of the smallest doc_id; and the others: doc_id, hash, source_id, n_words.

    Texts are told apart by their SHA-256; rows of one doc_id and text count once, those of null id don't.
    """
    docs = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    thin = docs.filter("text IS NOT NULL").select("doc_id", F.unhex(F.sha2("text", 256)).alias("sha"), F.xxhash64("text").alias("hash"), common.word_count(F.col("text")).alias("n_words"))
    thin = common.stored(thin, "texts")
    equal = thin.groupBy("sha").agg(F.count("*").alias("n"), F.min("doc_id").alias("source_id")).filter("n > 1")
    again = common.stored(hot.attached(thin, common.stored(equal, "equal"), ["sha"], thin.count()), "copies")
    copies = again.filter("doc_id != source_id").select("doc_id", "hash", "source_id", "n_words").distinct()
    gone = common.stored(again.filter("doc_id != source_id").select("doc_id", "sha").distinct(), "gone")
    common.drop_stored(thin)
    if not gone.isEmpty():
        gone = F.broadcast(gone) if gone.count() <= BROADCAST_SPANS else gone
        docs = docs.withColumn("sha", F.unhex(F.sha2("text", 256))).join(gone, ["doc_id", "sha"], "left_anti").drop("sha")
    return docs, copies


def repeated_passages(docs: DataFrame, n: int = N, least_words: int = LEAST_WORDS, functions: int = FUNCTIONS, agree: int = AGREE) -> DataFrame:
    """Passages of at least ``least_words`` words that a document repeats from one of smaller doc_id.

    Returns doc_id, start_word, end_word (exclusive), source_id, source_start,
    source_end, similarity (of the shingle sets, 0.75 or more) and hash (xxhash64 of
    the text, which tells rows of one doc_id apart).  The first document with a
    passage isn't listed for it, only named as source.

    * Words are compared with A-Z lower-cased.  Texts that are null or shorter than
      a passage repeat nothing; a passage repeated inside one document, or between
      rows of one doc_id, is no row.
    * A text that an earlier document has, too, repeats that as a whole.
    * Rows of equal doc_id and text count once; rows of null id are left out.
    * An empty table gives no rows; other columns are ignored.
    """
    width = least_words - n + 1
    docs, copies = first_of_equals(docs)
    texts = frequencies.blocks(docs)
    every = common.stored(repeating(texts, n, least_words, functions), "repeating", STEP_BYTES)
    common.drop_stored(texts)
    if not every.groupBy("doc_id", "hash").count().filter("count > 1").isEmpty():
        every = common.stored(every.dropDuplicates(["doc_id", "hash"]), "repeating")
    alone = common.stored(open_windows(every, None, width), "windows", STEP_BYTES)
    # a key that one document has tells nothing
    every_window = common.stored(ranked(alone), "windows")
    common.drop_stored(alone)
    windows, rest, taken = every_window.drop("rank"), every_window.filter("rank = 1").drop("rank", "f"), None
    none, many = docs.sparkSession.createDataFrame([], PASSAGE), hot_windows(windows)
    sources, runs, out, number = None, None, [], 1
    new = common.stored(met(every_window.filter("rank = 0")), "sources")
    while not new.isEmpty():
        known = new.withColumn("new", F.lit(True))
        if sources is not None:
            known = known.unionByName(sources.withColumn("new", F.lit(False)))
        out.append(common.stored(verified(stretches(windows, known, many, width, agree), every, n, width), "passages", STEP_BYTES))
        if taken is not None and taken.isEmpty():
            break
        sources = new if sources is None else sources.unionByName(new)
        # windows of documents with new passages are looked at again
        passage = F.struct(F.col("start_word").cast("int").alias("a"), (F.col("end_word") - n).cast("int").alias("b"))
        changed = few(out[-1].select("doc_id", "hash").distinct())
        mine = reduce(DataFrame.unionByName, out)
        covered = few(mine.join(changed, ["doc_id", "hash"], "left_semi").groupBy("doc_id", "hash").agg(F.collect_set(passage).alias("spans")))
        again = open_windows(every.join(changed, ["doc_id", "hash"], "left_semi"), covered, width)
        windows = common.stored(windows.join(changed, ["doc_id", "hash"], "left_anti").unionByName(again), "windows", STEP_BYTES)
        cells = F.sequence(F.floor(F.col("run.a") / CELL), F.floor(F.col("run.b") / CELL))
        # runs too short to hold what a window reaches are none
        held = out[-1].select("doc_id", "hash", F.explode("runs").alias("run")).filter(F.col("run.b") - F.col("run.a") + 1 >= width)
        held = held.select("doc_id", "hash", F.explode(cells).alias("cell"), "run.a", "run.b")
        runs = held if runs is None else runs.unionByName(held)
        number *= ROUND_GROWTH
        rest = common.stored(candidates(windows, rest, taken, runs, width), "rest")
        unmet = common.stored(met(rest), "unmet")
        if unmet.isEmpty():
            break
        live = common.stored(live_windows(windows, unmet), "windows")
        common.drop_stored(windows)
        windows, new = live, common.stored(first_sources(unmet, number), "sources")
        common.drop_stored(unmet)
        taken = common.stored(last_taken(new, number), "taken")
    found = reduce(DataFrame.unionByName, out, none)
    zero = F.lit(0).cast("long")
    whole = copies.filter(F.col("n_words") >= least_words).select("doc_id", "hash", "source_id", zero.alias("start_word"), F.col("n_words").alias("end_word"), zero.alias("source_start"), F.col("n_words").alias("source_end"), F.lit(1.0).alias("similarity"))
    return found.drop("runs").distinct().unionByName(whole)


def without_passages(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """``docs`` with the words of their listed passages cut out; all columns stay, ``n_chars`` follows the text.

    A document without a listed passage is returned as it is; one of which no word
    is left is dropped.  Rows of one doc_id are told apart by their texts.
    """
    at_id, at_hash = F.col("doc_id").cast("long").alias("__eventloom_id"), F.xxhash64("text").alias("__eventloom_hash")
    spans = passages.groupBy(F.col("doc_id").alias("__eventloom_id"), F.col("hash").alias("__eventloom_hash"))
    spans = common.stored(spans.agg(F.collect_set(F.struct("start_word", "end_word")).alias("__eventloom_spans")), "spans")
    keyed = docs.select("*", at_id, at_hash)
    joined = keyed.join(F.broadcast(spans) if spans.count() <= BROADCAST_SPANS else spans, ["__eventloom_id", "__eventloom_hash"], "left").select(*docs.columns, "__eventloom_spans")
    at = joined.columns.index("text"), len(joined.columns) - 1
    schema = joined.drop("__eventloom_spans").schema

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        common.let_go()
        for batch in common.pieces(batches, "text", STEP_BYTES):
            texts, kept = batch.column(at[0]).to_pylist(), []
            for i, spans in enumerate(batch.column(at[1]).to_pylist()):
                if spans:
                    texts[i] = cut_words(texts[i], [(s["start_word"], s["end_word"]) for s in spans])
                if not spans or texts[i]:
                    kept.append(i)
            columns = dict(zip(schema.names, batch.columns[:-1]))
            columns["text"] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_pydict(columns).take(pa.array(kept, pa.int64()))

    out = joined.mapInArrow(cut, schema)
    return out.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType)) if "n_chars" in schema.names else out


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """A text without the words of spans (first, end); "" if no word is left."""
    import re

    marks = [m.span() for m in re.finditer(r"[^ \t\n\v\f\r]+", text)]
    gone = np.zeros(len(marks), bool)
    for a, b in spans:
        gone[a:b] = True
    out, at = [], 0
    edge = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8)))
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
        out.append(text[at : marks[a][0]])
        at = marks[b][0] if b < len(marks) else len(text)
    return "".join([*out, text[at:]]).strip(" \t\n\v\f\r") if not gone.all() else ""


def op2_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents``: each repeated passage with its document and its source."""
    return repeated_passages(common.table(spark, sf_dir, "documents"))
