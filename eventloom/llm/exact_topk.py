"""Exact top-k inner products by multi-resolution segment statistics.

Every vector is cut into 1, 4 and 16 segments; means and deviations of the
segments bound the score of a pair from above (by Cauchy-Schwarz on what is left
of a segment without its mean), which is the same as bounding its distance from
below.  Pairs whose bound at a coarse level is under the query's k-th best score
so far are done; the rest is bounded more finely and at last scored exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventloom.llm import common

#: Components are multiplied by this and rounded down.
FACTOR = 256
#: Every so manyth vec_id is a query, and it gets this many rows.
EVERY, K = 50, 5
#: Segments at each level, coarse to fine.
LEVELS = (1, 4, 16)
#: Queries sent to the executors at once (with up to 4 KB each), and candidates scored at once.
QUERY_BLOCK, ROWS = 4096, 512
#: Above this a component product may not be exact in floating point; such pairs are scored in integers.
_EXACT = float(1 << 53)
_LONG = (1 << 63) - 1


def quantised(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id and v (doubles, floor(256 * component)) of the vectors that take part, once each.

    Null vectors, and vectors with null, NaN or infinite components, take no part,
    nor do rows of null id.  Rows of equal id and vector count once.
    """
    whole = F.forall(embedding, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    fine = F.col(embedding).isNotNull() & F.coalesce(whole, F.lit(False)) & F.col(vec_id).isNotNull()
    big = F.transform(F.col(embedding), lambda c: c.cast("double") * F.lit(float(FACTOR)))
    # doubles of 2^52 or more are their own floor, and may not fit a long
    exact = F.transform(big, lambda c: F.when(F.abs(c) < F.lit(float(1 << 52)), F.floor(c).cast("double")).otherwise(c))
    return rows.filter(fine).select(F.col(vec_id).cast("long").alias("vec_id"), exact.alias("v")).distinct()


class Block:
    """Vectors of a block with their segment statistics at every level."""

    def __init__(self, ids: np.ndarray, vectors: list[np.ndarray], dim: int):
        self.ids, self.v = ids, np.zeros((len(vectors), dim))
        for i, x in enumerate(vectors):
            self.v[i, : len(x)] = x
        self.most = float(np.abs(self.v).max(initial=0.0))
        self.levels = []
        for segments in LEVELS:
            edges = np.unique(np.linspace(0, dim, min(segments, max(1, dim)) + 1).astype(int))
            width = np.diff(edges)
            if not len(width):
                self.levels.append(np.zeros((len(vectors), 2)))
                continue
            mean = np.add.reduceat(self.v, edges[:-1], axis=1) / width
            rest = self.v - np.repeat(mean, width, axis=1)
            deviation = np.sqrt(np.add.reduceat(rest * rest, edges[:-1], axis=1))
            self.levels.append(np.concatenate((mean * np.sqrt(width), deviation), axis=1))


def _exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row inner products as integers; those out of a long's range take its end."""
    if np.abs(x).max(initial=0) * np.abs(y).max(initial=0) * max(1, x.shape[1]) < _EXACT:
        return np.einsum("ij,ij->i", x, y).astype(np.int64)
    sums = [sum(int(a) * int(b) for a, b in zip(p.tolist(), q.tolist())) for p, q in zip(x, y)]
    return np.array([max(-_LONG - 1, min(_LONG, s)) for s in sums], np.int64)


def best(queries: Block, rows: Block, k: int, top: list[list[tuple[int, int]]]) -> None:
    """Take ``rows`` into ``top``, the k best (-score, vec_id) of every query, ascending.

    While many pairs are left, bounds and scores of all pairs at once are cheaper
    than those of single pairs; both ways give the same.
    """
    if not len(rows.ids) or not len(queries.ids):
        return
    scale = queries.most * rows.most * max(1, rows.v.shape[1])
    slack = 1e-9 * (1.0 + scale)
    whole = scale < _EXACT

    def bars() -> np.ndarray:
        return np.array([-t[-1][0] if len(t) >= k else -np.inf for t in top], np.float64)

    def take(q: np.ndarray, r: np.ndarray, scores: np.ndarray) -> None:
        for i, s, vec in zip(q.tolist(), scores.tolist(), rows.ids[r].tolist()):
            t = top[i]
            if len(t) < k or (-s, vec) < t[-1]:
                t.append((-s, vec))
                t.sort()
                del t[k:]

    bar = bars()[:, None]
    alive = queries.ids[:, None] != rows.ids[None, :]
    for a, b in zip(queries.levels, rows.levels):
        left = np.count_nonzero(alive)
        if not left:
            return
        if 4 * left > alive.size:
            alive &= a @ b.T + slack >= bar
        else:
            q, r = np.nonzero(alive)
            for i in range(0, left, 65536):
                u, w = q[i : i + 65536], r[i : i + 65536]
                alive[u, w] = np.einsum("ij,ij->i", a[u], b[w]) + slack >= bar[u, 0]
    left = np.count_nonzero(alive)
    if whole and 4 * left > alive.size:
        scores = np.where(alive, queries.v @ rows.v.T, -np.inf)
        if scores.shape[1] > k:  # nothing under the k-th best of these rows, or of those before, can stay
            bar = np.maximum(bar, np.partition(scores, -k, axis=1)[:, -k][:, None])
        q, r = np.nonzero(alive & (scores >= bar))
        take(q, r, scores[q, r].astype(np.int64))
        return
    q, r = np.nonzero(alive)
    for i in range(0, len(q), 32768):
        u, w = q[i : i + 32768], r[i : i + 32768]
        scores = _exact(queries.v[u], rows.v[w])
        good = scores + slack >= bars()[u]
        take(u[good], w[good], scores[good])


def top_k(rows: DataFrame, queries: DataFrame, k: int = K, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """The k rows of greatest inner product for every query: query_id, rank (from 1), vec_id, score.

    Scores are integers, of components floor(256 * x); ties go to the smaller
    vec_id; fewer rows than k give all.  A query's own row, the one of its vec_id,
    is no candidate.  Vectors of different length are compared over their common
    components.  What takes no part is said at ``quantised``.  Scores that no long
    can hold take the nearest one.

    Queries go to the executors in blocks of ``QUERY_BLOCK``, each against all rows;
    only one block is in the driver's memory at a time.
    """
    spark = rows.sparkSession
    kept = common.stored(quantised(rows, vec_id, embedding), "vectors")
    asked = common.stored(quantised(queries, vec_id, embedding), "queries")
    dim = kept.select(F.max(F.size("v"))).first()[0] or 0
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    numbered = asked.select("vec_id", "v", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("_block"))
    found = []
    for b in range(blocks):
        got = numbered.filter(F.col("_block") == b).orderBy("vec_id").select("vec_id", "v").toArrow()
        if not got.num_rows:
            continue
        width = max(dim, max(map(len, got.column(1).to_pylist()), default=0))
        packed = spark.sparkContext.broadcast((got.column(0).to_numpy(), [np.asarray(x) for x in got.column(1).to_pylist()], width))

        def searched(batches: Iterator, packed=packed) -> Iterator:
            import pyarrow as pa

            ids, vectors, width = packed.value
            asked = Block(ids, vectors, width)
            top: list[list[tuple[int, int]]] = [[] for _ in ids]
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS):
                    part = batch.slice(at, ROWS)
                    flat, ends = part.column(1).flatten().to_numpy(), np.cumsum([0, *(len(x) for x in part.column(1))])
                    best(asked, Block(part.column(0).to_numpy(), [flat[i:j] for i, j in zip(ends, ends[1:])], width), k, top)
            rows = [(q, vec, -s) for q, t in zip(ids.tolist(), top) for s, vec in t]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], pa.int64()) for i in range(3)], names=["query_id", "vec_id", "score"])

        found.append(kept.mapInArrow(searched, "query_id long, vec_id long, score long"))
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return every.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best rows for every 50th of all ``embeddings``: query_id, rank, vec_id, score."""
    rows = common.table(spark, sf_dir, "embeddings")
    return top_k(rows, rows.filter(F.col("vec_id") % EVERY == 0))


SQL = f"""
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor({FACTOR} * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, r.vec_id, list_sum(list_transform(list_zip(q.e, r.e), lambda p: p[1] * p[2])) AS score
  FROM v q JOIN v r ON q.vec_id % {EVERY} = 0 AND q.vec_id != r.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= {K}"""
