"""Centroid clustering (Lloyd's rounds) with exact nearest centroids by annulus search.

Centroids are sorted by norm.  By the triangle inequality no centroid is nearer
to a vector than the difference of their norms, so the distance to any centroid
bounds the norms of those that can be as near: an annulus around the origin, whose
centroids a binary search finds and exact integer distances decide, ties too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm import common

#: Components of a vector that takes part; they are multiplied by the factor and rounded down.
DIM, FACTOR = 64, 64
#: Centroids, and rounds before the last assignment.
CENTROIDS, ROUNDS = 16, 3
#: Start centroids are the vectors of the smallest hashes of this and the id.
SEED = "1:"
#: Integer components stop at this, so that squared distances of 64 components fit a long.
MOST_COMPONENT = 1 << 27
#: Vectors compared at once.
ROWS = 8192


def quantised(rows: DataFrame, dim: int = DIM, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id and v (integers floor(64 * x)) of the vectors that take part, every row for itself.

    Vectors of other length, null ones, and those with null, NaN or infinite components
    take no part.  Integers are limited to +-``MOST_COMPONENT``.
    """
    x = F.col(embedding)
    finite = F.coalesce(F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(float("inf")))), F.lit(False))
    most = F.lit(float(MOST_COMPONENT))
    whole = F.transform(x, lambda c: F.floor(F.greatest(-most, F.least(most, c.cast("double") * F.lit(float(FACTOR))))).cast("int"))
    return rows.filter((F.size(x) == dim) & finite).select(F.col(vec_id).cast("long").alias("vec_id"), whole.alias("v"))


def nearest(v: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each vector's nearest centroid, ties to the smaller, and the squared distance; all are int64."""
    sizes = np.sqrt((centroids.astype(np.float64) ** 2).sum(axis=1))
    order = np.argsort(sizes, kind="stable")
    sizes, norms = sizes[order], np.sqrt((v.astype(np.float64) ** 2).sum(axis=1))
    which, best = np.full(len(v), len(order), np.int64), np.full(len(v), np.iinfo(np.int64).max)

    def compare(rows: np.ndarray, numbers: np.ndarray) -> None:
        apart = v[rows] - centroids[numbers]
        d = np.einsum("ij,ij->i", apart, apart)
        better = (d < best[rows]) | ((d == best[rows]) & (numbers < which[rows]))
        best[rows[better]], which[rows[better]] = d[better], np.broadcast_to(numbers, d.shape)[better]

    # an upper bound: the nearer one of the neighbours in norm
    every, at = np.arange(len(v)), np.searchsorted(sizes, norms)
    below, above = order[np.maximum(at - 1, 0)], order[np.minimum(at, len(order) - 1)]
    compare(every, below), compare(every, above)
    bound = np.sqrt(best.astype(np.float64))
    slack = 1e-9 * (1 + norms + bound)  # far above the rounding of norms and bounds
    first, end = np.searchsorted(sizes, norms - bound - slack, "left"), np.searchsorted(sizes, norms + bound + slack, "right")
    for place, number in enumerate(order.tolist()):
        inside = (first <= place) & (place < end) & (below != number) & (above != number)
        if len(rows := np.flatnonzero(inside)):
            compare(rows, np.full(len(rows), number))
    return which, best


def _matrix(column) -> np.ndarray:
    """A list column of equal lengths as a matrix of int64."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster and distance (squared) of every row of ``vectors`` (vec_id, v)."""

    def found(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                which, d = nearest(_matrix(part.column(1)), centroids)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(which, pa.int32()), pa.array(d, pa.int64())], names=["vec_id", "cluster", "distance"])

    return vectors.mapInArrow(found, "vec_id long, cluster int, distance long")


def moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round: componentwise floor(sum / count) of their vectors; those without vectors stay.

    Every task sums its own vectors; sums of one centroid and component meet in Spark,
    and as many numbers as the centroids have reach the driver.
    """
    dim = centroids.shape[1]

    def summed(batches: Iterator) -> Iterator:
        import pyarrow as pa

        sums = np.zeros((len(centroids), dim + 1), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                v = _matrix(batch.slice(at, ROWS).column(1))
                which, _ = nearest(v, centroids)
                for c in np.unique(which).tolist():
                    own = v[which == c]
                    sums[c, :dim] += own.sum(axis=0)
                    sums[c, dim] += len(own)
        used = np.repeat(np.flatnonzero(sums[:, dim]), dim + 1)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(np.tile(np.arange(dim + 1), len(used) // (dim + 1)), pa.int32()), pa.array(sums[sums[:, dim] > 0].ravel(), pa.int64())], names=["cluster", "at", "total"])

    totals = np.zeros((len(centroids), dim + 1), object)
    for c, i, total in vectors.mapInArrow(summed, "cluster int, at int, total long").groupBy("cluster", "at").agg(F.sum("total")).collect():
        totals[c, i] = total
    out = centroids.copy()
    for c, (*sums, n) in enumerate(totals.tolist()):
        if n:
            out[c] = [s // n for s in sums]
    return out


def cluster(rows: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dim: int = DIM, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Clusters of the vectors that take part (see ``quantised``): vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Centroids start as the ``k`` vectors of the smallest sha256 of "1:" and the id,
    numbered in that order (all, if there are fewer; rows of one id by their
    vectors; the id null reads "null").  Each round assigns and moves them; at last
    vectors are assigned once more.  Distances are squared; sums beyond a long take the greatest one.

    * Rows of one id or of equal vectors are vectors of their own.
    * An empty table gives no rows; other columns are ignored.
    * Centroids (``k`` x ``dim`` integers) are all that the driver holds.
    """
    spark = rows.sparkSession
    vectors = common.stored(quantised(rows, dim, vec_id, embedding), "vectors")
    order = F.sha2(F.concat(F.lit(SEED), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))), 256)
    first = vectors.select(order.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    if not first:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = np.array([r.v for r in first], np.int64).reshape(len(first), dim)
    for _ in range(rounds):
        centroids = moved(vectors, centroids)
    found = common.stored(assigned(vectors, centroids), "clusters")
    common.drop_stored(vectors)
    digests = [(c, hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for c, x in enumerate(centroids.tolist())]
    fits = lambda total: F.least(total, F.lit((1 << 63) - 1).cast("decimal(38,0)")).cast("long")
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).cast("decimal(38,0)").alias("own"))  # k rows at most
    every = found.agg(F.sum(F.col("distance").cast("decimal(20,0)")).cast("decimal(38,0)").alias("every"))
    told = sums.crossJoin(F.broadcast(every)).join(F.broadcast(spark.createDataFrame(digests, "cluster int, centroid_sha256 string")), "cluster")
    told = told.select("cluster", fits(F.col("own")).alias("cluster_inertia"), fits(F.col("every")).alias("inertia"), "centroid_sha256")
    return found.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op11_annulus_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``embeddings`` of 64 components: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    return cluster(common.table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    away = lambda n: f"""a{n} AS (SELECT r, m.c AS c, m.d AS d FROM (SELECT r, min({{'d': d, 'c': c}}) AS m FROM (
  SELECT v.r, k.c, CAST(list_sum(list_transform(list_zip(v.e, k.e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM v CROSS JOIN c{n} k) GROUP BY r))"""  # noqa: E731
    move = lambda n: f"""c{n + 1} AS (SELECT k.c, coalesce(u.e, k.e) AS e FROM c{n} k LEFT JOIN (
  SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS e FROM (
    SELECT c, i, CAST(sum(x) AS HUGEINT) AS s, count(*) AS n FROM (SELECT a.c, unnest(v.e) AS x, unnest(range(1, {DIM + 1})) AS i FROM a{n} a JOIN v USING (r)) GROUP BY c, i) GROUP BY c) u USING (c))"""  # noqa: E731
    steps = ",\n".join(f"{away(n)},\n{move(n)}" for n in range(ROUNDS))
    return f"""
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({FACTOR} * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (SELECT row_number() OVER (ORDER BY h, e) - 1 AS c, e FROM (SELECT sha256('{SEED}' || coalesce(CAST(vec_id AS VARCHAR), 'null')) AS h, e FROM v ORDER BY h, e LIMIT {CENTROIDS})),
{steps},
{away(ROUNDS)}
SELECT v.vec_id, CAST(a.c AS INTEGER) AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(k.e, ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN v USING (r) JOIN c{ROUNDS} k ON k.c = a.c"""


SQL = _sql()
