"""Connected components of a graph given as edges, by hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm import common


def components(edges: DataFrame) -> DataFrame:
    """Smallest reachable id of every end of ``edges`` (a, b, undirected): columns id, label.

    In each round every vertex takes its smallest neighbour, or itself, as parent;
    parents are followed twice and the edges go on between what is left.  At most
    half of the vertices with edges stay, so rounds grow with the logarithm of the
    graph.  Every round is written to the shared folder; nothing but counts
    reaches the driver.
    """
    rest = common.stored(edges.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = rest.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("label", F.col("id"))
    labels = common.stored(labels, "labels")
    while not rest.isEmpty():
        both = rest.unionByName(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy(F.col("a").alias("v")).agg(F.least(F.col("v"), F.min("b")).alias("p"))
        near = parent = common.stored(parent, "parents")
        for _ in range(2):
            above = parent.select(F.col("v").alias("p"), F.col("p").alias("pp"))
            parent = parent.join(above, "p", "left").select("v", F.coalesce("pp", "p").alias("p"))
        parent = common.stored(parent, "parents")
        before = labels, rest, near
        labels = labels.join(parent, F.col("label") == F.col("v"), "left").select("id", F.coalesce("p", "label").alias("label"))
        labels = common.stored(labels, "labels")
        ends = rest.join(parent, F.col("a") == F.col("v")).select(F.col("p").alias("a"), "b")
        ends = ends.join(parent, F.col("b") == F.col("v")).select("a", F.col("p").alias("b")).filter("a != b")
        rest = common.stored(ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        common.drop_stored(*before, parent)
    common.drop_stored(rest)
    return labels
