"""Windows along objects of any size: those of hot objects are divided by time, and carry over.

An object is hot if it has more than one in ``HOT_SHARE`` of all relationships, so
there are fewer hot ones than that.  Their rows are dealt by object and time
segment, all others by object; what a segment's first and last rows need from its
neighbours comes from a frame with one row a hot object and segment, which is broadcast:
fewer than ``HOT_SHARE`` x (``SEGMENTS`` + 1) rows, whatever the log's size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HOT_SHARE = 1024
#: Time segments of a hot object.
SEGMENTS = 256


def hot_keys(rows: DataFrame, key: str) -> DataFrame:
    """The keys of more than one in ``HOT_SHARE`` rows."""
    counts = rows.groupBy(key).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n").alias("_total"))  # one row
    return counts.crossJoin(F.broadcast(total)).filter(F.col("_n") * HOT_SHARE > F.col("_total")).select(key)


def segmented(rows: DataFrame, key: str, hot: DataFrame | None, us: Column) -> DataFrame:
    """``rows`` with _seg: the segment by time ``us`` of a hot key's row (rows without a time in the first), null for other keys (all if ``hot`` is None)."""
    if hot is None:
        return rows.withColumn("_seg", F.lit(None).cast("int"))
    span = rows.agg(F.min(us).alias("_lo"), F.max(us).alias("_hi"))  # one row
    width = (F.col("_hi") - F.col("_lo")) / SEGMENTS + 1
    seg = F.when(F.col("_hot"), F.coalesce(F.floor((us - F.col("_lo")) / width), F.lit(-1)).cast("int"))
    marked = rows.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), key, "left").crossJoin(F.broadcast(span))
    return marked.withColumn("_seg", seg).drop("_hot", "_lo", "_hi")


class Along:
    """Neighbours of rows along ``key``, in an order that begins with the time."""

    def __init__(self, rows: DataFrame, key: str, hot: DataFrame | None, order: Sequence[str]):
        self.key, self.order, self.whole = key, list(order), hot is None
        self.rows = segmented(rows, key, hot, F.unix_micros(self.order[0]))
        self.window = W.partitionBy(key, "_seg").orderBy(*self.order)

    def with_neighbours(self, lead: dict[str, str] | None = None, lag: dict[str, str] | None = None, place: str | None = None) -> DataFrame:
        """Rows with columns of the next row (``lead``: name -> column) and of the one before (``lag``), and their place from 1."""
        lead, lag = lead or {}, lag or {}
        if self.whole:  # no key is divided
            w = W.partitionBy(self.key).orderBy(*self.order)
            own = {n: F.lead(c).over(w) for n, c in lead.items()} | {n: F.lag(c).over(w) for n, c in lag.items()}
            return self.rows.withColumns(own | ({place: F.row_number().over(w)} if place else {})).drop("_seg")
        by = F.struct(*self.order)
        edge = self.rows.filter("_seg IS NOT NULL").groupBy(self.key, "_seg").agg(
            F.count("*").alias("_size"),
            *(F.min_by(F.struct(F.col(c).alias("v")), by).alias(f"_head_{n}") for n, c in lead.items()),
            *(F.max_by(F.struct(F.col(c).alias("v")), by).alias(f"_tail_{n}") for n, c in lag.items()),
        )
        across = W.partitionBy(self.key).orderBy("_seg")
        edge = edge.select(
            self.key, "_seg",
            F.coalesce(F.sum("_size").over(across.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
            *(F.lead(f"_head_{n}").over(across).alias(f"_next_{n}") for n in lead),
            *(F.lag(f"_tail_{n}").over(across).alias(f"_prev_{n}") for n in lag),
        )
        inside = {f"_lead_{n}": F.lead(F.struct(F.col(c).alias("v"))).over(self.window) for n, c in lead.items()} | {f"_lag_{n}": F.lag(F.struct(F.col(c).alias("v"))).over(self.window) for n, c in lag.items()}
        if place:
            inside["_row"] = F.row_number().over(self.window)
        found = self.rows.withColumns(inside).join(F.broadcast(edge), [self.key, "_seg"], "left")
        out: dict[str, Column] = {n: F.coalesce(f"_lead_{n}", f"_next_{n}")["v"] for n in lead} | {n: F.coalesce(f"_lag_{n}", f"_prev_{n}")["v"] for n in lag}
        if place:
            out[place] = (F.coalesce("_before", F.lit(0)) + F.col("_row")).cast("int")
        gone = [*inside, "_seg", "_before", *(f"_next_{n}" for n in lead), *(f"_prev_{n}" for n in lag)]
        return found.withColumns(out).drop(*gone)
