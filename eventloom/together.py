"""Events that come with their objects in one row: relationships without a join, once they are checked.

Some sources have an event's objects beside it.  ``Together`` keeps such rows next to the tables
that they say the same as.  Before they stand in for joins, one grouping by object finds out whether
every object is known once and by the type that its rows say; else the tables are joined.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.operators.segments import HOT_SHARE

#: So many unknown objects are taken out of the rows where these are made; with more, tables are joined.
MOST_UNKNOWN = 1000


@dataclass(frozen=True)
class Checked:
    """Rows of known objects alone, the objects of more than one in ``HOT_SHARE`` relationships, and how many objects of a type events have.

    ``counts``: event type -> object type -> (least, most).
    """

    frame: DataFrame
    hot: list[str]
    counts: dict[str, dict[str, tuple[int, int]]]

    def linked(self) -> DataFrame:
        """A row for each event and object: event_id, event_type, ts, event_idx, object_id, object_type."""
        each = self.frame.select("event_id", "event_type", "ts", "event_idx", F.explode("objects").alias("o"))
        return each.select("event_id", "event_type", "ts", "event_idx", "o.object_id", "o.object_type")

    def ids(self, kind: str) -> Column:
        """The objects of a type that an event has."""
        return F.transform(F.filter("objects", lambda x: x["object_type"] == kind), lambda x: x["object_id"])

    def hot_frame(self, name: str = "object_id") -> DataFrame | None:
        """The hot objects as a frame; None if there are none."""
        return self.frame.sparkSession.createDataFrame([(x,) for x in self.hot], f"{name} string") if self.hot else None


class Together:
    """``frame``: event_id, event_type, ts, event_idx and objects (array of object_id and object_type, each object once).

    Every row of an event has all its objects; an object's type is the one that it has if it is
    known.  Both must hold for the tables beside it, as long as no object is there twice.
    """

    def __init__(self, frame: DataFrame, events: DataFrame, objects: DataFrame, e2o: DataFrame):
        self.frame, self.events, self.objects, self.e2o = frame, events, objects, e2o
        self._found: list[tuple[DataFrame, Checked | None]] = []

    def checked(self, events: DataFrame, objects: DataFrame, e2o: DataFrame) -> Checked | None:
        """The rows for a log of these tables; None if they don't say the same."""
        if events is not self.events or e2o is not self.e2o:
            return None
        if objects is not self.objects and self.checked(events, self.objects, e2o) is None:
            return None
        for frame, found in self._found:
            if frame is objects:
                return found
        self._found.append((objects, self._check(objects)))
        return self._found[-1][1]

    def _check(self, objects: DataFrame) -> Checked | None:
        kinds = sorted(r[0] for r in objects.select("object_type").distinct().collect() if r[0] is not None)  # types
        if not kinds:
            return None
        known = F.filter("objects", lambda x: x["object_id"].isNotNull() & x["object_type"].isin(kinds))
        frame = self.frame.filter("event_id IS NOT NULL").withColumn("objects", known)
        kind = F.xxhash64("object_type").alias("kind")
        rows = frame.select(F.explode("objects").alias("o")).select("o.*").select("object_id", kind, F.lit(0).alias("n"), F.lit(1).alias("links"))
        total = frame.agg(F.sum(F.size("objects"))).first()[0] or 0
        rows = rows.unionByName(objects.filter("object_id IS NOT NULL").select("object_id", kind, F.lit(1).alias("n"), F.lit(0).alias("links")))
        each = rows.groupBy("object_id").agg(F.sum("n").alias("n"), F.sum("links").alias("links"), (F.min("kind") != F.max("kind")).alias("mixed"))
        odd = each.filter((F.col("n") != 1) | F.col("mixed") | (F.col("links") * HOT_SHARE > total)).limit(MOST_UNKNOWN + HOT_SHARE).collect()
        unknown = [r.object_id for r in odd if r.n == 0]
        if any(r.n > 1 or r.mixed for r in odd) or len(unknown) > MOST_UNKNOWN or len(odd) == MOST_UNKNOWN + HOT_SHARE:
            return None
        if unknown:
            frame = frame.withColumn("objects", F.filter("objects", lambda x: ~x["object_id"].isin(unknown)))
        of = {k: F.size(F.filter("objects", lambda x: x["object_type"] == k)) for k in kinds}  # noqa: B023
        bounds = [x for i, c in enumerate(of.values()) for x in (F.min(c).alias(f"least{i}"), F.max(c).alias(f"most{i}"))]
        counts = {r.event_type: {k: (r[f"least{i}"], r[f"most{i}"]) for i, k in enumerate(kinds)} for r in frame.groupBy("event_type").agg(*bounds).collect()}  # types
        return Checked(frame, [r.object_id for r in odd if r.n == 1 and r.links * HOT_SHARE > total], counts)
