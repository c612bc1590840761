"""Event data as DataFrames: case-centric logs and object-centric logs."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.together import Checked, Together

#: Activity of an event without one.
NO_ACTIVITY = "No Activity"
#: Label of dotted charts and histograms for a missing string.
UNKNOWN = "UNKNOWN"

LOG_EVENTS = "case_id string, event_idx long, activity string, ts timestamp, attrs map<string,string>"
LOG_CASES = "case_id string, trace_idx long, attrs map<string,string>"
OCEL_EVENTS = "event_id string, event_idx long, event_type string, ts timestamp"
OCEL_OBJECTS = "object_id string, object_idx long, object_type string"
OCEL_E2O = "event_id string, object_id string, qualifier string"
OCEL_O2O = "source_id string, target_id string, qualifier string"
OCEL_EVENT_ATTRS = "event_id string, name string, type string, value string"
OCEL_OBJECT_ATTRS = "object_id string, name string, ts timestamp, type string, value string"
OCEL_TYPES = "kind string, type string, pos int, attr string, attr_type string"


@dataclass(frozen=True)
class EventLog:
    """A case-centric log.

    ``events``: case_id, event_idx (place in the case; any number that orders),
    activity, ts and, if there are any, attrs.  ``cases``: case_id, trace_idx and
    attrs; without it the cases are those of the events.
    """

    events: DataFrame
    cases: DataFrame | None = None
    meta: dict | None = None

    def case_frame(self) -> DataFrame:
        """One row a case, with empty cases if ``cases`` has them."""
        return self.cases if self.cases is not None else self.events.select("case_id").distinct()

    def with_events(self, events: DataFrame) -> EventLog:
        """The same cases and metadata with other events."""
        return replace(self, events=events)

    def without_events(self) -> EventLog:
        """All cases, no events."""
        return replace(self, events=self.events.limit(0), cases=self.case_frame())

    def without_cases(self) -> EventLog:
        """Metadata alone."""
        return replace(self, events=self.events.limit(0), cases=self.case_frame().limit(0))


@dataclass(frozen=True)
class Ocel:
    """An object-centric log as lazy tables (columns as in the schemas above).

    ``together`` may have events with their objects in one row; it counts as long
    as ``events`` and ``e2o`` are the tables that it was made with.
    """

    events: DataFrame
    objects: DataFrame
    e2o: DataFrame
    o2o: DataFrame
    event_attrs: DataFrame | None = None
    object_attrs: DataFrame | None = None
    types: DataFrame | None = None
    together: Together | None = None

    @property
    def spark(self) -> SparkSession:
        return self.events.sparkSession

    def event_attr_frame(self) -> DataFrame:
        return self.event_attrs if self.event_attrs is not None else self.spark.createDataFrame([], OCEL_EVENT_ATTRS)

    def object_attr_frame(self) -> DataFrame:
        return self.object_attrs if self.object_attrs is not None else self.spark.createDataFrame([], OCEL_OBJECT_ATTRS)

    def type_frame(self) -> DataFrame:
        """Declared types, or those that occur (attributes as found in the data)."""
        if self.types is not None:
            return self.types
        none = F.lit(None).cast("string")
        ev = self.events.select(F.lit("event").alias("kind"), F.col("event_type").alias("type")).distinct()
        ob = self.objects.select(F.lit("object").alias("kind"), F.col("object_type").alias("type")).distinct()
        return ev.unionByName(ob).select("kind", "type", F.lit(None).cast("int").alias("pos"), none.alias("attr"), none.alias("attr_type"))

    def pairs(self) -> DataFrame:
        """Distinct (event_id, object_id) of known events and objects, whatever the qualifier."""
        return self.e2o.select("event_id", "object_id").distinct()

    def rows(self) -> Checked | None:
        """Events with their known objects in one row, if the log has such rows and they pass the check."""
        return self.together.checked(self.events, self.objects, self.e2o) if self.together else None

    def linked(self, distinct: bool = True) -> DataFrame:
        """E2O with types and times: event_id, object_id, object_type, event_type, ts, event_idx; dangling rows are gone."""
        if distinct and (rows := self.rows()):
            return rows.linked()
        e2o = self.pairs() if distinct else self.e2o
        return e2o.join(self.objects.select("object_id", "object_type"), "object_id").join(
            self.events.select("event_id", "event_type", "ts", "event_idx"), "event_id"
        )
