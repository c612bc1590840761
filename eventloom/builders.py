"""Small logs from literals, and logs changed by rows (frames are immutable: a change is a new log)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Sequence
from dataclasses import replace
from datetime import datetime, timedelta

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from eventloom import model
from eventloom.model import EventLog, Ocel

START = datetime(2020, 1, 1)


def make_log(spark: SparkSession, traces: Iterable[Sequence[str]]) -> EventLog:
    """A log of activity sequences; events are one second apart."""
    rows, cases, at = [], [], 0
    for n, acts in enumerate(traces):
        cases.append((str(n), n, {"concept:name": str(n)}))
        for i, a in enumerate(acts):
            rows.append((str(n), i, a, START + timedelta(seconds=at), {}))
            at += 1
    return EventLog(spark.createDataFrame(rows, model.LOG_EVENTS), spark.createDataFrame(cases, model.LOG_CASES))


def make_ocel(spark: SparkSession, events: Iterable[tuple[str, Sequence[str]]], o2o: Iterable[tuple[str, str]] = ()) -> Ocel:
    """A log of (activity, object ids); an object's type is what its id has before ``:``, qualifiers are types."""
    ev, links, objects = [], [], {}
    kind = lambda o: o.split(":", 1)[0]
    for i, (act, ids) in enumerate(events):
        ev.append((f"ev:{i}", i, act, START + timedelta(seconds=i)))
        for o in ids:
            objects.setdefault(o, len(objects))
            links.append((f"ev:{i}", o, kind(o)))
    rel = [(a, b, kind(b)) for a, b in o2o]
    for pair in rel:
        for o in pair[:2]:
            objects.setdefault(o, len(objects))
    frame = spark.createDataFrame
    return Ocel(
        frame(ev, model.OCEL_EVENTS), frame([(o, i, kind(o)) for o, i in objects.items()], model.OCEL_OBJECTS), frame(links, model.OCEL_E2O), frame(rel, model.OCEL_O2O)
    )


def add_events(log: Ocel, rows: Iterable[tuple], links: Iterable[tuple] = ()) -> Ocel:
    """The log with events (event_id, event_idx, event_type, ts) and e2o (event_id, object_id, qualifier) added."""
    s = log.spark
    return replace(log, events=log.events.unionByName(s.createDataFrame(list(rows), model.OCEL_EVENTS)), e2o=log.e2o.unionByName(s.createDataFrame(list(links), model.OCEL_E2O)).distinct())


def add_objects(log: Ocel, rows: Iterable[tuple], links: Iterable[tuple] = ()) -> Ocel:
    """The log with objects (object_id, object_idx, object_type) and o2o (source_id, target_id, qualifier) added."""
    s = log.spark
    return replace(log, objects=log.objects.unionByName(s.createDataFrame(list(rows), model.OCEL_OBJECTS)), o2o=log.o2o.unionByName(s.createDataFrame(list(links), model.OCEL_O2O)).distinct())


def without_e2o(log: Ocel, event_id: str, object_id: str) -> Ocel:
    """The log without the relationships of an event and an object."""
    return replace(log, e2o=log.e2o.filter(~((F.col("event_id") == event_id) & (F.col("object_id") == object_id))))


def without_o2o(log: Ocel, source_id: str, target_id: str) -> Ocel:
    """The log without the relationships from one object to another."""
    return replace(log, o2o=log.o2o.filter(~((F.col("source_id") == source_id) & (F.col("target_id") == target_id))))


def declare_types(log: Ocel, kind: str, declared: dict[str, list[tuple[str, str]]]) -> Ocel:
    """The log with types declared; new attributes are appended, known ones get the new type."""
    found = {(r.kind, r.type): [] for r in log.type_frame().select("kind", "type").distinct().collect()}
    for r in log.type_frame().filter("attr IS NOT NULL").orderBy("pos").collect():
        found[r.kind, r.type].append((r.attr, r.attr_type))
    for t, attrs in declared.items():
        known = dict(found.get((kind, t), []))
        known.update(attrs)
        found[kind, t] = list(known.items())
    rows = [(k, t, i, a, at) for (k, t), attrs in found.items() for i, (a, at) in enumerate(attrs or [(None, None)])]
    return replace(log, types=log.spark.createDataFrame(rows, model.OCEL_TYPES))


class Appender:
    """Takes events and objects in any order, a batch at a time, and gives a log.

    Relationships may name what comes later; those that never come are left out
    by ``finalize``.  Where an id is missing, one is made of what is appended.
    """

    def __init__(self, spark: SparkSession, batch: int = 50_000):
        self.spark, self.batch, self.types = spark, batch, []
        self.schemas = {
            "events": model.OCEL_EVENTS, "objects": model.OCEL_OBJECTS, "e2o": model.OCEL_E2O, "o2o": model.OCEL_O2O,
            "event_attrs": model.OCEL_EVENT_ATTRS, "object_attrs": model.OCEL_OBJECT_ATTRS,
        }
        self.rows: dict[str, list] = {k: [] for k in self.schemas}
        self.parts: dict[str, list] = {k: [] for k in self.schemas}
        self.count = {"events": 0, "objects": 0}

    def _put(self, name: str, rows: Iterable[tuple]) -> None:
        held = self.rows[name]
        held.extend(rows)
        if len(held) >= self.batch:
            self.parts[name].append(self.spark.createDataFrame(held, self.schemas[name]))
            self.rows[name] = []

    def declare(self, kind: str, name: str, attributes: Iterable[tuple[str, str]] = ()) -> None:
        """Declare an event or object type (kind) with attributes (name, type)."""
        self.types += [(kind, name, i, a, t) for i, (a, t) in enumerate(attributes)] or [(kind, name, 0, None, None)]

    def _id(self, kind: str, given: str | None, *parts: object) -> str:
        n = self.count[kind]
        self.count[kind] += 1
        return given if given is not None else hashlib.sha256(repr((kind, n, *parts)).encode()).hexdigest()[:32]

    def event(self, name: str, ts: datetime, event_id: str | None = None, attributes: Iterable[tuple[str, str, str]] = (), objects: Iterable[tuple[str, str]] = ()) -> str:
        """Append an event with attributes (name, type, value) and objects (id, qualifier); returns its id."""
        place = self.count["events"]
        event_id = self._id("events", event_id, name, ts)
        self._put("events", [(event_id, place, name, ts)])
        self._put("event_attrs", [(event_id, *a) for a in attributes])
        self._put("e2o", [(event_id, o, q) for o, q in objects])
        return event_id

    def object(self, name: str, object_id: str | None = None, attributes: Iterable[tuple[str, datetime, str, str]] = (), objects: Iterable[tuple[str, str]] = ()) -> str:
        """Append an object with attributes (name, time, type, value) and related objects (id, qualifier); returns its id."""
        place = self.count["objects"]
        object_id = self._id("objects", object_id, name)
        self._put("objects", [(object_id, place, name)])
        self._put("object_attrs", [(object_id, *a) for a in attributes])
        self._put("o2o", [(object_id, o, q) for o, q in objects])
        return object_id

    def finalize(self) -> Ocel:
        """The log of all that was appended."""
        from eventloom.operators.objectcentric import without_dangling

        frames = {}
        for name, schema in self.schemas.items():
            out = self.spark.createDataFrame(self.rows[name], schema)
            for part in self.parts[name]:
                out = part.unionByName(out)
            frames[name] = out
        types = self.spark.createDataFrame(self.types, model.OCEL_TYPES) if self.types else None
        return without_dangling(Ocel(**frames, types=types))
