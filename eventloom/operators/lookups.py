"""What a log knows of single events and objects, by id: small frames, filtered before anything is joined."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.model import Ocel

_EVENT, _OBJECT = ("event_id", "event_type", "ts"), ("object_id", "object_type")


def event_types(log: Ocel) -> DataFrame:
    """Names of the log's event types, declared or found: type."""
    return log.type_frame().filter("kind = 'event'").select("type").distinct()


def object_types(log: Ocel) -> DataFrame:
    """Names of the log's object types, declared or found: type."""
    return log.type_frame().filter("kind = 'object'").select("type").distinct()


def attributes_of_type(log: Ocel, kind: str, name: str) -> DataFrame:
    """Declared attributes of an event or object type (``kind``): pos, attr, attr_type."""
    return log.type_frame().filter((F.col("kind") == kind) & (F.col("type") == name) & F.col("attr").isNotNull()).select("pos", "attr", "attr_type")


def event_ids_of_type(log: Ocel, event_type: str) -> DataFrame:
    """Ids of the events of a type: event_id."""
    return log.events.filter(F.col("event_type") == event_type).select("event_id")


def object_ids_of_type(log: Ocel, object_type: str) -> DataFrame:
    """Ids of the objects of a type: object_id."""
    return log.objects.filter(F.col("object_type") == object_type).select("object_id")


def event_of_id(log: Ocel, event_id: str) -> DataFrame:
    """Type and time of an event: event_id, event_type, ts; no row for an unknown id."""
    return log.events.filter(F.col("event_id") == event_id).select(*_EVENT)


def object_of_id(log: Ocel, object_id: str) -> DataFrame:
    """Type of an object: object_id, object_type; no row for an unknown id."""
    return log.objects.filter(F.col("object_id") == object_id).select(*_OBJECT)


def objects_of_event(log: Ocel, event_id: str) -> DataFrame:
    """Objects of an event: object_id, object_type, qualifier."""
    return log.e2o.filter(F.col("event_id") == event_id).join(log.objects.select(*_OBJECT), "object_id").select(*_OBJECT, "qualifier")


def events_of_object(log: Ocel, object_id: str) -> DataFrame:
    """Events of an object: event_id, event_type, ts, qualifier."""
    return log.e2o.filter(F.col("object_id") == object_id).join(log.events.select(*_EVENT), "event_id").select(*_EVENT, "qualifier")


def related_from(log: Ocel, object_id: str) -> DataFrame:
    """Objects to which an object is related: object_id, object_type, qualifier."""
    rows = log.o2o.filter(F.col("source_id") == object_id).select(F.col("target_id").alias("object_id"), "qualifier")
    return rows.join(log.objects.select(*_OBJECT), "object_id").select(*_OBJECT, "qualifier")


def related_to(log: Ocel, object_id: str) -> DataFrame:
    """Objects that are related to an object: object_id, object_type, qualifier."""
    rows = log.o2o.filter(F.col("target_id") == object_id).select(F.col("source_id").alias("object_id"), "qualifier")
    return rows.join(log.objects.select(*_OBJECT), "object_id").select(*_OBJECT, "qualifier")


def object_trace(log: Ocel, object_id: str) -> DataFrame:
    """Activities of an object's events in order, each event once: place (from 0), event_id, event_type, ts."""
    rows = log.e2o.filter(F.col("object_id") == object_id).select("event_id").distinct().join(log.events, "event_id")
    sort = F.array_sort(F.collect_list(F.struct("ts", "event_idx", "event_id", "event_type")))  # one object's
    return rows.agg(sort.alias("x")).select(F.posexplode("x").alias("place", "x")).select("place", "x.event_id", "x.event_type", "x.ts")


def event_attribute(log: Ocel, event_id: str, name: str) -> DataFrame:
    """An attribute of an event: type, value."""
    return log.event_attr_frame().filter((F.col("event_id") == event_id) & (F.col("name") == name)).select("type", "value")


def object_attribute_values(log: Ocel, object_id: str, name: str) -> DataFrame:
    """The values of an attribute of an object: ts, type, value."""
    return log.object_attr_frame().filter((F.col("object_id") == object_id) & (F.col("name") == name)).select("ts", "type", "value")


def full_event(log: Ocel, event_id: str) -> DataFrame:
    """One row of all that the log has of an event: event_id, event_type, ts, attributes, relationships."""
    attrs = log.event_attr_frame().filter(F.col("event_id") == event_id).groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct("name", "type", "value"))).alias("attributes"))
    links = log.e2o.filter(F.col("event_id") == event_id).groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct("object_id", "qualifier"))).alias("relationships"))
    return event_of_id(log, event_id).join(attrs, "event_id", "left").join(links, "event_id", "left")


def full_object(log: Ocel, object_id: str) -> DataFrame:
    """One row of all that the log has of an object: object_id, object_type, attributes, relationships."""
    attrs = log.object_attr_frame().filter(F.col("object_id") == object_id).groupBy("object_id").agg(F.array_sort(F.collect_list(F.struct("ts", "name", "type", "value"))).alias("attributes"))
    links = log.o2o.filter(F.col("source_id") == object_id).groupBy(F.col("source_id").alias("object_id")).agg(F.array_sort(F.collect_list(F.struct("target_id", "qualifier"))).alias("relationships"))
    return object_of_id(log, object_id).join(attrs, "object_id", "left").join(links, "object_id", "left")


def num_events(log: Ocel) -> DataFrame:
    """Number of events: n."""
    return log.events.agg(F.count("*").alias("n"))


def num_objects(log: Ocel) -> DataFrame:
    """Number of objects: n."""
    return log.objects.agg(F.count("*").alias("n"))
