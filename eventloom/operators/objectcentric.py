"""Operators over object-centric logs as lazy plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventloom.model import EventLog, Ocel
from eventloom.operators.segments import Along, hot_keys

EPOCH = "1970-01-01 00:00:00"
#: The order of an object's events.
_ORDER = ("ts", "event_idx", "event_id")


# -- lookups and statistics ------------------------------------------------------------


def events_of_type(log: Ocel, event_type: str) -> DataFrame:
    """Events of a type."""
    return log.events.filter(F.col("event_type") == event_type)


def objects_of_type(log: Ocel, object_type: str) -> DataFrame:
    """Objects of a type."""
    return log.objects.filter(F.col("object_type") == object_type)


def event(log: Ocel, event_id: str) -> DataFrame:
    """The event of an id with its attributes and relationships gathered."""
    attrs = log.event_attr_frame().groupBy("event_id").agg(F.collect_list(F.struct("name", "type", "value")).alias("attributes"))
    links = log.e2o.groupBy("event_id").agg(F.array_sort(F.collect_set(F.struct("object_id", "qualifier"))).alias("relationships"))
    return log.events.filter(F.col("event_id") == event_id).join(attrs, "event_id", "left").join(links, "event_id", "left")


def object_(log: Ocel, object_id: str) -> DataFrame:
    """The object of an id with its attribute history and relationships gathered."""
    attrs = log.object_attr_frame().groupBy("object_id").agg(F.array_sort(F.collect_list(F.struct("name", "ts", "type", "value"))).alias("attributes"))
    links = log.o2o.groupBy(F.col("source_id").alias("object_id")).agg(F.array_sort(F.collect_set(F.struct("target_id", "qualifier"))).alias("relationships"))
    return log.objects.filter(F.col("object_id") == object_id).join(attrs, "object_id", "left").join(links, "object_id", "left")


def hot_objects(log: Ocel, name: str = "object_id") -> DataFrame | None:
    """The objects of more than one in ``HOT_SHARE`` relationships; None if it is known that there are none."""
    rows = log.rows()
    return rows.hot_frame(name) if rows else hot_keys(log.e2o.select(F.col("object_id").alias(name)), name)


def objects_of_events(log: Ocel, object_type: str | None = None, qualifier: str | None = None) -> DataFrame:
    """E2O from the events' side: event_id, object_id, object_type, qualifier."""
    e2o = log.e2o if qualifier is None else log.e2o.filter(F.col("qualifier") == qualifier)
    objects = log.objects if object_type is None else objects_of_type(log, object_type)
    return e2o.join(objects.select("object_id", "object_type"), "object_id").select("event_id", "object_id", "object_type", "qualifier").distinct()


def events_of_objects(log: Ocel, event_type: str | None = None, qualifier: str | None = None) -> DataFrame:
    """E2O from the objects' side: object_id, event_id, event_type, qualifier."""
    e2o = log.e2o if qualifier is None else log.e2o.filter(F.col("qualifier") == qualifier)
    events = log.events if event_type is None else events_of_type(log, event_type)
    return e2o.join(events.select("event_id", "event_type"), "event_id").select("object_id", "event_id", "event_type", "qualifier").distinct()


def related_objects(log: Ocel, reverse: bool = False, object_type: str | None = None, qualifier: str | None = None) -> DataFrame:
    """O2O of known objects: object_id, other_id, other_type, qualifier; ``reverse`` looks against the arrows."""
    a, b = ("target_id", "source_id") if reverse else ("source_id", "target_id")
    o2o = log.o2o if qualifier is None else log.o2o.filter(F.col("qualifier") == qualifier)
    others = log.objects if object_type is None else objects_of_type(log, object_type)
    rows = o2o.select(F.col(a).alias("object_id"), F.col(b).alias("other_id"), "qualifier")
    rows = rows.join(others.select(F.col("object_id").alias("other_id"), F.col("object_type").alias("other_type")), "other_id")
    return rows.join(log.objects.select("object_id"), "object_id", "left_semi").select("object_id", "other_id", "other_type", "qualifier").distinct()


def without_orphans(log: Ocel) -> Ocel:
    """The log without objects that no event has."""
    return Ocel(log.events, log.objects.join(log.e2o.select("object_id"), "object_id", "left_semi"), log.e2o, log.o2o, log.event_attrs, log.object_attrs, log.types)


def without_dangling(log: Ocel) -> Ocel:
    """The log without relationships of unknown events or objects."""
    ids = log.objects.select("object_id")
    e2o = log.e2o.join(ids, "object_id", "left_semi").join(log.events.select("event_id"), "event_id", "left_semi")
    o2o = log.o2o.join(ids.withColumnRenamed("object_id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("object_id", "target_id"), "target_id", "left_semi")
    return Ocel(log.events, log.objects, e2o, o2o, log.event_attrs, log.object_attrs, log.types)


def size(log: Ocel) -> DataFrame:
    """num_events and num_objects."""
    return log.events.agg(F.count("*").alias("num_events")).crossJoin(log.objects.agg(F.count("*").alias("num_objects")))


def type_stats(log: Ocel) -> DataFrame:
    """Events and objects of every declared type: kind, type, cnt (0 for types without any)."""
    found = log.events.groupBy(F.lit("event").alias("kind"), F.col("event_type").alias("type")).agg(F.count("*").alias("n"))
    found = found.unionByName(log.objects.groupBy(F.lit("object").alias("kind"), F.col("object_type").alias("type")).agg(F.count("*").alias("n")))
    declared = log.type_frame().select("kind", "type").distinct()
    return declared.join(found, ["kind", "type"], "left").select("kind", "type", F.coalesce("n", F.lit(0)).cast("long").alias("cnt"))


def type_link_counts(log: Ocel) -> DataFrame:
    """E2O rows, one a qualifier, by event and object type: event_type, object_type, cnt."""
    return log.linked(distinct=False).groupBy("event_type", "object_type").agg(F.count("*").alias("cnt"))


def conversion_rate(log: Ocel, activity: str, source_type: str, target_type: str) -> DataFrame:
    """Share of source objects with a related target that takes part in an activity (0.0 without sources): rate."""
    sources = objects_of_type(log, source_type).select("object_id")
    done = log.pairs().join(events_of_type(log, activity).select("event_id"), "event_id", "left_semi").select("object_id")
    targets = objects_of_type(log, target_type).select("object_id").join(done, "object_id", "left_semi")
    reached = log.o2o.join(targets.withColumnRenamed("object_id", "target_id"), "target_id", "left_semi").select(F.col("source_id").alias("object_id"))
    flagged = sources.join(reached.distinct().withColumn("_hit", F.lit(1)), "object_id", "left")
    return flagged.agg(F.coalesce(F.try_divide(F.count("_hit"), F.count("*")), F.lit(0.0)).cast("double").alias("rate"))


def involvement(log: Ocel) -> DataFrame:
    """Objects of a type that an event of an activity has, where it has any: event_type, object_type, least, most."""
    each = log.linked(distinct=False).groupBy("event_id", "event_type", "object_type").agg(F.count("*").alias("n"))
    return each.groupBy("event_type", "object_type").agg(F.min("n").alias("least"), F.max("n").alias("most"))


def object_involvement(log: Ocel, reverse: bool = False) -> DataFrame:
    """Related objects of a type that an object of a type has, where it has any: object_type, other_type, least, most."""
    a, b = ("target_id", "source_id") if reverse else ("source_id", "target_id")
    kinds = log.objects.select("object_id", "object_type")
    rows = log.o2o.join(kinds.select(F.col("object_id").alias(a), "object_type"), a).join(kinds.select(F.col("object_id").alias(b), F.col("object_type").alias("other_type")), b)
    each = rows.groupBy(a, "object_type", "other_type").agg(F.count("*").alias("n"))
    return each.groupBy("object_type", "other_type").agg(F.min("n").alias("least"), F.max("n").alias("most"))


# -- sequences -------------------------------------------------------------------------


def object_dfg(log: Ocel, object_type: str | None = None) -> DataFrame:
    """Directly-follows relations along objects, each event once an object: object_type, from_activity, to_activity, cnt."""
    rows = log.linked()
    if object_type is not None:
        rows = rows.filter(F.col("object_type") == object_type)
    return _followed(log, rows)


def _followed(log: Ocel, rows: DataFrame) -> DataFrame:
    """Directly-follows relations along the objects of ``rows``: object_type, from_activity, to_activity, cnt."""
    rows = rows.select("object_id", "object_type", "event_type", "ts", "event_idx", "event_id")
    pairs = Along(rows, "object_id", hot_objects(log), _ORDER).with_neighbours({"to_activity": "event_type"})
    return pairs.filter("to_activity IS NOT NULL").groupBy("object_type", F.col("event_type").alias("from_activity"), "to_activity").agg(F.count("*").alias("cnt"))


def flatten(log: Ocel, object_type: str) -> EventLog:
    """The case-centric log of an object type: a case is an object, an event counts once a qualifier.

    Events keep their attributes.  Cases have the first value of each attribute of
    their object that is a number or text, and ``trace_idx`` by their first event
    (cases without events first).
    """
    objects = objects_of_type(log, object_type).select("object_id")
    rows = log.e2o.join(objects, "object_id").join(log.events.select("event_id", "event_idx", "event_type", "ts"), "event_id")
    entries = F.map_from_entries(F.sort_array(F.collect_set(F.struct("name", "value"))))
    if log.event_attrs is not None:
        own = log.event_attrs.groupBy("event_id", "name").agg(F.first("value").alias("value")).groupBy("event_id").agg(entries.alias("attrs"))
        rows = rows.join(own, "event_id", "left")
    else:
        rows = rows.withColumn("attrs", F.lit(None).cast("map<string,string>"))
    none = F.map_from_arrays(F.array(), F.array()).cast("map<string,string>")
    events = rows.select(F.col("object_id").alias("case_id"), "event_idx", F.col("event_type").alias("activity"), "ts", F.coalesce("attrs", none).alias("attrs"), "event_id")
    first = events.groupBy(F.col("case_id").alias("object_id")).agg(F.min("ts").alias("_first"))
    cases = objects.join(first, "object_id", "left")
    if log.object_attrs is not None:
        place = F.struct("ts", _change_place(log.object_attrs))
        kept = log.object_attrs.filter(F.col("type").isin("integer", "float", "string"))
        own = kept.groupBy("object_id", "name").agg(F.min_by("value", place).alias("value")).groupBy("object_id").agg(entries.alias("attrs"))
        cases = cases.join(own, "object_id", "left")
    else:
        cases = cases.withColumn("attrs", F.lit(None).cast("map<string,string>"))
    return EventLog(events, cases.select(F.col("object_id").alias("case_id"), F.coalesce(F.unix_micros("_first"), F.lit(-(1 << 62))).alias("trace_idx"), F.coalesce("attrs", none).alias("attrs")))


def _change_place(changes: DataFrame) -> Column:
    """What orders changes of one time: the input order where the table has it (``idx``), else the value."""
    return F.struct("idx", "value") if "idx" in changes.columns else F.struct("value")


def flattened_dfg(log: Ocel) -> DataFrame:
    """Directly-follows graphs of all flattened types in one plan: object_type, from_activity, to_activity, cnt."""
    return _followed(log, log.linked(distinct=False))


def object_variants(log: Ocel, object_type: str) -> DataFrame:
    """Activity sequences of the objects of a type (empty without events): variant, freq."""
    rows = log.linked().filter(F.col("object_type") == object_type)
    own = rows.groupBy("object_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_idx", "event_id", "event_type"))), lambda x: x["event_type"]).alias("variant"))
    every = objects_of_type(log, object_type).select("object_id").join(own, "object_id", "left")
    return every.groupBy(F.coalesce("variant", F.array().cast("array<string>")).alias("variant")).agg(F.count("*").alias("freq"))


def predecessors(log: Ocel) -> DataFrame:
    """For each event and object the time of the event before it on that object: event_id, event_type, ts, object_id, prev_ts."""
    rows = log.linked().select("event_id", "event_type", "ts", "object_id")
    return Along(rows, "object_id", hot_objects(log), ("ts", "event_id")).with_neighbours(lag={"prev_ts": "ts"})


def synchronisation(log: Ocel) -> DataFrame:
    """Time between the first and last predecessor of an event over its objects.

    event_id, event_type, sync_us and delaying_object (that of the latest
    predecessor, the smallest id of several); events without predecessor are absent.
    """
    late = F.struct((-F.unix_micros("prev_ts")).alias("t"), F.col("object_id").alias("o"))
    a = predecessors(log).filter("prev_ts IS NOT NULL").groupBy("event_id", "event_type").agg(
        (F.unix_micros(F.max("prev_ts")) - F.unix_micros(F.min("prev_ts"))).alias("sync_us"), F.min(late)["o"].alias("delaying_object")
    )
    return a.select("event_id", "event_type", "sync_us", "delaying_object")


def sojourn(log: Ocel) -> DataFrame:
    """Time of an event since its last predecessor over its objects: event_id, event_type, sojourn_us."""
    a = predecessors(log).filter("prev_ts IS NOT NULL").groupBy("event_id", "event_type", "ts").agg(F.max("prev_ts").alias("p"))
    return a.select("event_id", "event_type", (F.unix_micros("ts") - F.unix_micros("p")).alias("sojourn_us"))


def longest(rows: DataFrame, value: str, k: int) -> DataFrame:
    """The k rows of greatest value, ties by event id."""
    return rows.orderBy(F.desc(value), "event_id").limit(k)


def attribute_history(log: Ocel, object_type: str) -> DataFrame:
    """Attribute values of objects of a type as intervals: object_id, change_id, from_ts, to_ts, attrs (map).

    Row 0 is the time before the first value; every later row holds the values
    valid from then on, carried forward; changes of one time make one row, in which
    the last of an attribute in input order counts.
    """
    rows = log.object_attr_frame().join(objects_of_type(log, object_type).select("object_id"), "object_id", "left_semi")
    names = sorted(r[0] for r in rows.select("name").distinct().collect())  # a type's attributes
    place = _change_place(rows)
    columns = [f"_{i}" for i in range(len(names))]
    now = [F.max_by(F.when(F.col("name") == n, F.col("value")), F.when(F.col("name") == n, place)).alias(c) for n, c in zip(names, columns)]
    at = rows.groupBy("object_id", "ts").agg(F.count("*").alias("_n"), *now)
    w = W.partitionBy("object_id").orderBy("ts")
    none = F.map_from_arrays(F.array(), F.array()).cast("map<string,string>")
    known = at.select("object_id", F.row_number().over(w).alias("n"), F.col("ts").alias("from_ts"), F.lead("ts").over(w).alias("to_ts"), *[F.last(c, ignorenulls=True).over(w).alias(c) for c in columns])
    entries = F.filter(F.array(*[F.struct(F.lit(n).alias("key"), F.col(c).alias("value")) for n, c in zip(names, columns)]), lambda x: x["value"].isNotNull()) if names else None
    known = known.withColumn("attrs", F.map_from_entries(entries) if names else none)
    # row 0 goes with the first change
    rows = known.withColumn("_copy", F.explode(F.when(F.col("n") == 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1)))))
    zero = F.col("_copy") == 0
    return rows.select(
        "object_id",
        F.concat("object_id", F.lit("-attrs-"), F.when(zero, F.lit(0)).otherwise(F.col("n")).cast("string")).alias("change_id"),
        F.when(~zero, F.col("from_ts")).alias("from_ts"),
        F.when(zero, F.col("from_ts")).otherwise(F.col("to_ts")).alias("to_ts"),
        F.when(zero, none).otherwise(F.col("attrs")).alias("attrs"),
    )


def attribute_changes(log: Ocel, object_id: str) -> DataFrame:
    """Changes of one object by attribute: name, changes (time-ordered array); an unknown id is an error."""
    if log.objects.filter(F.col("object_id") == object_id).isEmpty():
        raise KeyError(object_id)
    rows = log.object_attr_frame().filter(F.col("object_id") == object_id)
    return rows.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("ts", "type", "value"))).alias("changes"))


def first_last(log: Ocel) -> DataFrame:
    """First and last event time of every object (epoch for objects without events): object_id, object_type, first_ts, last_ts."""
    span = log.linked().groupBy("object_id").agg(F.min("ts").alias("f"), F.max("ts").alias("l"))
    epoch = F.lit(EPOCH).cast("timestamp")
    return log.objects.select("object_id", "object_type").join(span, "object_id", "left").select(
        "object_id", "object_type", F.coalesce("f", epoch).alias("first_ts"), F.coalesce("l", epoch).alias("last_ts")
    )


def with_init_exit(log: Ocel) -> Ocel:
    """The log with an ``<init> T`` and an ``<exit> T`` event for every object of type T, at its first and last time."""
    span = first_last(log)
    one = lambda kind, ts: span.select(
        F.concat(F.lit(f"<{kind}> "), "object_id").alias("event_id"), F.concat(F.lit(f"<{kind}> "), "object_type").alias("event_type"), F.col(ts).alias("ts"), "object_id"
    )
    new = one("init", "first_ts").unionByName(one("exit", "last_ts"))
    # before, respectively after, every event of the same time
    idx = F.when(F.col("event_type").startswith("<init> "), F.lit(-1)).otherwise(F.lit((1 << 62)))
    events = log.events.select("event_id", "event_idx", "event_type", "ts").unionByName(new.select("event_id", idx.cast("long").alias("event_idx"), "event_type", "ts"))
    e2o = log.e2o.unionByName(new.select("event_id", "object_id", F.lit("").alias("qualifier")))
    types = None
    if log.types is not None:  # what is declared stays so, and the new types are declared too
        kinds = log.types.filter("kind = 'object'").select("type").distinct().withColumn("made", F.explode(F.array(F.lit("<init> "), F.lit("<exit> "))))
        made = kinds.select(F.lit("event").alias("kind"), F.concat("made", "type").alias("type"))
        types = log.types.unionByName(made, allowMissingColumns=True)
    return Ocel(events, log.objects, e2o, log.o2o, log.event_attrs, log.object_attrs, types)


# -- language abstraction --------------------------------------------------------------


def abstraction(log: Ocel) -> DataFrame:
    """Language abstraction of a log in long form: property, object_type, ev_a, ev_b.

    Properties: related, deficient, optional, convergent, divergent (ev_b null),
    start, end (of object traces) and df (directly follows).  Relationships are
    shuffled by event, then by object; what is left after that is the size of the
    types.  The objects of other types that an event has are compared by 64-bit
    order-free hashes.
    """
    event, of_type = W.partitionBy("event_id"), W.partitionBy("event_id", "object_type")
    rows = log.linked().withColumn("h", F.xxhash64("object_id"))
    rows = rows.select(
        "object_id", "object_type", "event_type", "event_id", "ts", "event_idx",
        F.bit_xor("h").over(event).bitwiseXOR(F.bit_xor("h").over(of_type)).alias("others"),
        (F.count("*").over(of_type) > 1).alias("several"),
        (F.col("object_id") == F.min("object_id").over(of_type)).cast("int").alias("once_type"),
        (F.col("object_id") == F.min("object_id").over(event)).cast("int").alias("once"),
    )
    rows = Along(rows, "object_id", hot_objects(log), _ORDER).with_neighbours({"next": "event_type"}, place="place")
    # an object's events of a type are summed where they are, then by object: a hot one is no group of rows
    per_object = rows.groupBy("object_id", "object_type", "event_type", "next").agg(
        F.max("several").alias("several"), F.min("others").alias("lo"), F.max("others").alias("hi"), F.max(F.col("place") == 1).alias("first"),
        F.sum("once_type").alias("n_ot"), F.sum("once").alias("n_one"),
    )
    same = W.partitionBy("object_id", "event_type")
    per_object = per_object.withColumns({"varies": F.min("lo").over(same) != F.max("hi").over(same), "new": (F.row_number().over(same.orderBy("next")) == 1).cast("int")})
    each = per_object.groupBy("object_type", "event_type", "next").agg(
        F.max("several").alias("several"), F.max("varies").alias("varies"), F.max("first").alias("first"),
        F.sum("n_ot").alias("n_ot"), F.sum("n_one").alias("n_one"), F.sum("new").alias("n_obj"),
    )
    per = each.groupBy("object_type", "event_type").agg(
        F.max("several").alias("several"), F.max("varies").alias("varies"), F.max("first").alias("first"), F.max(F.col("next").isNull()).alias("last"),
        F.collect_set("next").alias("nexts"), F.sum("n_ot").alias("n_ot"), F.sum("n_one").alias("n_one"), F.sum("n_obj").alias("n_obj"),
    )
    # a row for each event type that has objects, or for each object type if it never has any
    per = per.withColumn("n_any", F.sum("n_one").over(W.partitionBy("event_type")))
    objects = log.objects.groupBy("object_type").agg(F.count("*").alias("n_all"))
    types = log.events.select("event_type").distinct().crossJoin(F.broadcast(objects))  # types by types: the model's size
    per = types.join(per, ["object_type", "event_type"], "left").withColumn("bare", F.max("n_any").over(W.partitionBy("event_type")).isNull())
    related = F.col("n_ot").isNotNull()
    flags = {
        "related": related | F.col("bare"), "deficient": F.col("n_ot") < F.col("n_any"), "optional": F.col("bare") | (F.col("n_obj") < F.col("n_all")),
        "convergent": F.col("several"), "divergent": F.col("varies"), "start": F.col("first"), "end": F.col("last"),
    }
    none = F.lit(None).cast("string")
    single = F.filter(F.array(*[F.struct(F.lit(k).alias("property"), none.alias("ev_b"), F.coalesce(v, F.lit(False)).alias("holds")) for k, v in flags.items()]), lambda x: x["holds"])
    pairs = F.transform(F.coalesce("nexts", F.array().cast("array<string>")), lambda x: F.struct(F.lit("df").alias("property"), x.alias("ev_b"), F.lit(True).alias("holds")))
    out = per.select("object_type", F.col("event_type").alias("ev_a"), F.explode(F.concat(single, pairs)).alias("p"))
    return out.select("p.property", "object_type", "ev_a", "p.ev_b")


# -- frames ----------------------------------------------------------------------------


def frames(log: Ocel) -> dict[str, DataFrame]:
    """The five interchange frames: events, objects, e2o, o2o, object_changes (``ocel:`` columns)."""
    kinds = log.objects.select(F.col("object_id").alias("o"), F.col("object_type").alias("t"))
    ev = log.events.select("event_id", F.col("event_type").alias("ocel:activity"), F.col("ts").alias("ocel:timestamp"))
    ea = log.event_attr_frame()
    names = sorted(r[0] for r in ea.select("name").distinct().collect())  # declared attributes: the schema's size
    if names:
        ev = ev.join(ea.groupBy("event_id").pivot("name", names).agg(F.first("value")), "event_id", "left")
    oa = log.object_attr_frame().filter(F.col("ts") == F.lit(EPOCH).cast("timestamp"))
    names = sorted(r[0] for r in log.object_attr_frame().select("name").distinct().collect())
    ob = log.objects.select("object_id", F.col("object_type").alias("ocel:type"))
    if names:
        ob = ob.join(oa.groupBy("object_id").pivot("name", names).agg(F.first("value")), "object_id", "left")
    changes = log.object_attr_frame().filter(F.col("ts") != F.lit(EPOCH).cast("timestamp")).join(kinds, F.col("object_id") == F.col("o"), "left")
    e2o = log.e2o.join(log.events.select("event_id", "event_type", "ts"), "event_id", "left").join(kinds, F.col("object_id") == F.col("o"), "left")
    return {
        "events": ev.withColumnRenamed("event_id", "ocel:eid"),
        "objects": ob.withColumnRenamed("object_id", "ocel:oid"),
        "e2o": e2o.select(F.col("event_id").alias("ocel:eid"), F.col("event_type").alias("ocel:activity"), F.col("ts").alias("ocel:timestamp"), F.col("object_id").alias("ocel:oid"), F.col("t").alias("ocel:type"), F.col("qualifier").alias("ocel:qualifier")),
        "o2o": log.o2o.select(F.col("source_id").alias("ocel:oid"), F.col("target_id").alias("ocel:oid_2"), F.col("qualifier").alias("ocel:qualifier")),
        "object_changes": changes.select(F.col("object_id").alias("ocel:oid"), F.col("t").alias("ocel:type"), F.col("ts").alias("ocel:timestamp"), F.col("name").alias("ocel:field"), F.col("value")),
    }


def frames_of_type(log: Ocel, kind: str, name: str) -> DataFrame:
    """Events (kind event) or objects (kind object) of one type with a column for each of its attributes.

    Events: event_id, ts; objects: object_id.  Attribute columns start with ``attr:``;
    an object's are the values at the start.
    """
    if kind == "event":
        rows, attrs, key = events_of_type(log, name).select("event_id", "ts"), log.event_attr_frame(), "event_id"
    else:
        rows, attrs, key = objects_of_type(log, name).select("object_id"), log.object_attr_frame().filter(F.col("ts") == F.lit(EPOCH).cast("timestamp")), "object_id"
    own = attrs.join(rows.select(key), key, "left_semi")
    names = sorted(r[0] for r in own.select("name").distinct().collect())  # a type's attributes
    if not names:
        return rows
    wide = own.groupBy(key).pivot("name", names).agg(F.first("value"))
    return rows.join(wide.select(key, *[F.col(f"`{n}`").alias(f"attr:{n}") for n in names]), key, "left")


def type_pair_links(log: Ocel, event_type: str, object_type: str) -> DataFrame:
    """Relationships of an event type with an object type, in the order of ids: event_id, object_id, qualifier."""
    rows = log.e2o.join(events_of_type(log, event_type).select("event_id"), "event_id", "left_semi").join(objects_of_type(log, object_type).select("object_id"), "object_id", "left_semi")
    return rows.select("event_id", "object_id", "qualifier").orderBy("event_id", "object_id", "qualifier")


def type_pair_objects(log: Ocel, source_type: str, target_type: str) -> DataFrame:
    """Relationships between objects of two types, in the order of ids: source_id, target_id, qualifier."""
    a, b = (objects_of_type(log, t).select(F.col("object_id").alias(c)) for t, c in ((source_type, "source_id"), (target_type, "target_id")))
    rows = log.o2o.join(a, "source_id", "left_semi").join(b, "target_id", "left_semi")
    return rows.select("source_id", "target_id", "qualifier").orderBy("source_id", "target_id", "qualifier")


def object_dfg_json(log: Ocel) -> str:
    """The object-centric directly-follows graph as JSON: for each object type its edges with counts."""
    import json

    out: dict = {}
    for r in object_dfg(log).orderBy("object_type", "from_activity", "to_activity").collect():  # types by types
        out.setdefault(r.object_type, []).append([[r.from_activity, r.to_activity], r.cnt])
    return json.dumps({"object_type_to_dfg": out})


def object_dfg_dot(text: str) -> str:
    """DOT source of such a graph; an edge's label has its object type and count."""
    import json

    quoted = lambda x: json.dumps(x, ensure_ascii=False)
    lines = [f"  {quoted(a)} -> {quoted(b)} [label={quoted(f'{k}: {n}')}];" for k, edges in json.loads(text)["object_type_to_dfg"].items() for (a, b), n in edges]
    return "\n".join(["digraph {", *lines, "}"])
