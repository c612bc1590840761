"""Object-centric logs as JSON, XML, CSV and SQL databases, by one in-between form."""

from __future__ import annotations

import csv
import io
import json
import os
import sqlite3
import tempfile
import uuid
from collections import defaultdict
from collections.abc import Iterator
from contextlib import closing
from dataclasses import replace
from datetime import datetime
from functools import partial
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom import model
from eventloom.functions import timestamps, values
from eventloom.model import Ocel
from eventloom.sources import json_stream, sink

_TYPE = "array<struct<name:string,attributes:array<struct<name:string,type:string>>>>"
_LINKS = "relationships:array<struct<objectId:string,qualifier:string>>"
JSON_SCHEMA = (
    f"eventTypes {_TYPE}, objectTypes {_TYPE}, "
    f"events array<struct<id:string,type:string,time:string,attributes:array<struct<name:string,value:string>>,{_LINKS}>>, "
    f"objects array<struct<id:string,type:string,attributes:array<struct<name:string,time:string,value:string>>,{_LINKS}>>"
)
_LINE_ENDS = {"\n": "&#10;", "\r": "&#13;"}
FORMATS = {"json": "json", "jsonocel": "json", "xml": "xml", "xmlocel": "xml", "ocel.csv": "csv", "csv": "csv", "sqlite": "sqlite", "db": "sqlite", "duckdb": "duckdb"}


def infer_format(path: str) -> str | None:
    """The format that a path's ending names; ``.gz`` and ``ocel.csv`` are double endings."""
    parts = os.path.basename(path.rstrip("/")).lower().removesuffix(".gz").split(".")
    return FORMATS.get(".".join(parts[-2:])) or FORMATS.get(parts[-1])


def read_ocel(spark: SparkSession, path: str, kind: str | None = None) -> Ocel:
    """A log of any supported format; dangling relationships stay (see ``without_dangling``)."""
    kind = kind or infer_format(path)
    readers = {"json": read_json, "xml": read_xml, "csv": read_csv, "sqlite": read_sqlite, "duckdb": read_duckdb}
    if kind not in readers:
        raise ValueError(f"unknown format: {path}")
    return readers[kind](spark, path)


def write_ocel(log: Ocel, path: str, kind: str | None = None) -> None:
    """Write a log in any supported format."""
    kind = kind or infer_format(path)
    writers = {"json": write_json, "xml": write_xml, "csv": write_csv, "sqlite": write_sqlite, "duckdb": write_duckdb}
    if kind not in writers:
        raise ValueError(f"unknown format: {path}")
    writers[kind](log, path)


# -- in-between form -------------------------------------------------------------------


def from_nested(events: DataFrame, objects: DataFrame, types: DataFrame) -> Ocel:
    """Tables from nested events (pos, id, type, time, attributes, relationships), objects alike, and types."""
    declared = types.filter("attr IS NOT NULL").select("kind", "type", F.col("attr").alias("name"), "attr_type")
    ev = events.select(F.col("id").alias("event_id"), F.col("pos").cast("long").alias("event_idx"), F.col("type").alias("event_type"), timestamps.parse(F.col("time")).alias("ts"), "attributes", "relationships")
    ob = objects.select(F.col("id").alias("object_id"), F.col("pos").cast("long").alias("object_idx"), F.col("type").alias("object_type"), "attributes", "relationships")
    ea = ev.select("event_id", F.col("event_type").alias("type"), F.explode("attributes").alias("a")).select("event_id", "type", "a.name", "a.value")
    oa = ob.select("object_id", F.col("object_type").alias("type"), F.posexplode("attributes").alias("idx", "a")).select("object_id", "type", "a.name", timestamps.parse(F.col("a.time")).alias("ts"), "a.value", F.col("idx").cast("long").alias("idx"))
    typed = lambda rows, kind: rows.join(F.broadcast(declared.filter(F.col("kind") == kind).drop("kind")), ["type", "name"], "left").withColumn("type", F.coalesce("attr_type", values.infer(F.col("value"))))
    e2o = ev.select("event_id", F.explode("relationships").alias("r")).select("event_id", F.col("r.objectId").alias("object_id"), F.coalesce("r.qualifier", F.lit("")).alias("qualifier")).distinct()
    o2o = ob.select(F.col("object_id").alias("source_id"), F.explode("relationships").alias("r")).select("source_id", F.col("r.objectId").alias("target_id"), F.coalesce("r.qualifier", F.lit("")).alias("qualifier")).distinct()
    return Ocel(
        ev.select("event_id", "event_idx", "event_type", "ts"),
        ob.select("object_id", "object_idx", "object_type"),
        e2o,
        o2o,
        typed(ea, "event").select("event_id", "name", "type", "value"),
        typed(oa, "object").select("object_id", "name", "ts", "type", "value", "idx"),
        types,
    )


def nested(log: Ocel) -> tuple[DataFrame, DataFrame]:
    """Events and objects with their attributes and relationships gathered, in input order."""
    attr = F.struct("name", "type", "value")
    ea = log.event_attr_frame().groupBy("event_id").agg(F.array_sort(F.collect_list(attr)).alias("attributes"))
    e2o = log.e2o.groupBy("event_id").agg(F.array_sort(F.collect_set(F.struct("object_id", "qualifier"))).alias("relationships"))
    events = log.events.join(ea, "event_id", "left").join(e2o, "event_id", "left").orderBy("event_idx", "event_id")
    timed = F.struct("ts", "name", "type", "value")
    oa = log.object_attr_frame().groupBy("object_id").agg(F.array_sort(F.collect_list(timed)).alias("attributes"))
    o2o = log.o2o.groupBy(F.col("source_id").alias("object_id")).agg(F.array_sort(F.collect_set(F.struct("target_id", "qualifier"))).alias("relationships"))
    objects = log.objects.join(oa, "object_id", "left").join(o2o, "object_id", "left").orderBy("object_idx", "object_id")
    return events, objects


def declared_types(log: Ocel) -> dict[str, dict[str, list[tuple[str, str]]]]:
    """kind -> type -> [(attribute, type)], declared ones first, then those that only the data has."""
    out: dict[str, dict[str, list[tuple[str, str]]]] = {"event": {}, "object": {}}
    for r in log.type_frame().orderBy("kind", "type", "pos").collect():  # the schema's size
        found = out[r.kind].setdefault(r.type, [])
        if r.attr is not None:
            found.append((r.attr, r.attr_type or "string"))
    for kind, rows in (("event", log.event_attr_frame().join(log.events.select("event_id", "event_type"), "event_id")), ("object", log.object_attr_frame().join(log.objects.select("object_id", "object_type"), "object_id"))):
        seen = rows.groupBy(F.col(f"{kind}_type").alias("k"), "name").agg(values.joined_type(F.collect_set("type")).alias("t")).orderBy("k", "name").collect()
        for r in seen:
            found = out[kind].setdefault(r.k, [])
            if r.name not in {a for a, _ in found}:
                found.append((r.name, r.t or "string"))
    return out


def _type_frame(spark: SparkSession, types: dict[str, dict[str, list[tuple[str, str]]]]) -> DataFrame:
    rows = [(kind, t, i, a, k) for kind, of in types.items() for t, attrs in of.items() for i, (a, k) in enumerate(attrs or [(None, None)])]
    return spark.createDataFrame(rows, model.OCEL_TYPES)


# -- JSON ------------------------------------------------------------------------------


#: Rows that the reader gives out at once.
BATCH_ROWS = 5_000
_KEYS = {"eventTypes": "event-type", "objectTypes": "object-type", "events": "event", "objects": "object"}


def read_json(spark: SparkSession, path: str) -> Ocel:
    """OCEL 2.0 JSON, a file or a folder of documents (gzip if a name ends in ``.gz``), each read as a stream by one task.

    Unknown keys are passed over and keys may come in any order; a task holds
    one event or object and a batch of rows, whatever the size of its file.
    Relationships name objects that may come later or stand in another document:
    they are rows of their own, which operators join.
    """
    # only names: the files' bytes aren't read by Spark
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")

    def parsed(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyarrow import fs

        told = lambda held: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), (pa.string(), pa.string(), pa.int64()))], names=["kind", "body", "pos"])
        for batch in batches:
            for file in batch.column(0).to_pylist():
                system, at = fs.FileSystem.from_uri(file)
                held = []
                with system.open_input_stream(at, compression="detect") as raw, io.TextIOWrapper(raw, "utf-8-sig") as text:
                    for n, (key, x) in enumerate(json_stream.elements(json_stream.Stream(text.read), _KEYS)):
                        held.append((_KEYS[key], _body(key, x), n))
                        if len(held) == BATCH_ROWS:
                            yield told(held)
                            held = []
                if held:
                    yield told(held)

    return _from_rows(files.mapInArrow(parsed, "kind string, body string, pos long"))


def _body(key: str, x: dict) -> str:
    """An element with values as text."""
    for a in x.get("attributes") or () if key in ("events", "objects") else ():
        v = a.get("value")
        a["value"] = v if isinstance(v, str) or v is None else json.dumps(v)
    return json.dumps(x)


def _from_rows(rows: DataFrame) -> Ocel:
    """A log from rows of kind (event-type, object-type, event, object), body (JSON) and pos."""
    body = "id string, type string, time string, attributes array<struct<name:string,time:string,value:string>>, relationships array<struct<objectId:string,qualifier:string>>"
    flat = lambda kind: rows.filter(F.col("kind") == kind).select("pos", F.from_json("body", body).alias("x")).select("pos", "x.*")
    t = rows.filter(F.col("kind").endswith("-type")).select(F.regexp_replace("kind", "-type", "").alias("kind"), F.from_json("body", "name string, attributes array<struct<name:string,type:string>>").alias("t"))
    t = t.select("kind", F.col("t.name").alias("type"), F.posexplode_outer("t.attributes").alias("pos", "a")).select("kind", "type", "pos", F.col("a.name").alias("attr"), F.col("a.type").alias("attr_type")).distinct()
    ob = flat("object")
    ob = ob.withColumn("attributes", F.transform("attributes", lambda a: F.struct(a["name"].alias("name"), F.coalesce(a["time"], F.lit("1970-01-01T00:00:00Z")).alias("time"), a["value"].alias("value"))))
    return from_nested(flat("event"), ob, t)


def _when(ts: datetime | None) -> str:
    return timestamps.iso(ts if ts is not None else timestamps.EPOCH)


def write_json(log: Ocel, path: str) -> None:
    """OCEL 2.0 JSON: one file, or a folder of documents if ``path`` ends in ``/``; executors write events and objects."""
    events, objects = nested(log)
    types = declared_types(log)

    def told(r: dict, kind: str, other: str) -> str:
        timed = (lambda a: {"time": _when(a["ts"])}) if kind == "object" else (lambda a: {})
        attrs = [{"name": a["name"], **timed(a), "value": values.typed(a["value"], a["type"])} for a in r["attributes"] or ()]
        when = {"time": _when(r["ts"])} if kind == "event" else {}
        return json.dumps({"id": r[f"{kind}_id"], "type": r[f"{kind}_type"], **when, "attributes": attrs, "relationships": [{"objectId": x[other], "qualifier": x["qualifier"]} for x in r["relationships"] or ()]})

    listed = lambda kind: json.dumps([{"name": t, "attributes": [{"name": a, "type": k} for a, k in attrs]} for t, attrs in types[kind].items()])
    head = f'{{"eventTypes":{listed("event")},"objectTypes":{listed("object")},'
    ev = sink.texts(events, partial(told, kind="event", other="object_id"), "event_id", "event_type", "ts", "attributes", "relationships")
    ob = sink.texts(objects, partial(told, kind="object", other="target_id"), "object_id", "object_type", "attributes", "relationships")
    if path.endswith("/"):
        sink.write_documents(ev, f"{path}events", head + '"events":[', "]}", ",")
        sink.write_documents(ob, f"{path}objects", head + '"objects":[', "]}", ",")
    else:
        sink.write_file([(head + '"events":[', ev, ","), ('],"objects":[', ob, ",")], path, "]}")


# -- XML -------------------------------------------------------------------------------


def parse_xml(stream) -> Iterator[tuple[str, dict]]:
    """Types, events and objects of an OCEL XML stream as ("event-type" | "object-type" | "event" | "object", dict)."""
    declared = False
    above: list = []
    for what, e in ElementTree.iterparse(stream, ("start", "end")):
        tag = e.tag.rsplit("}", 1)[-1]
        if what == "start":
            above.append(e)
            continue
        above.pop()
        parent = above[-1].tag.rsplit("}", 1)[-1] if above else ""
        if (parent, tag) in (("event-types", "event-type"), ("object-types", "object-type")):
            declared = True
            yield tag, {"name": e.get("name"), "attributes": [{"name": a.get("name"), "type": a.get("type")} for a in e.iter() if a.tag.endswith("attribute")]}
            e.clear()
        elif (parent, tag) in (("events", "event"), ("objects", "object")):
            if not declared:
                raise ValueError("no types are declared")
            links = [{"objectId": x.get("object-id"), "qualifier": x.get("qualifier")} for x in e.iter() if x is not e and x.tag.rsplit("}", 1)[-1] in ("relationship", "relobj", "object") and x.get("object-id")]
            attrs = [{"name": a.get("name"), "time": a.get("time"), "value": a.text or None} for a in e.iter() if a.tag.rsplit("}", 1)[-1] == "attribute"]
            yield tag, {"id": e.get("id"), "type": e.get("type"), "time": e.get("time"), "attributes": attrs, "relationships": links}
            above[-1].clear()  # its elements so far would stay, though empty


def read_xml(spark: SparkSession, path: str) -> Ocel:
    """OCEL 2.0 XML, each file read as a stream by one task that holds an element and a batch of rows; gzip is known by its bytes.

    The folder must be one that pyarrow can open.  Values that their declared type
    doesn't have are null, floats ``null`` NaN.
    """
    # only names: the files' bytes aren't read by Spark
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")

    def parsed(batches: Iterator) -> Iterator:
        import gzip

        import pyarrow as pa
        from pyarrow import fs

        told = lambda held: pa.RecordBatch.from_pydict({"kind": [k for k, _ in held], "body": [b for _, b in held]})
        for batch in batches:
            for file in batch.column(0).to_pylist():
                system, at = fs.FileSystem.from_uri(file)
                with system.open_input_stream(at, compression=None) as first:
                    packed = first.read(2) == b"\x1f\x8b"
                held = []
                with system.open_input_stream(at, compression=None, buffer_size=1 << 20) as raw:
                    for kind, x in parse_xml(gzip.GzipFile(fileobj=raw) if packed else raw):
                        held.append((kind, json.dumps(x)))
                        if len(held) == BATCH_ROWS:
                            yield told(held)
                            held = []
                if held:
                    yield told(held)

    log = _from_rows(files.mapInArrow(parsed, "kind string, body string").withColumn("pos", F.monotonically_increasing_id()))
    strict = lambda rows: rows.withColumn("value", values.strictly(F.col("value"), F.col("type")))
    return replace(log, event_attrs=strict(log.event_attrs), object_attrs=strict(log.object_attrs))


def write_xml(log: Ocel, path: str) -> None:
    """OCEL 2.0 XML: one file, or a folder of documents if ``path`` ends in ``/``; values are text, so empty ones come back as null."""
    events, objects = nested(log)
    types = declared_types(log)
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<log>\n'
    for kind in ("object", "event"):
        head += f"<{kind}-types>"
        for t, attrs in types[kind].items():
            inner = "".join(f"<attribute name={quoteattr(a)} type={quoteattr(k)}/>" for a, k in attrs)
            head += f"<{kind}-type name={quoteattr(t)}><attributes>{inner}</attributes></{kind}-type>"
        head += f"</{kind}-types>\n"

    def told(r: dict, kind: str, other: str) -> str:
        time = f" time={quoteattr(_when(r['ts']))}" if kind == "event" else ""
        at = lambda a: f" time={quoteattr(_when(a['ts']))}" if kind == "object" else ""
        # a line is a row of the parts: line ends inside values are references
        attrs = "".join(f"<attribute name={quoteattr(a['name'])}{at(a)}>{escape(a['value'] or '', _LINE_ENDS)}</attribute>" for a in r["attributes"] or ())
        links = "".join(f"<relationship object-id={quoteattr(x[other])} qualifier={quoteattr(x['qualifier'] or '')}/>" for x in r["relationships"] or ())
        return f"<{kind} id={quoteattr(r[f'{kind}_id'])} type={quoteattr(r[f'{kind}_type'])}{time}><attributes>{attrs}</attributes><objects>{links}</objects></{kind}>"

    ob = sink.texts(objects, partial(told, kind="object", other="target_id"), "object_id", "object_type", "attributes", "relationships")
    ev = sink.texts(events, partial(told, kind="event", other="object_id"), "event_id", "event_type", "ts", "attributes", "relationships")
    if path.endswith("/"):
        sink.write_documents(ob, f"{path}objects", head + "<objects>", "</objects></log>")
        sink.write_documents(ev, f"{path}events", head + "<events>", "</events></log>")
    else:
        sink.write_file([(head + "<objects>\n", ob, ""), ("</objects>\n<events>\n", ev, "")], path, "</events>\n</log>\n")


# -- CSV -------------------------------------------------------------------------------


def parse_cell(cell: str | None) -> list[tuple[str, str, str | None]]:
    """Objects of a CSV cell ``id#qualifier{json}/id...``: (id, qualifier, json)."""
    out, depth, start = [], 0, 0
    cell = cell or ""
    for i, c in enumerate(cell + "/"):
        depth += (c == "{") - (c == "}")
        if c == "/" and depth <= 0:
            part, start = cell[start:i].strip(), i + 1
            if part:
                head, brace, tail = part.partition("{")
                ident, _, qualifier = head.partition("#")
                out.append((ident.strip(), qualifier.strip(), brace + tail if brace else None))
    return out


def read_csv(spark: SparkSession, path: str, strict: bool = False) -> Ocel:
    """OCEL CSV: ``id, activity, timestamp, ot:<type>, ea:<attribute>`` (headers in any case).

    Rows of activity ``o2o`` relate the object named by id to the listed ones; rows
    without id and activity change attributes of their objects (at the epoch
    without a time).  Event rows without a time are left out, or an error if strict.
    """
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    names = {c: c.strip() for c in raw.columns}
    kinds, attrs, fixed = {}, {}, {}
    for c, n in names.items():
        low = n.lower()
        if low in ("id", "activity", "timestamp"):
            fixed[low] = c
        elif low.startswith("ot:"):
            kinds[c] = n[3:]
        else:
            attrs[c] = n[3:] if low.startswith("ea:") else n
    q = lambda c: F.col(f"`{c}`")
    cell = F.udf(parse_cell, "array<struct<id:string,qualifier:string,json:string>>", useArrow=True)
    rows = raw.withColumn("_pos", F.monotonically_increasing_id())
    base = [F.col("_pos"), F.nullif(F.trim(q(fixed["id"])), F.lit("")).alias("id"), F.nullif(F.trim(q(fixed["activity"])), F.lit("")).alias("activity"), q(fixed["timestamp"]).alias("timestamp")]
    refs = rows.select(*base, F.explode(F.array(*[F.struct(F.lit(t).alias("type"), q(c).alias("cell")) for c, t in kinds.items()])).alias("x"))
    refs = refs.filter("x.cell IS NOT NULL").select("_pos", "id", "activity", timestamps.parse(F.col("timestamp")).alias("ts"), F.col("x.type").alias("type"), F.explode(cell("x.cell")).alias("o"))
    is_o2o = F.lower("activity") == "o2o"
    event_rows = rows.select(*base, *[q(c) for c in attrs]).filter(F.col("activity").isNotNull() & ~is_o2o).withColumn("ts", timestamps.parse(F.col("timestamp")))
    if strict and not event_rows.filter("ts IS NULL").isEmpty():
        raise ValueError("an event has no timestamp")
    ok = event_rows.filter("ts IS NOT NULL").withColumn("id", F.coalesce("id", F.concat(F.lit("event-"), F.col("_pos").cast("string"))))
    events = ok.select(F.col("id").alias("event_id"), F.col("_pos").alias("event_idx"), F.col("activity").alias("event_type"), "ts")
    ea = ok.select(F.col("id").alias("event_id"), F.explode(F.array(*[F.struct(F.lit(n).alias("name"), q(c).alias("value")) for c, n in attrs.items()]).cast("array<struct<name:string,value:string>>")).alias("a")) if attrs else None
    event_attrs = ea.filter("a.value IS NOT NULL").select("event_id", "a.name", values.infer(F.col("a.value")).alias("type"), "a.value") if ea is not None else None
    objects = refs.select(F.col("o.id").alias("object_id"), "type", "_pos")
    objects = objects.groupBy("object_id").agg(F.min(F.struct("_pos", "type")).alias("m")).select("object_id", F.col("m._pos").alias("object_idx"), F.col("m.type").alias("object_type"))
    e2o = refs.join(ok.select("_pos", F.col("id").alias("event_id")), "_pos").select("event_id", F.col("o.id").alias("object_id"), F.col("o.qualifier").alias("qualifier")).distinct()
    o2o = refs.filter(is_o2o).select(F.col("id").alias("source_id"), F.col("o.id").alias("target_id"), F.col("o.qualifier").alias("qualifier")).distinct()
    if strict and not o2o.join(objects, F.col("source_id") == F.col("object_id"), "left_anti").isEmpty():
        raise ValueError("an o2o row names an unknown source")
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp")
    oa = refs.filter("o.json IS NOT NULL").select(F.col("o.id").alias("object_id"), F.coalesce("ts", epoch).alias("ts"), F.explode(F.from_json("o.json", "map<string,string>")).alias("name", "value"))
    object_attrs = oa.select("object_id", "name", "ts", values.infer(F.col("value")).alias("type"), "value").distinct()
    return Ocel(events, objects, e2o, o2o, event_attrs, object_attrs)


def write_csv(log: Ocel, path: str) -> None:
    """OCEL CSV: events by time, then O2O rows, then attribute changes that no event of the object covers."""
    types = declared_types(log)
    kinds = sorted(types["object"])
    names = sorted({a for attrs in types["event"].values() for a, _ in attrs})
    oa = log.object_attr_frame()
    linked = log.e2o.join(log.events, "event_id").join(log.objects, "object_id")
    now = linked.select("event_id", "object_id", "ts").distinct().join(oa, ["object_id", "ts"]).groupBy("event_id", "object_id").agg(F.collect_list(F.struct("name", "type", "value")).alias("changes"))
    cells = linked.join(now, ["event_id", "object_id"], "left").groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct("object_type", "object_id", "qualifier", "changes"))).alias("refs"))
    ea = log.event_attr_frame().groupBy("event_id").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("attrs"))
    events = log.events.join(cells, "event_id", "left").join(ea, "event_id", "left").orderBy("ts", "event_idx", "event_id")
    rest = oa.join(log.e2o.join(log.events, "event_id").select("object_id", "ts").distinct(), ["object_id", "ts"], "left_anti").join(log.objects.select("object_id", "object_type"), "object_id")
    rest = rest.groupBy("object_id", "object_type", "ts").agg(F.collect_list(F.struct("name", "type", "value")).alias("changes")).orderBy("ts", "object_id")
    o2o = log.o2o.join(log.objects.select(F.col("object_id").alias("target_id"), "object_type"), "target_id").groupBy("source_id").agg(F.array_sort(F.collect_set(F.struct("object_type", "target_id", "qualifier"))).alias("refs")).orderBy("source_id")

    def text(ident: str, qualifier: str | None, changes=None) -> str:
        out = ident + (f"#{qualifier}" if qualifier else "")
        return out + (json.dumps({c["name"]: values.typed(c["value"], c["type"]) for c in changes}) if changes else "")

    def line(cells: list) -> str:
        out = io.StringIO()
        csv.writer(out, lineterminator="").writerow(cells)
        return out.getvalue()

    def columns(refs) -> list[str]:
        by = defaultdict(list)
        for kind, cell in refs:
            by[kind].append(cell)
        return ["/".join(by[k]) for k in kinds]

    none = [""] * len(names)
    stamp = lambda ts: ts.strftime("%Y-%m-%dT%H:%M:%S.%f+0000") if ts is not None and ts.replace(tzinfo=None) != datetime(1970, 1, 1) else ""
    of_event = lambda r: line([r["event_id"], r["event_type"], stamp(r["ts"]), *columns((x["object_type"], text(x["object_id"], x["qualifier"], x["changes"])) for x in r["refs"] or ()), *(dict(r["attrs"] or ()).get(n, "") for n in names)])
    of_o2o = lambda r: line([r["source_id"], "o2o", "", *columns((x["object_type"], text(x["target_id"], x["qualifier"])) for x in r["refs"]), *none])
    of_change = lambda r: line(["", "", stamp(r["ts"]), *columns([(r["object_type"], text(r["object_id"], None, r["changes"]))]), *none])
    sections = [sink.texts(events, of_event, "event_id", "event_type", "ts", "refs", "attrs"), sink.texts(o2o, of_o2o, "source_id", "refs"), sink.texts(rest, of_change, "object_id", "object_type", "ts", "changes")]
    head = line(["id", "activity", "timestamp", *(f"ot:{k}" for k in kinds), *(f"ea:{n}" for n in names)]) + "\n"
    sink.write_file([(head if not i else "", rows, "") for i, rows in enumerate(sections)], path, "")


# -- SQL databases ---------------------------------------------------------------------


def _fill(run, log: Ocel, quote=lambda n: '"' + n.replace('"', '""') + '"') -> None:
    """Create and fill the standard OCEL tables through ``run(sql, rows=None)``."""
    types = declared_types(log)
    for kind in ("event", "object"):
        run(f'CREATE TABLE "{kind}_map_type" (ocel_type TEXT, ocel_type_map TEXT)')
        run(f'CREATE TABLE "{kind}" (ocel_id TEXT, ocel_type TEXT)')
        run(f'INSERT INTO "{kind}_map_type" VALUES (?, ?)', [(t, values.sql_name(t)) for t in types[kind]])
        for t, attrs in types[kind].items():
            extra = "ocel_changed_field TEXT, " if kind == "object" else ""
            listed = ", ".join(["ocel_id TEXT", "ocel_time TIMESTAMP", *([extra.rstrip(", ")] if extra else []), *(f"{quote(a)} {values.SQL_TYPES.get(k, 'TEXT')}" for a, k in attrs)])
            run(f"CREATE TABLE {quote(f'{kind}_{values.sql_name(t)}')} ({listed})")
    run('CREATE TABLE "event_object" (ocel_event_id TEXT, ocel_object_id TEXT, ocel_qualifier TEXT)')
    run('CREATE TABLE "object_object" (ocel_source_id TEXT, ocel_target_id TEXT, ocel_qualifier TEXT)')
    events, objects = nested(log)

    def batched(sql: str, rows: Iterator[tuple]) -> None:
        held = []
        for r in rows:
            held.append(r)
            if len(held) == 5000:
                run(sql, held)
                held = []
        run(sql, held)

    stamp = lambda ts: (ts or datetime(1970, 1, 1)).strftime("%Y-%m-%d %H:%M:%S.%f")
    by_type: dict[str, list[tuple]] = defaultdict(list)

    def put(kind: str, t: str, row: tuple, flush: bool = False) -> None:
        held = by_type[f"{kind}_{t}"]
        held.append(row)
        if len(held) == 5000:
            pour(kind, t)

    def pour(kind: str, t: str) -> None:
        width = 2 + (kind == "object") + len(types[kind][t])
        run(f"INSERT INTO {quote(f'{kind}_{values.sql_name(t)}')} VALUES ({', '.join('?' * width)})", by_type.pop(f"{kind}_{t}", []))

    for kind, rows in (("event", events), ("object", objects)):
        names = []
        for r in rows.toLocalIterator():
            t, ident = r[f"{kind}_type"], r[f"{kind}_id"]
            names.append((ident, t))
            if len(names) == 5000:
                run(f'INSERT INTO "{kind}" VALUES (?, ?)', names)
                names = []
            attrs = [a for a, _ in types[kind].setdefault(t, [])]
            if kind == "event":
                got = {a.name: values.typed(a.value, a.type) for a in r.attributes or ()}
                put(kind, t, (ident, stamp(r.ts), *(got.get(a) for a in attrs)))
            else:
                first = {a.name: values.typed(a.value, a.type) for a in r.attributes or () if a.ts == datetime(1970, 1, 1)}
                put(kind, t, (ident, stamp(None), None, *(first.get(a) for a in attrs)))
                for c in r.attributes or ():
                    if c.ts != datetime(1970, 1, 1):
                        put(kind, t, (ident, stamp(c.ts), c.name, *(values.typed(c.value, c.type) if a == c.name else None for a in attrs)))
        run(f'INSERT INTO "{kind}" VALUES (?, ?)', names)
        for t in types[kind]:
            pour(kind, t)
    batched('INSERT INTO "event_object" VALUES (?, ?, ?)', ((r.event_id, r.object_id, r.qualifier) for r in log.e2o.toLocalIterator()))
    batched('INSERT INTO "object_object" VALUES (?, ?, ?)', ((r.source_id, r.target_id, r.qualifier) for r in log.o2o.toLocalIterator()))


def write_sqlite(log: Ocel, path: str) -> None:
    """The standard tables in a new SQLite file."""
    if os.path.exists(path):
        os.remove(path)
    with closing(sqlite3.connect(path)) as con:
        _fill(lambda sql, rows=None: con.executemany(sql, rows) if rows is not None else con.execute(sql), log)
        con.commit()


def write_duckdb(log: Ocel, path: str) -> None:
    """The standard tables in a new DuckDB file."""
    import duckdb

    if os.path.exists(path):
        os.remove(path)
    with closing(duckdb.connect(path)) as con:
        _fill(partial(_run_duckdb, con), log)


def _run_duckdb(con, sql: str, rows: list[tuple] | None = None) -> None:
    """Rows go in as one Arrow table: row by row takes a thousand times as long.  Columns of several types keep to the row by row way, which tells the types of values apart."""
    import pyarrow as pa

    if rows is None:
        con.execute(sql)
        return
    if not rows:
        return
    columns = list(zip(*rows))
    if any(len({type(v) for v in c if v is not None}) > 1 for c in columns):
        con.executemany(sql, rows)
        return
    told = pa.table([pa.array(c, None if any(v is not None for v in c) else pa.string()) for c in columns], names=[f"c{i}" for i in range(len(columns))])
    con.register("_rows", told)
    con.execute(f"{sql[: sql.rindex(' VALUES (')]} SELECT * FROM _rows")
    con.unregister("_rows")


class _Poured:
    """Rows that the driver reads one after the other, as a Parquet file in the shared folder: it holds a batch of them at most."""

    def __init__(self, spark: SparkSession, folder: str, name: str, schema: str):
        import pyarrow as pa
        from pyarrow import fs, parquet

        kinds = {"string": pa.string(), "long": pa.int64(), "timestamp": pa.timestamp("us", "UTC")}
        self.spark, self.at, self.schema, self.held = spark, f"{folder}/{name}.parquet", schema, []
        self.told = pa.schema([(c, kinds[k]) for c, k in (x.split() for x in schema.split(", "))])
        system, path = fs.FileSystem.from_uri(self.at)
        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.writer = parquet.ParquetWriter(path, self.told, filesystem=system)

    def add(self, row: tuple) -> None:
        self.held.append(row)
        if len(self.held) == 20_000:
            self._pour()

    def _pour(self) -> None:
        import pyarrow as pa

        if self.held:
            self.writer.write_table(pa.table([pa.array(c, k) for c, k in zip(zip(*self.held), self.told.types)], schema=self.told))
            self.held = []

    def frame(self) -> DataFrame:
        self._pour()
        self.writer.close()
        return self.spark.read.schema(self.schema).parquet(self.at)


def _shared_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share; a temporary one where a local master has none."""
    conf = spark.sparkContext.getConf()
    shared = conf.get("spark.checkpoint.dir", None)
    if shared is None and not conf.get("spark.master", "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = f"{shared.rstrip('/')}/tables-{uuid.uuid4().hex}" if shared else tempfile.mkdtemp(prefix="eventloom-")
    return folder if "://" in folder else f"file://{folder.removeprefix('file:')}"


def _from_sql(spark: SparkSession, ask, columns) -> Ocel:
    """Tables of the standard layout; ``ask(sql)`` gives rows one after the other, ``columns(table)`` (name, sql type) pairs.

    What is read goes to Parquet files, a batch at a time; frames read these.
    """
    quote = lambda n: '"' + n.replace('"', '""') + '"'
    folder = _shared_folder(spark)
    poured = partial(_Poured, spark, folder)
    events, objects = poured("events", model.OCEL_EVENTS), poured("objects", model.OCEL_OBJECTS)
    ea, oa = poured("event_attrs", model.OCEL_EVENT_ATTRS), poured("object_attrs", model.OCEL_OBJECT_ATTRS)
    links = poured("e2o", model.OCEL_E2O), poured("o2o", model.OCEL_O2O)
    types: dict[str, dict[str, list[tuple[str, str]]]] = {"event": {}, "object": {}}
    when = lambda x: x if isinstance(x, datetime) or x is None else timestamps.parse_python(str(x))
    naive = lambda x: x.replace(tzinfo=None) if x is not None and x.tzinfo else x
    text = lambda v: values.text_of(v if not isinstance(v, datetime) else v.isoformat())
    n = 0
    for kind in ("event", "object"):
        for t, mapped in list(ask(f"SELECT ocel_type, ocel_type_map FROM {kind}_map_type")):
            listed = columns(f"{kind}_{mapped}")
            fixed = {"ocel_id", "ocel_time", "ocel_changed_field"}
            attrs = [(c, values.FROM_SQL.get(k.upper(), "string")) for c, k in listed if c not in fixed]
            types[kind][t] = attrs
            changed = "ocel_changed_field" if kind == "object" and any(c == "ocel_changed_field" for c, _ in listed) else "NULL"
            extra = "".join(f", {quote(a)}" for a, _ in attrs)
            for ident, ts, field_, *got in ask(f"SELECT ocel_id, ocel_time, {changed}{extra} FROM {quote(f'{kind}_{mapped}')}"):
                ts, n = naive(when(ts)), n + 1
                if kind == "event":
                    events.add((ident, n, t, ts))
                    for (a, k), v in zip(attrs, got):
                        if v is not None:
                            ea.add((ident, a, k, text(v)))
                else:
                    objects.add((ident, n, t))
                    for (a, k), v in zip(attrs, got):
                        if v is not None and field_ in (None, a):
                            oa.add((ident, a, ts, k, text(v)))
    for table, into in zip(("ocel_event_id, ocel_object_id, ocel_qualifier FROM event_object", "ocel_source_id, ocel_target_id, ocel_qualifier FROM object_object"), links):
        for r in ask(f"SELECT {table}"):
            into.add(tuple(r))
    # an object has a row for each change
    known = objects.frame().groupBy("object_id", "object_type").agg(F.min("object_idx").alias("object_idx")).select("object_id", "object_idx", "object_type")
    return Ocel(events.frame(), known, links[0].frame().distinct(), links[1].frame().distinct(), ea.frame(), oa.frame(), _type_frame(spark, types))


def read_sqlite(spark: SparkSession, path: str) -> Ocel:
    """The standard tables of a SQLite file, which is read on the driver, a row at a time."""
    with closing(sqlite3.connect(f"file:{path}?mode=ro", uri=True)) as con:
        return _from_sql(spark, con.execute, lambda t: [(r[1], r[2]) for r in con.execute(f"PRAGMA table_info({json.dumps(t)})")])


def read_duckdb(spark: SparkSession, path: str) -> Ocel:
    """The standard tables of a DuckDB file, which is read on the driver, a batch at a time."""
    import duckdb

    with closing(duckdb.connect(path, read_only=True)) as con:

        def ask(sql: str) -> Iterator[tuple]:
            asked = con.cursor().execute(sql)
            while rows := asked.fetchmany(20_000):
                yield from rows

        return _from_sql(spark, ask, lambda t: con.execute("SELECT column_name, data_type FROM information_schema.columns WHERE table_name = ? ORDER BY ordinal_position", [t]).fetchall())


# -- frames and graph files ------------------------------------------------------------


def write_frames(log: Ocel, folder: str, columns: dict[str, list[str]] | None = None) -> None:
    """The five interchange frames as CSV folders, with a column subset where given."""
    from eventloom.operators.objectcentric import frames

    for name, frame in frames(log).items():
        chosen = (columns or {}).get(name)
        (frame.select(*[F.col(f"`{c}`") for c in chosen]) if chosen else frame).write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")


def write_graph(log: Ocel, folder: str, typed: bool = False) -> None:
    """Node and edge Parquet folders for graph databases (id, type; src, dst, qualifier), by type if ``typed``."""
    label = F.regexp_replace(F.regexp_replace("type", " ", ""), "[^A-Za-z0-9]", "_")
    nodes = log.events.select(F.col("event_id").alias("id"), F.col("event_type").alias("type"), "ts").withColumn("kind", F.lit("event"))
    nodes = nodes.unionByName(log.objects.select(F.col("object_id").alias("id"), F.col("object_type").alias("type"), F.lit(None).cast("timestamp").alias("ts")).withColumn("kind", F.lit("object"))).withColumn("label", label)
    edges = log.e2o.select(F.col("event_id").alias("src"), F.col("object_id").alias("dst"), "qualifier").withColumn("kind", F.lit("e2o"))
    edges = edges.unionByName(log.o2o.select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"), "qualifier").withColumn("kind", F.lit("o2o")))
    nodes.write.mode("overwrite").partitionBy(*(["kind", "label"] if typed else ["kind"])).parquet(f"{folder}/nodes")
    edges.write.mode("overwrite").partitionBy("kind").parquet(f"{folder}/edges")
