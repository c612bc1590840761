"""XES logs: files read by ranges of bytes, parsed in executors; writers of files and folders.

Spark's text reader cuts files of any size at ``<trace``, wherever a range begins.
A trace is known by its file and place; its name is an attribute like others.
"""

from __future__ import annotations

import gzip
import io
import json
import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import islice
from xml.etree import ElementTree
from xml.sax.saxutils import quoteattr

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.functions import timestamps
from eventloom.model import EventLog
from eventloom.sources import sink

# fixed values of the XES standard
CASE, ACTIVITY, TIME = "concept:name", "concept:name", "time:timestamp"
TAGS = ("string", "date", "int", "float", "boolean", "id", "list", "container")
NIL = "00000000-0000-0000-0000-000000000000"
ATTRIBUTE = "struct<key:string,type:string,value:string>"
ROW = f"file string, trace_idx long, case_name string, event_idx long, case_attrs array<{ATTRIBUTE}>, attrs array<{ATTRIBUTE}>"
CUT = "<trace"


@dataclass(frozen=True)
class Options:
    """Reader options: attributes to keep (None: all), a date format, a key to sort events by.

    ``plain`` promises that no comment, CDATA section, entity or prefix stands in
    the way of cutting files at ``<trace``, which saves a look at all bytes.
    """

    event_attributes: frozenset[str] | None = None
    case_attributes: frozenset[str] | None = None
    log_attributes: frozenset[str] | None = None
    date_format: str | None = None
    sort_by: str | None = None
    plain: bool = False


@dataclass
class Meta:
    """What a log says of itself."""

    attributes: list[tuple[str, str, str | None]] = field(default_factory=list)
    extensions: list[tuple[str, str, str]] = field(default_factory=list)
    classifiers: list[tuple[str, list[str]]] = field(default_factory=list)
    global_trace: list[tuple[str, str, str | None]] = field(default_factory=list)
    global_event: list[tuple[str, str, str | None]] = field(default_factory=list)


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


_INT, _FLOAT = re.compile(r"[+-]?[0-9]+"), re.compile(r"(?i)[+-]?(inf|infinity|nan|([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?)")
_ID = re.compile(r"(?i)(urn:uuid:)?[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}|[0-9a-f]{32}|\{[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}\}")


def value_of(tag: str, text: str | None, date_format: str | None = None) -> str | None:
    """Stored text of a value: numbers, booleans and ids that can't be read become 0, false and nil, dates null.

    Integers are those of 64 bits; ``true`` alone is true.
    """
    text = text or ""
    if tag == "int":
        return str(int(text)) if _INT.fullmatch(text) and -(1 << 63) <= int(text) < 1 << 63 else "0"
    if tag == "float":
        return repr(float(text)) if _FLOAT.fullmatch(text) else "0.0"
    if tag == "id":
        return str(uuid.UUID(text)) if _ID.fullmatch(text) else NIL
    if tag == "boolean":
        return "true" if text == "true" else "false"
    if tag == "date":
        found = timestamps.parse_python(text, date_format)
        return timestamps.iso(found) if found else None
    return text


def _attribute(e, options: Options) -> tuple[str, str, str | None]:
    tag = _local(e.tag)
    if tag in ("list", "container"):
        listed = [c for c in e if _local(c.tag) == "values"]
        return e.get("key", ""), tag, json.dumps([_attribute(c, options) for c in (listed[0] if listed else e) if _local(c.tag) in TAGS])
    return e.get("key", ""), tag, value_of(tag, e.get("value"), options.date_format)


def _attributes(e, keep: frozenset[str] | None, options: Options) -> list[tuple[str, str, str | None]]:
    return [_attribute(c, options) for c in e if _local(c.tag) in TAGS and (keep is None or c.get("key") in keep)]


def classifier_keys(text: str, known: Iterable[str] = ()) -> list[str]:
    """Keys of a classifier: quoted ones, and unquoted ones cut at blanks unless a longer known key fits."""
    out, rest, known = [], text.strip(), sorted(known, key=len, reverse=True)
    while rest:
        if rest[0] in "'\"" and (end := rest.find(rest[0], 1)) > 0:
            out.append(rest[1:end])
            rest = rest[end + 1 :].lstrip()
            continue
        key = next((k for k in known if rest == k or rest.startswith(k + " ")), rest.split(None, 1)[0])
        out.append(key)
        rest = rest[len(key) :].lstrip()
    return out


def trace_of(e, options: Options, default: str | None = None) -> tuple[list, list[list]]:
    """A trace element: (case attributes, [event attributes]); events are sorted if ``sort_by`` says so, missing values are ``default``."""
    events = [_attributes(x, options.event_attributes, options) for x in e if _local(x.tag) == "event"]
    if options.sort_by:
        at = lambda ev: next((v for k, _, v in ev if k == options.sort_by), default)
        events.sort(key=lambda ev: (at(ev) is not None, at(ev) or ""))
    return _attributes(e, options.case_attributes, options), events


def traces(stream, options: Options = Options(), meta: Meta | None = None) -> Iterator[tuple[list, list[list]]]:
    """Traces of a stream, one at a time: (case attributes, [event attributes]); fills ``meta`` on the way."""
    meta = meta if meta is not None else Meta()
    depth, raw_classifiers = 0, []
    for what, e in ElementTree.iterparse(stream, ("start", "end")):
        tag = _local(e.tag)
        if what == "start":
            depth += 1
            continue
        depth -= 1
        if tag == "trace":
            yield trace_of(e, options, next((v for k, _, v in meta.global_event if k == options.sort_by), None))
            e.clear()
        elif depth == 1:
            if tag == "extension":
                meta.extensions.append((e.get("name", ""), e.get("prefix", ""), e.get("uri", "")))
            elif tag == "global":
                (meta.global_trace if e.get("scope") == "trace" else meta.global_event).extend(_attributes(e, None, options))
            elif tag == "classifier":
                raw_classifiers.append((e.get("name", ""), e.get("keys", "")))
                known = [k for k, _, _ in meta.global_event]
                meta.classifiers[:] = [(n, classifier_keys(k, known)) for n, k in raw_classifiers]
            elif tag in TAGS and (options.log_attributes is None or e.get("key") in options.log_attributes):
                meta.attributes.append(_attribute(e, options))
            e.clear()


def opened(data: bytes):
    """A stream of a file's bytes, unzipped if they are gzip."""
    return gzip.GzipFile(fileobj=io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)


class _Told:
    """Rows of traces, given out as Arrow batches."""

    names = ["file", "trace_idx", "case_name", "event_idx", "case_attrs", "attrs"]

    def __init__(self) -> None:
        self.rows: list = []

    def add(self, file: str, n: int, own: list, events: list[list]) -> bool:
        """Take a trace in; whether it is time to give rows out."""
        told = lambda attrs: [dict(zip(("key", "type", "value"), a)) for a in attrs]
        name = next((v for k, _, v in own if k == CASE), None)
        self.rows.append((file, n, name, None, told(own), None))
        self.rows += [(file, n, name, i, None, told(ev)) for i, ev in enumerate(events)]
        return len(self.rows) > 20_000

    def batch(self):
        import pyarrow as pa

        attribute = pa.list_(pa.struct([("key", pa.string()), ("type", pa.string()), ("value", pa.string())]))
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), attribute, attribute]
        columns = list(zip(*self.rows)) if self.rows else [()] * 6
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=self.names)


def _rows(files: DataFrame, options: Options) -> DataFrame:
    """Rows of whole files (path, content)."""

    def parsed(batches: Iterator) -> Iterator:
        told = _Told()
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for n, (own, events) in enumerate(traces(opened(content), options)):
                    if told.add(path, n, own, events):
                        yield told.batch()
        yield told.batch()

    return files.select("path", "content").mapInArrow(parsed, ROW)


def left_open(text: str, state: str = "") -> str:
    """The end of the comment or CDATA section in which a text ends that begins in ``state``, "" if in none."""
    at = 0
    while True:
        if state:
            end = text.find(state, at)
            if end < 0:
                return state
            at, state = end + len(state), ""
        starts = [(i, end) for mark, end in (("<!--", "-->"), ("<![CDATA[", "]]>")) if (i := text.find(mark, at)) >= 0]
        if not starts:
            return ""
        at, state = min(starts)


_PREFIXED, _ENCODED = re.compile(r"<[\w.-]+:trace[\s/>]"), re.compile(r"<\?xml[^>]*\sencoding=[\"'](?!utf-?8|us-ascii|ascii)", re.I)


def _whole_files(chunks: DataFrame) -> list[str]:
    """Files that can't be cut at ``<trace``: comments or sections that go on in another range, entities, prefixes, other encodings.

    All bytes are looked at by the JVM; rows with marks alone reach Python, and
    only names of such files the driver.
    """

    def odd(batches: Iterator) -> Iterator:
        import pyarrow as pa

        found, place, state = set(), None, ""
        for batch in batches:
            for text, file, block in zip(*(c.to_pylist() for c in batch.columns)):
                if place != (file, block):
                    if state:
                        found.add(place[0])
                    place, state = (file, block), ""
                state = left_open(text, state)
                if "<!ENTITY" in text or _PREFIXED.search(text) or _ENCODED.search(text):
                    found.add(file)
        if state:
            found.add(place[0])
        yield pa.RecordBatch.from_pydict({"file": pa.array(sorted(found), pa.string())})

    value = F.col("value")
    marks = ("<!", "-->", "]]>", ":trace", "encoding=")
    some = chunks.filter(reduce(lambda a, b: a | b, (value.contains(m) for m in marks)))
    return [r.file for r in some.mapInArrow(odd, "file string").distinct().collect()]


def _cut_traces(texts: Iterable[tuple]) -> Iterator[tuple[str, int, str, str | None]]:
    """Whole traces of rows (value, file, block, default) in order: file, number, text, default."""
    place, n, held = None, 0, []
    for text, file, block, default in texts:
        if place != (file, block):
            place, n, held = (file, block), -(block == 0), []
        if n < 0:  # what stands before the first trace of a file
            n, held = 0, [text] if left_open(text) else []
            continue
        if held and not held[0].startswith(CUT):  # the head goes on in a comment
            held.append(text)
            if not left_open(CUT.join(held)):
                held = []
            continue
        held.append(CUT + text)
        if left_open("".join(held)):
            continue
        yield file, block + n, "".join(held), default
        held = []
        n += 1


def _trace_rows(cut: Iterable[tuple[str, int, str, str | None]], options: Options) -> Iterator:
    """Rows of traces (file, number, text, default), as Arrow batches."""
    told = _Told()
    for file, n, text, default in cut:
        parser = ElementTree.XMLPullParser(("start", "end"))
        parser.feed(text)
        depth = 0
        for what, e in parser.read_events():  # what follows the trace is never read
            depth += 1 if what == "start" else -1
            if depth == 0:
                if told.add(file, n, *trace_of(e, options, default)):
                    yield told.batch()
                break
        else:
            raise ValueError(f"a trace of {file} has no end")
    yield told.batch()


def _split_rows(chunks: DataFrame, options: Options) -> DataFrame:
    """Rows of files cut at ``<trace`` (value, file, block and default, in order): a trace's number is the place of its range and the trace's place there.

    Numbers rise along a file, by one inside a range.  A gzip file is one range, read by
    one task: that task only cuts it, and others parse its traces.
    """
    listed = lambda batches: (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))

    def parsed(batches: Iterator) -> Iterator:
        return _trace_rows(_cut_traces(listed(batches)), options)

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        told = lambda held: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), (pa.string(), pa.int64(), pa.string(), pa.string()))], names=["file", "n", "text", "default"])
        traces = _cut_traces(listed(batches))
        while held := list(islice(traces, 2_000)):
            yield told(held)

    def of_cut(batches: Iterator) -> Iterator:
        return _trace_rows(listed(batches), options)

    chunks, packed = chunks.select("value", "file", "block", "default"), F.col("file").endswith(".gz")
    rows = chunks.filter(~packed).mapInArrow(parsed, ROW)
    if not any(x.endswith(".gz") for x in chunks.inputFiles()):
        return rows
    spread = chunks.filter(packed).mapInArrow(cut, "file string, n long, text string, default string").repartition("file", F.floor(F.col("n") / 256))
    return rows.unionByName(spread.mapInArrow(of_cut, ROW))


def _defaults(chunks: DataFrame, key: str) -> DataFrame:
    """The global event attribute ``key`` of every file: file, default."""

    def told(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            out = []
            for text in batch.column(0).to_pylist():
                parser = ElementTree.XMLPullParser(("end",))
                parser.feed(text)
                found = [a for _, e in parser.read_events() if _local(e.tag) == "global" and e.get("scope") != "trace" for a in _attributes(e, None, Options())]
                out.append(next((v for k, _, v in found if k == key), None))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(out, pa.string())], names=["file", "default"])

    first = chunks.filter((F.col("block") == 0) & F.col("value").contains("<log")).select("value", "file")
    return first.mapInArrow(told, "file string, default string").dropDuplicates(["file"])


def _log(rows: DataFrame, meta: Meta | None = None) -> EventLog:
    def as_map(c: str, part: str = "value"):  # the first attribute of a key counts
        return F.map_from_entries(F.transform(F.array_distinct(F.transform(c, lambda a: a["key"])), lambda k: F.struct(k.alias("key"), F.filter(c, lambda a: a["key"] == k)[0][part].alias("value"))))

    case = F.concat_ws("#", "file", F.col("trace_idx").cast("string")).alias("case_id")
    events = rows.filter("event_idx IS NOT NULL").withColumnRenamed("attrs", "listed")
    events = events.select("file", case, "case_name", "trace_idx", "event_idx", as_map("listed").alias("attrs"), as_map("listed", "type").alias("attr_types"))
    activity, ts = F.try_element_at("attrs", F.lit(ACTIVITY)).alias("activity"), timestamps.parse(F.try_element_at("attrs", F.lit(TIME))).alias("ts")
    events = events.select("file", "case_id", "case_name", "trace_idx", "event_idx", activity, ts, "attrs", "attr_types")
    cases = rows.filter("event_idx IS NULL").select("file", case, "case_name", "trace_idx", as_map("case_attrs").alias("attrs"), as_map("case_attrs", "type").alias("attr_types"))
    return EventLog(events, cases, {"xes": meta} if meta else None)


def read_xes(spark: SparkSession, path: str, options: Options = Options()) -> EventLog:
    """A log from a file, a folder or a glob of ``.xes`` and ``.xes.gz`` files in UTF-8, ranges of which are parsed in parallel.

    A case is a trace: ``case_id`` is its file and number there, ``case_name`` its
    ``concept:name`` (null without), so traces of one name stay apart.  Gzip files are
    cut as a stream, one task each, and parsed by all.  Files that can't be cut at ``<trace`` (a comment
    or CDATA section that holds it across ranges, entities, prefixed tags, other
    encodings) are found by a first look and parsed whole, 2 GB at most.
    """
    chunks = spark.read.option("lineSep", CUT).text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    whole = [] if options.plain else _whole_files(chunks)
    if whole:
        chunks = chunks.filter(~F.col("file").isin(whole))
    if options.sort_by:  # a broadcast join keeps the order of rows; the driver has listed the files anyway
        chunks = chunks.join(F.broadcast(_defaults(chunks, options.sort_by)), "file", "left")
    else:
        chunks = chunks.withColumn("default", F.lit(None).cast("string"))
    rows = _split_rows(chunks, options)
    if whole:
        rows = rows.unionByName(_rows(spark.read.format("binaryFile").load(whole), options))
    return _log(rows)


def stream_xes(spark: SparkSession, folder: str, options: Options = Options()) -> EventLog:
    """A streaming log of the files that arrive in a folder."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return _log(_rows(spark.readStream.format("binaryFile").schema(schema).load(folder), options))


def read_meta(data: bytes, options: Options = Options()) -> Meta:
    """Metadata of a log's bytes."""
    meta = Meta()
    for _ in traces(opened(data), options, meta):
        pass
    return meta


#: Names of the types in JSON logs (fixed values), by tag.
JSON_TYPES = {"string": "String", "date": "Date", "int": "Int", "float": "Float", "boolean": "Boolean", "id": "ID", "list": "List", "container": "Container"}
TAG_OF = {v: k for k, v in JSON_TYPES.items()}


def inner(value: str | None) -> list[tuple[str, str, str | None]]:
    """The attributes in a list or container: (key, tag, text); its text is JSON, of rows or as in JSON logs."""
    out = []
    for x in json.loads(value or "[]"):
        if isinstance(x, dict):
            content = x["value"].get("content")
            text = content if isinstance(content, str) or content is None else json.dumps(content)
            x = (x["key"], TAG_OF.get(x["value"]["type"], "string"), text)
        out.append(tuple(x))
    return out


def _xml(key: str, kind: str, value: str | None) -> str:
    if kind in ("list", "container"):
        inner_xml = "".join(_xml(*a) for a in inner(value))
        return f"<{kind} key={quoteattr(key)}>{'<values>' + inner_xml + '</values>' if kind == 'list' else inner_xml}</{kind}>"
    return f"<{kind} key={quoteattr(key)}" + (f" value={quoteattr(value)}" if value is not None else "") + "/>"


def _head(meta: Meta) -> str:
    blank = any(re.search(r"\s", k) for _, ks in meta.classifiers for k in ks)
    out = ['<?xml version="1.0" encoding="UTF-8"?>\n<log xes.version="2.0" xmlns="http://www.xes-standard.org/">']
    out += [f"<extension name={quoteattr(n)} prefix={quoteattr(p)} uri={quoteattr(u)}/>" for n, p, u in meta.extensions]
    out += [f'<global scope="{scope}">{"".join(_xml(*a) for a in listed)}</global>' for scope, listed in (("trace", meta.global_trace), ("event", meta.global_event)) if listed]
    out += [f"<classifier name={quoteattr(n)} keys={quoteattr(' '.join(repr(k) if blank else k for k in ks))}/>" for n, ks in meta.classifiers]
    return "\n".join([*out, *(_xml(*a) for a in meta.attributes)])


def case_rows(log: EventLog) -> DataFrame:
    """Every case with its attributes and events, in order: own, own_types and events (attrs, types), each as entries."""
    none = F.create_map().cast("map<string,string>")
    kept = lambda frame: F.map_entries("attr_types") if "attr_types" in frame.columns else F.map_entries(none)
    e = log.events
    attrs = F.coalesce("attrs", none) if "attrs" in e.columns else none
    given = F.map_filter(F.map_from_arrays(F.array(F.lit(ACTIVITY), F.lit(TIME)), F.array("activity", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"))), lambda _, v: v.isNotNull())
    every = F.map_concat(F.map_filter(attrs, lambda k, _: ~k.isin(ACTIVITY, TIME)), given)
    listed = F.struct("event_idx", F.map_entries(every).alias("attrs"), kept(e).alias("types"))
    grouped = e.select("case_id", listed.alias("x")).groupBy("case_id").agg(F.array_sort(F.collect_list("x")).alias("events"))
    cases = log.case_frame()
    own = F.map_entries(F.coalesce("attrs", none)) if "attrs" in cases.columns else F.map_entries(F.create_map(F.lit(CASE), F.col("case_id")))
    order = [c for c in ("file", "trace_idx") if c in cases.columns] + ["case_id"]
    cases = cases.select(*order, own.alias("own"), kept(cases).alias("own_types"))
    return cases.join(grouped, "case_id", "left").orderBy(*order).select("own", "own_types", "events")


def write_xes(log: EventLog, path: str, meta: Meta | None = None, types: dict[str, str] | None = None) -> None:
    """Write a log to one file (gzip if it ends in ``.gz``), or, if ``path`` ends in ``/``, to a folder of XES files that executors write; cases in their order.

    ``types`` gives the XES tag of attributes; else it is the one that was read
    (``attr_types``); others are strings, the timestamp a date.
    """
    types = {TIME: "date"} | (types or {})

    def told(r: dict) -> str:
        tag = lambda k, own: types.get(k) or own.get(k) or "string"
        listed = lambda attrs, kinds: "".join(_xml(a["key"], tag(a["key"], {t["key"]: t["value"] for t in kinds}), a["value"]) for a in attrs)
        return "<trace>" + listed(r["own"], r["own_types"]) + "".join(f"<event>{listed(x['attrs'], x['types'])}</event>" for x in r["events"] or ()) + "</trace>"

    rows = sink.texts(case_rows(log), told)
    if path.endswith("/"):
        sink.write_documents(rows, path, _head(meta or Meta()), "</log>")
    else:
        sink.write_file([(_head(meta or Meta()) + "\n", rows, "")], path, "</log>\n")
