"""Files that are cut by ranges, and files that executors write."""

import gzip

import pytest
from pyspark.sql import functions as F

from eventloom import builders
from eventloom.model import EventLog
from eventloom.operators import casecentric as cc
from eventloom.sources import json_logs, xes


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture
def small_ranges(spark):
    """Ranges of a few hundred bytes, so that they cut everything somewhere."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    spark.conf.set(names[0], "211")
    spark.conf.set(names[1], "1")
    yield
    for n, v in zip(names, before):
        spark.conf.set(n, v)


EVENT = '<event><string key="concept:name" value="{0}"/><int key="n" value="{1}"/><string key="odd" value="a &lt;trace> &#10; é --&gt; >"/></event>'


def text_of(traces: int, extra="", head='<?xml version="1.0" encoding="UTF-8"?>\n<log><string key="name" value="x"/>\n') -> str:
    body = ""
    for t in range(traces):
        body += f'<trace{" " if t % 3 else ""}>\n' + (f'<string key="concept:name" value="c{t % 4}"/>' if t % 5 else "") + "".join(EVENT.format(f"a{i % 3}", i) for i in range(t % 4)) + (extra if t % 6 == 1 else "") + "</trace>\n"
    return head + body + "<trace/><trace /></log>\n"


def parsed(text: str) -> list:
    return list(xes.traces(xes.opened(text.encode())))


@pytest.mark.parametrize(
    "extra",
    ["", "<!-- a comment with <trace> and </trace> in it, which is long enough to be cut by ranges of some hundred bytes, at least in some traces: " + "x" * 200 + " <trace> -->", "<![CDATA[ <trace> " + "y" * 150 + " <trace/> ]]>", "<!-- short <trace> --><?pi <trace?>".replace("<?pi <trace?>", "")],
)
def test_ranges_give_the_rows_of_the_whole_file(spark, small_ranges, tmp_path, extra):
    text = text_of(25, extra)
    (tmp_path / "a.xes").write_text(text)
    log = xes.read_xes(spark, str(tmp_path / "a.xes"))
    want = parsed(text)
    assert len(want) == 27 and spark.read.text(str(tmp_path / "a.xes")).rdd.getNumPartitions() > 10
    cases = log.cases.orderBy("trace_idx").collect()
    assert [c.attrs for c in cases] == [{k: v for k, _, v in own} for own, _ in want]
    assert [c.case_name for c in cases] == [dict((k, v) for k, _, v in own).get("concept:name") for own, _ in want]
    events = log.events.orderBy("trace_idx", "event_idx").collect()
    assert [e.attrs for e in events] == [{k: v for k, _, v in ev} for _, evs in want for ev in evs]
    assert len({c.case_id for c in cases}) == 27 and {e.case_id for e in events} <= {c.case_id for c in cases}
    if not extra:
        assert rows(xes.read_xes(spark, str(tmp_path / "a.xes"), xes.Options(plain=True)).events.select("case_id", "event_idx", "activity")) == rows(log.events.select("case_id", "event_idx", "activity"))


def test_files_that_are_parsed_whole(spark, small_ranges, tmp_path):
    texts = {
        "prefixed": '<x:log xmlns:x="u">' + "".join(f'<x:trace><x:event><x:string key="concept:name" value="{i}"/></x:event></x:trace>' for i in range(9)) + "</x:log>",
        "entity": '<!DOCTYPE log [<!ENTITY me "word">]><log><trace><event><string key="concept:name" value="&me;"/></event></trace></log>',
        "latin": '<?xml version="1.0" encoding="ISO-8859-1"?><log><trace><event><string key="concept:name" value="é"/></event></trace></log>',
        "plain": text_of(9),
    }
    for name, text in texts.items():
        (tmp_path / f"{name}.xes").write_bytes(text.encode("latin-1" if name == "latin" else "utf-8"))
    (tmp_path / "z.xes.gz").write_bytes(gzip.compress(text_of(9).encode()))
    log = xes.read_xes(spark, str(tmp_path))
    found = {f: n for f, n in rows(log.events.groupBy(F.regexp_extract("file", "([a-z]+)[.]xes", 1).alias("f")).agg(F.count("*")))}
    n = sum(len(evs) for _, evs in parsed(text_of(9)))
    assert found == {"prefixed": 9, "entity": 1, "latin": 1, "plain": n, "z": n}
    assert {r.activity for r in log.events.filter("file LIKE '%latin%' OR file LIKE '%entity%'").collect()} == {"é", "word"}


def test_sorting_by_a_global_default(spark, small_ranges, tmp_path):
    head = '<log><global scope="event"><int key="n" value="1"/></global>'
    event = '<event><string key="concept:name" value="{0}"/>{1}</event>'
    body = "<trace>" + event.format("b", '<int key="n" value="2"/>') + event.format("a", "") + event.format("c", '<int key="n" value="3"/>') + "</trace>"
    (tmp_path / "a.xes").write_text(head + body * 6 + "</log>")
    got = rows(cc.variants(xes.read_xes(spark, str(tmp_path / "a.xes"), xes.Options(sort_by="n")), ("event_idx",)))
    assert got == [(["a", "b", "c"], 6)]


def test_traces_of_one_name_stay_apart(spark, tmp_path):
    one = '<log><trace><event><string key="concept:name" value="a"/></event><event><string key="concept:name" value="b"/></event></trace></log>'
    named = one.replace("<trace>", '<trace><string key="concept:name" value="c"/>').replace("</log>", "").replace("<log>", "")
    (tmp_path / "a.xes").write_text(one)
    (tmp_path / "b.xes").write_text(one)
    (tmp_path / "c.xes").write_text(f"<log>{named}{named}</log>")
    log = xes.read_xes(spark, str(tmp_path))
    assert rows(cc.dfg(log, ("event_idx",))) == [("a", "b", 4)] and rows(cc.variants(log, ("event_idx",))) == [(["a", "b"], 4)]
    for path in (f"{tmp_path}/out.json", f"{tmp_path}/docs.json/"):
        json_logs.write_log_json(log, path)
        back = json_logs.read_log_json(spark, path)
        assert rows(cc.dfg(back, ("event_idx",))) == [("a", "b", 4)] and back.cases.count() == 4


def test_exact_values():
    v = xes.value_of
    assert [v("boolean", x) for x in ("true", "1", "TRUE", "false", None)] == ["true", "false", "false", "false", "false"]
    assert [v("int", x) for x in ("12", "-3", "+4", "1_000", " 7 ", "9223372036854775807", "9223372036854775808", "12345678901234567890", "")] == ["12", "-3", "4", "0", "0", "9223372036854775807", "0", "0", "0"]
    assert [v("float", x) for x in ("1.5", "1_0", ".5", "5.", "-2e3", "inf", "NaN", " 1", "x")] == ["1.5", "0.0", "0.5", "5.0", "-2000.0", "inf", "nan", "0.0", "0.0"]
    nil = xes.NIL
    assert [v("id", x) for x in ("urn:uuid:12345678-1234-5678-1234-567812345678", "12345678123456781234567812345678", "1234-5678", "")] == ["12345678-1234-5678-1234-567812345678"] * 2 + [nil] * 2


NESTED = """<log><trace><string key="concept:name" value="t"/><event><string key="concept:name" value="e"/><int key="i" value="3"/><float key="f" value="2.5"/><boolean key="b" value="true"/>
<id key="u" value="12345678-1234-5678-1234-567812345678"/><date key="time:timestamp" value="2020-01-01T00:00:00Z"/><list key="l"><values><int key="x" value="1"/><container key="c"><string key="y" value="z"/></container></values></list></event></trace></log>"""


def test_every_type_survives_files(spark, tmp_path):
    (tmp_path / "a.xes").write_text(NESTED)
    first = xes.read_xes(spark, str(tmp_path / "a.xes"))
    xes.write_xes(first, f"{tmp_path}/b.xes.gz")
    json_logs.write_log_json(first, f"{tmp_path}/b.json")
    second = json_logs.read_log_json(spark, f"{tmp_path}/b.json")
    xes.write_xes(second, f"{tmp_path}/c/")
    json_logs.write_log_json(xes.read_xes(spark, f"{tmp_path}/c/"), f"{tmp_path}/d.json.gz")
    logs = [first, xes.read_xes(spark, f"{tmp_path}/b.xes.gz"), second, xes.read_xes(spark, f"{tmp_path}/c"), json_logs.read_log_json(spark, f"{tmp_path}/d.json.gz")]
    want = {"concept:name": "string", "i": "int", "f": "float", "b": "boolean", "u": "id", "time:timestamp": "date", "l": "list"}

    def flat(text):
        return [(k, t, flat(v) if t in ("list", "container") else v) for k, t, v in xes.inner(text)]

    for log in logs:
        e = log.events.first()
        assert e.attr_types == want and e.case_name == "t"
        assert (e.attrs["i"], e.attrs["f"], e.attrs["b"], e.attrs["u"]) == ("3", "2.5", "true", "12345678-1234-5678-1234-567812345678")
        assert flat(e.attrs["l"]) == [("x", "int", "1"), ("c", "container", [("y", "string", "z")])]


def test_sinks_write_in_order_and_without_rows(spark, tmp_path):
    log = builders.make_log(spark, ["ab"] * 30 + [""])
    log = EventLog(log.events.repartition(7), log.cases.repartition(5))
    for path in ("a.xes", "a.xes.gz", "x/"):
        xes.write_xes(log, f"{tmp_path}/{path}")
        back = xes.read_xes(spark, f"{tmp_path}/{path}")
        assert back.cases.count() == 31 and back.events.count() == 60
        if path != "x/":
            assert [r.case_name for r in back.cases.orderBy("trace_idx").collect()] == [str(i) for i in range(31)]
    xes.write_xes(log.without_cases(), f"{tmp_path}/none.xes")
    json_logs.write_log_json(log.without_cases(), f"{tmp_path}/none.json")
    assert xes.read_xes(spark, f"{tmp_path}/none.xes").cases.count() == 0 and json_logs.read_log_json(spark, f"{tmp_path}/none.json").cases.count() == 0
    assert not [p for p in tmp_path.iterdir() if "parts-" in p.name]


# -- OCEL JSON as a stream, and OCEL sinks ----------------------------------------------


def test_json_stream_of_any_order_and_chunk():
    import io
    import json

    from eventloom.sources.json_stream import Stream, elements

    doc = {"junk": {"events": [1, {"a": "]}\\\""}], "n": -1.5e3}, "objects": [{"id": "o\n", "x": [[]]}], "s": 'a "quoted" \\ {[', "t": True, "none": None, "events": [{"id": f"e{i} é", "v": i} for i in range(50)], "eventTypes": [], "last": 12}
    for text in (json.dumps(doc), json.dumps(doc, indent=3, ensure_ascii=False), json.dumps(dict(reversed(doc.items())))):
        for chunk in (1, 2, 7, 100, 10**6):
            got = list(elements(Stream(io.StringIO(text).read, chunk), ("events", "objects", "eventTypes")))
            assert [x for k, x in got if k == "events"] == doc["events"] and [x for k, x in got if k == "objects"] == doc["objects"]
    assert list(elements(Stream(io.StringIO('{"events": null}').read), ("events",))) == []
    for bad in ("", "[]", '{"events": [1}', '{"events": [1', '{"a": "b', '{"a": [', '{"a" 1}', "{} {}"):
        with pytest.raises(ValueError):
            list(elements(Stream(io.StringIO(bad).read, 3), ("events",)))


def test_json_stream_holds_little():
    from eventloom.sources.json_stream import Stream, elements

    def document():
        yield '{"skipped": [' + '{"a": "b"},' * 10
        for _ in range(2000):
            yield '{"a": "' + "x" * 1000 + '"},'
        yield '1], "events": [{"id": "0"}'
        for i in range(20_000):
            yield f',{{"id": "{i}", "time": "2020-01-01T00:00:00Z", "attributes": []}}'
        yield "]}"

    parts, held = document(), ""

    def read(n):
        nonlocal held
        while len(held) < n and (x := next(parts, "")):
            held += x
        out, held = held[:n], held[n:]
        return out

    stream = Stream(read, 4096)
    assert sum(1 for _ in elements(stream, ("events",))) == 20_001 and stream.most <= 3 * 4096


@pytest.fixture(scope="module")
def trade(spark):
    from dataclasses import replace

    log = builders.make_ocel(spark, [("place", ["c:1", "o:1"]), ("pay", ["o:1", "c:1"]), ("place", ["c:2", "o:2", "o:3"])] * 5, [("c:1", "o:1"), ("c:2", "o:9")])
    attrs = spark.createDataFrame([("ev:0", "note", "string", 'two\nlines "quoted" <&> é'), ("ev:1", "n", "integer", "3")], "event_id string, name string, type string, value string")
    changes = log.events.select(F.lit("o:1").alias("object_id"), F.lit("price").alias("name"), "ts", F.lit("float").alias("type"), F.lit("2.5").alias("value")).limit(1)
    return replace(log, event_attrs=attrs, object_attrs=changes)


def key(log):
    frames = (log.events.select("event_id", "event_type", "ts"), log.objects.select("object_id", "object_type"), log.e2o, log.o2o, log.event_attr_frame().select("event_id", "name", "value"), log.object_attr_frame().select("object_id", "name", "ts", "value"))
    return [rows(f) for f in frames]


@pytest.mark.parametrize("name", ["a.jsonocel", "b.jsonocel.gz", "c.jsonocel/", "d.xmlocel", "e.xmlocel.gz", "f.xmlocel/", "g.ocel.csv"])
def test_ocel_sinks(spark, trade, tmp_path, name):
    from eventloom.sources import ocel

    path = f"{tmp_path}/{name}"
    ocel.write_ocel(trade, path)
    back = ocel.read_ocel(spark, path)
    assert key(back) == key(trade)
    if name.startswith("a"):  # input order is kept
        assert [r.event_id for r in back.events.orderBy("event_idx").collect()] == [f"ev:{i}" for i in range(15)]


def test_ocel_json_of_any_order(spark, tmp_path):
    import json

    from eventloom.sources import ocel

    doc = {"objects": [{"id": "o", "type": "t", "attributes": [{"name": "n", "time": "2020-01-01T00:00:00Z", "value": 7}, {"name": "ok", "time": "2020-01-01T00:00:00Z", "value": True}], "relationships": [{"objectId": "later", "qualifier": "q"}], "unknown": [{}]}], "other": {"events": [{"id": "no"}]},
           "events": [{"relationships": [{"objectId": "o", "qualifier": ""}], "time": "2020-01-02T00:00:00+01:00", "type": "e", "id": "1"}], "objectTypes": [{"name": "t", "attributes": [{"name": "n", "type": "integer"}]}], "eventTypes": [{"name": "e", "attributes": []}]}
    (tmp_path / "a.json").write_text(json.dumps(doc))
    log = ocel.read_ocel(spark, str(tmp_path / "a.json"))
    assert rows(log.object_attrs.select("name", "type", "value")) == [("n", "integer", "7"), ("ok", "boolean", "true")]
    assert rows(log.o2o) == [("o", "later", "q")] and rows(log.e2o) == [("1", "o", "")] and rows(log.events.select("event_id", "event_type")) == [("1", "e")]


def test_ocel_xml_values_of_declared_types(spark, tmp_path):
    from eventloom.sources import ocel

    kinds = {"i": "integer", "f": "float", "b": "boolean", "t": "time", "s": "string"}
    given = {"i": ["12", "1.5", "x", "99999999999999999999"], "f": ["1.5", "null", "x", "7"], "b": ["true", "TRUE", "1", "false"], "t": ["2020-01-01T00:00:00Z", "noon", "null", "2020-01-01"], "s": ["null", "x", "1", "true"]}
    want = {"i": ["12", None, None, None], "f": ["1.5", "NaN", None, "7"], "b": ["true", None, None, "false"], "t": ["2020-01-01T00:00:00Z", None, None, "2020-01-01"], "s": ["null", "x", "1", "true"]}
    types = "".join(f'<attribute name="{k}" type="{t}"/>' for k, t in kinds.items())
    events = "".join(f'<event id="e{n}" type="e" time="2020-01-01T00:00:00Z"><attributes>' + "".join(f'<attribute name="{k}">{v[n]}</attribute>' for k, v in given.items()) + "</attributes></event>" for n in range(4))
    (tmp_path / "a.xml").write_text(f'<log><object-types/><event-types><event-type name="e"><attributes>{types}</attributes></event-type></event-types><objects/><events>{events}</events></log>')
    got = {(r.event_id, r.name): r.value for r in ocel.read_ocel(spark, str(tmp_path / "a.xml")).event_attrs.collect()}
    assert got == {(f"e{n}", k): v[n] for k, v in want.items() for n in range(4)}


def test_gzipped_xes_is_parsed_by_many_tasks(spark, tmp_path):
    """Executors zip a single file's parts, and the one task that reads it parses nothing."""
    rows = spark.range(2_000).select(F.col("id").cast("string").alias("case_id"), F.lit(0).cast("long").alias("event_idx"), F.concat(F.lit("<!-- "), "id").alias("activity"), F.timestamp_seconds("id").alias("ts"))
    path = str(tmp_path / "log.xes.gz")
    xes.write_xes(EventLog(rows.repartition(3)), path)
    data = open(path, "rb").read()
    assert data.count(b"\x1f\x8b\x08") >= 3 and gzip.decompress(data).count(b"<trace>") == 2_000
    log = xes.read_xes(spark, path)
    got = log.events.select("case_name", "activity", "trace_idx").collect()
    assert sorted(int(r.case_name) for r in got) == list(range(2_000)) and all(r.activity == f"<!-- {r.case_name}" for r in got)
    assert sorted(r.trace_idx for r in got) == list(range(2_000))
    assert "repartition" in log.events._jdf.queryExecution().optimizedPlan().toString().lower()
