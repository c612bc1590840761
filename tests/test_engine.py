"""Operators, models and files of the process-mining engine on small logs."""

import gzip
import math
import random

import pytest
from pyspark.sql import functions as F

from eventloom import builders, registry
from eventloom.functions import timestamps, values
from eventloom.models import alpha
from eventloom.models.partial_order import PartialTrace
from eventloom.models.petri import PetriNet
from eventloom.models.trees import OcTree, abstraction_of, fitness_precision, language, leaf, node
from eventloom.operators import casecentric as cc
from eventloom.operators import objectcentric as oc
from eventloom.operators.ocdeclare import Arc, Options, conformance, discover, reduce
from eventloom.operators.replay import token_replay
from eventloom.sources import ocel as ocel_io
from eventloom.sources import pnml, xes

ORDERS = [
    ("place", ["c:1", "o:1", "i:1", "i:2"]), ("pack", ["o:1", "i:1", "e:1"]), ("place", ["c:1", "o:2", "i:3"]), ("pack", ["o:1", "i:2", "e:1"]),
    ("pay", ["o:1", "c:1"]), ("pack", ["o:2", "i:3", "e:2"]), ("pay", ["o:2"]), ("pickup", ["o:1"]),
]


@pytest.fixture(scope="module")
def log(spark):
    return builders.make_ocel(spark, ORDERS, [("c:1", "o:1"), ("c:1", "o:2"), ("o:1", "i:1"), ("o:1", "i:2"), ("o:2", "i:3")])


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def replay_net():
    net = PetriNet()
    for p in ("p1", "p2", "p3"):
        net.add_place(p)
    for t, a, b in (("a", "p1", "p2"), ("b", "p1", "p2"), ("c", "p2", "p3"), ("d", "p2", "p2")):
        net.add_transition(t, t)
        net.add_arc(a, t)
        net.add_arc(t, b)
    net.initial_marking, net.final_markings = {"p1": 1}, [{"p3": 1}]
    return net


def test_replay_counters(spark):
    one = token_replay(cc.variants(builders.make_log(spark, ["abccd"])), replay_net()).first()
    assert one[:4] == (6, 6, 2, 2)
    two = token_replay(cc.variants(builders.make_log(spark, ["abccd", "bbdb"])), replay_net()).first()
    assert two[:4] == (11, 11, 5, 5) and two.fitness == pytest.approx(1 - 5 / 11)
    bad = replay_net()
    bad.final_markings = []
    with pytest.raises(ValueError):
        token_replay(cc.variants(builders.make_log(spark, ["a"])), bad)


def test_case_centric_on_literals(spark):
    log = builders.make_log(spark, ["abc", "abc", "ac", "", "abbc"])
    v = cc.variants(log)
    assert rows(v.select(F.array_join("variant", ""), "freq")) == [("", 1), ("abbc", 1), ("abc", 2), ("ac", 1)]
    assert rows(cc.dfg(log)) == rows(cc.weighted_dfg(v)) == [("a", "b", 3), ("a", "c", 1), ("b", "b", 1), ("b", "c", 3)]
    assert rows(cc.weighted_activity_counts(v)) == rows(cc.activity_counts(log))
    assert [r.freq for r in cc.top_variants(v, 2).collect()] == [2, 1]
    assert sum(r.percentage for r in cc.variant_shares(v).collect()) == pytest.approx(100)
    assert rows(cc.insert_between(v, "a", "b", "t").select(F.array_join("variant", ""), "freq"))[1:3] == [("ac", 1), ("atbbc", 1)]
    parts = cc.split_by_activity(log, [{"a"}, {"b", "c"}])
    assert [p.events.count() for p in parts] == [4, 8] and parts[0].case_frame().count() == 5
    with pytest.raises(ValueError):
        cc.split_by_activity(log, [{"a"}, {"a"}])
    assert sum(p.events.count() for p in cc.split_at_random(log, 3)) == 12
    sets = cc.random_activity_sets("abcdef", 3, 1)
    assert len(sets) == 3 and set().union(*sets) == set("abcdef") and sum(map(len, sets)) == 6
    assert 2 <= len(cc.random_activity_sets_up_to("abcdef", 4, 2)) <= 4
    one = builders.make_log(spark, ["a"])
    assert rows(cc.timestamp_histogram(one)) == [(1577836800000, "a", 1)]
    assert cc.dotted_chart(one).first().x_relative == 0.0
    assert log.without_events().case_frame().count() == 5 and cc.log_statistics(log).first().n_events == 12


def test_missing_activities_and_classifiers(spark):
    log = builders.make_log(spark, ["ab"])
    log = log.with_events(log.events.withColumn("activity", F.when(F.col("activity") == "a", "a")))
    assert rows(cc.dfg(log)) == [("a", "No Activity", 1)]
    got = cc.classify(log.events.withColumn("r", F.lit("x")), ["activity", "r"]).select("activity")
    assert rows(got) == [("+x",), ("a+x",)]


def test_object_centric_on_literals(log):
    assert dict(rows(oc.type_stats(log).filter("kind = 'object'").select("type", "cnt"))) == {"c": 1, "o": 2, "i": 3, "e": 2}
    assert oc.conversion_rate(log, "pay", "c", "o").first().rate == 1.0
    assert oc.conversion_rate(log, "pay", "nothing", "o").first().rate == 0.0
    assert ("o", "place", "pack", 2) in rows(oc.object_dfg(log))
    assert rows(oc.object_dfg(log)) == rows(oc.flattened_dfg(log))
    assert rows(oc.object_variants(log, "o").select(F.array_join("variant", ","), "freq")) == [("place,pack,pack,pay,pickup", 1), ("place,pack,pay", 1)]
    assert rows(oc.related_objects(log, object_type="i").select("object_id", "other_id")) == [("o:1", "i:1"), ("o:1", "i:2"), ("o:2", "i:3")]
    assert rows(oc.sojourn(log).filter("event_id = 'ev:4'").select("sojourn_us")) == [(1_000_000,)]
    sync = oc.synchronisation(log).filter("event_id = 'ev:4'").first()
    assert (sync.sync_us, sync.delaying_object) == (1_000_000, "o:1")
    assert oc.with_init_exit(log).events.count() == 8 + 16
    lonely = builders.add_objects(log, [("x:1", 99, "x")])
    assert oc.without_orphans(lonely).objects.count() == 8 and oc.first_last(lonely).filter("object_id = 'x:1'").first().first_ts.year == 1970
    assert oc.without_dangling(builders.add_events(log, [], [("ev:0", "nobody", "q")])).e2o.count() == log.e2o.count()
    assert builders.without_e2o(log, "ev:0", "c:1").e2o.count() == log.e2o.count() - 1
    assert builders.without_o2o(log, "c:1", "o:1").o2o.count() == 4
    assert oc.event(log, "ev:1").first().relationships[0].object_id == "e:1" and oc.object_(log, "c:1").first().relationships[0].target_id == "o:1"
    typed = builders.declare_types(log, "event", {"refund": [("amount", "float")]})
    assert ("event", "refund", 0) in rows(oc.type_stats(typed))
    with pytest.raises(KeyError):
        oc.attribute_changes(log, "nobody")


def test_abstraction_of_a_log(log):
    got = {tuple(r) for r in oc.abstraction(log).collect()}
    assert ("convergent", "i", "place", None) in got and ("divergent", "e", "pack", None) in got
    assert ("deficient", "c", "pay", None) in got and ("optional", "o", "pickup", None) in got
    assert fitness_precision(got, got) == (1.0, 1.0)
    one = {("related", "o", "a", None), ("related", "o", "b", None), ("df", "o", "a", "b"), ("start", "o", "a", None)}
    two = (one - {("start", "o", "a", None)}) | {("start", "o", "b", None), ("df", "o", "b", "a"), ("optional", "o", "a", None)}
    # fitness: a has start 0 and related 1, b related 1; precision: a has related 1 and optional 0, b start 0 and related 1
    assert fitness_precision(one, two) == ((0.75 + 1) / 2, (0.5 + 0.5) / 2)
    assert fitness_precision(set(), one) == (0.0, 0.0)


def test_declare_conformance(log):
    value = lambda arc: conformance(log, arc).first()
    o = (("o", None),)
    assert value(Arc("place", "pay", "EF", each=o)).conformance == 1.0
    assert value(Arc("place", "pickup", "EF", each=o)).conformance == 0.5
    assert value(Arc("pay", "place", "EP", each=o)).violated == 0
    assert value(Arc("pay", "pack", "DP", each=o)).violated == 0 and value(Arc("place", "pay", "DF", each=o)).violated == 2
    assert value(Arc("place", "pack", "AS", all=(("i", None),))).violated == 1
    assert value(Arc("place", "pack", "AS", any=(("i", None),), most=1)).violated == 1
    assert value(Arc("place", "pack", "EF", each=(("i", "o"),))).violated == 0
    assert value(Arc("<init> o", "place", "EF", each=o)).violated == 0 and value(Arc("place", "<exit> o", "EF", each=o)).violated == 0
    assert math.isnan(value(Arc("nothing", "pay", "EF", each=o)).conformance)


def test_declare_discovery_and_reduction(spark):
    log = builders.make_ocel(spark, [(a, [f"o:{n}"]) for n in range(3) for a in ("a", "b", "c")])
    found = [str(a) for a in discover(log, Options(arrows=("EF",)))]
    assert found == ["EF(Each(o), a, b, 1, inf)", "EF(Each(o), a, c, 1, inf)", "EF(Each(o), b, c, 1, inf)"]
    every = [str(a) for a in discover(log)]
    assert every == [f"DF(Each(o), {x}, {y}, 1, inf)" for x, y in ("ab", "bc")] + [f"DP(Each(o), {x}, {y}, 1, inf)" for x, y in ("ba", "cb")] + ["EF(Each(o), a, c, 1, inf)", "EP(Each(o), c, a, 1, inf)"]
    assert [str(a) for a in discover(log, Options(arrows=("EF",), reduction="Lossless"))] == ["EF(Each(o), a, b, 1, inf)", "EF(Each(o), b, c, 1, inf)"]
    with_init = discover(log, Options(arrows=("DF",), activities=("<init> o", "a")))
    assert [str(a) for a in with_init] == ["DF(Each(o), <init> o, a, 1, inf)"]
    o = (("o", None),)
    arcs = [Arc(x, y, "EF", each=o) for x, y in (("a", "b"), ("b", "c"), ("a", "c"), ("a", "a"))]
    assert {(a.source, a.target) for a in reduce(arcs)} == {("a", "b"), ("b", "c")}
    # stricter arrows on a path count, ANY twice is no lossless path
    mixed = [Arc("a", "c", "AS", each=o), Arc("a", "b", "DF", all=o), Arc("b", "c", "EP", each=o)]
    assert reduce(mixed) == mixed[1:] and reduce([Arc("a", "c", "EF", each=o), *mixed[1:]]) == [mixed[1], Arc("a", "c", "EF", each=o), mixed[2]]
    loose = [Arc(x, y, "EF", any=o) for x, y in (("a", "b"), ("b", "c"), ("a", "c"))]
    assert len(reduce(loose)) == 2 and len(reduce(loose, lossless=True)) == 3


def test_declare_discovery_with_several_objects(spark):
    log = builders.make_ocel(spark, [("place", ["o:1", "i:1", "i:2"]), ("pack", ["o:1", "i:1", "i:2"]), ("place", ["o:2", "i:3", "i:4"]), ("pack", ["o:2", "i:3", "i:4"])])
    found = [str(a) for a in discover(log, Options(arrows=("EF",)))]
    assert found == ["EF(Each(o), All(i), place, pack, 1, inf)"]
    assert [str(a) for a in discover(log, Options(arrows=("EF",), refine=True))] == found


def test_attribute_history(spark, log):
    at = lambda s: __import__("datetime").datetime(2020, 1, 1, 0, 0, s)
    epoch = __import__("datetime").datetime(1970, 1, 1)
    attrs = spark.createDataFrame([("o:1", "price", epoch, "integer", "5"), ("o:1", "state", at(1), "string", "x"), ("o:1", "price", at(2), "integer", "6")], "object_id string, name string, ts timestamp, type string, value string")
    with_attrs = __import__("dataclasses").replace(log, object_attrs=attrs)
    got = oc.attribute_history(with_attrs, "o").orderBy("change_id").collect()
    flat = oc.flatten(with_attrs, "o")
    assert {r.case_id: r.attrs for r in flat.cases.collect()}["o:1"] == {"price": "5", "state": "x"}
    ties = spark.createDataFrame([("o:1", "n", at(1), "integer", "9", 0), ("o:1", "n", at(1), "integer", "10", 1)], "object_id string, name string, ts timestamp, type string, value string, idx long")
    assert [r.attrs for r in oc.attribute_history(__import__("dataclasses").replace(log, object_attrs=ties), "o").orderBy("change_id").collect()] == [{}, {"n": "10"}]
    assert [(r.change_id, r.attrs) for r in got] == [("o:1-attrs-0", {}), ("o:1-attrs-1", {"price": "5"}), ("o:1-attrs-2", {"price": "5", "state": "x"}), ("o:1-attrs-3", {"price": "6", "state": "x"})]


@pytest.mark.parametrize("name", ["log.jsonocel", "log.json.gz", "log.xml", "log.ocel.csv", "log.sqlite", "log.duckdb"])
def test_files_round_trip(spark, log, tmp_path, name):
    from dataclasses import replace
    from datetime import datetime

    attrs = spark.createDataFrame([("o:1", "price", datetime(1970, 1, 1), "integer", "5"), ("o:1", "price", datetime(2020, 1, 1, 0, 0, 30), "integer", "7")], "object_id string, name string, ts timestamp, type string, value string")
    full = replace(log, object_attrs=attrs, event_attrs=spark.createDataFrame([("ev:0", "area", "string", 'a "b", c'), ("ev:1", "sum", "float", "1.5")], "event_id string, name string, type string, value string"))
    path = str(tmp_path / name)
    ocel_io.write_ocel(full, path)
    back = ocel_io.read_ocel(spark, path)
    assert rows(back.events.select("event_id", "event_type", "ts")) == rows(log.events.select("event_id", "event_type", "ts"))
    assert rows(back.objects.select("object_id", "object_type")) == rows(log.objects.select("object_id", "object_type"))
    assert rows(back.e2o) == rows(log.e2o) and rows(back.o2o) == rows(log.o2o)
    assert rows(back.event_attr_frame().select("event_id", "name", "type", "value")) == rows(full.event_attrs)
    assert rows(back.object_attr_frame().select("object_id", "name", "ts", "type", "value")) == rows(attrs)


def test_csv_cells_and_special_rows(spark, tmp_path):
    assert ocel_io.parse_cell('o:1#q{"a/b":1}/o:2') == [("o:1", "q", '{"a/b":1}'), ("o:2", "", None)]
    path = tmp_path / "x.csv"
    path.write_text('ID,Activity,Timestamp,OT:order,ot:item,EA:ok\ne1,place,2024-01-01T00:00:00Z,o1#main,i1/i2,true\n,,,"o1{""price"": 3}",,\no1,o2o,,,i1#has,\ne2,pay,,o1,,false\n')
    log = ocel_io.read_ocel(spark, str(path))
    assert rows(log.events.select("event_id", "event_type")) == [("e1", "place")]
    assert rows(log.o2o) == [("o1", "i1", "has")] and log.objects.count() == 3
    assert rows(log.object_attr_frame().select("object_id", "name", "type", "value")) == [("o1", "price", "integer", "3")]
    assert rows(log.event_attr_frame()) == [("e1", "ok", "boolean", "true")]
    with pytest.raises(ValueError):
        ocel_io.read_csv(spark, str(path), strict=True)


def test_frames_and_graph(spark, log, tmp_path):
    assert set(oc.frames(log)) == {"events", "objects", "e2o", "o2o", "object_changes"}
    ocel_io.write_frames(log, str(tmp_path / "f"), {"o2o": ["ocel:oid", "ocel:oid_2"]})
    assert spark.read.option("header", True).csv(str(tmp_path / "f" / "o2o")).columns == ["ocel:oid", "ocel:oid_2"]
    ocel_io.write_graph(log, str(tmp_path / "g"), typed=True)
    assert spark.read.parquet(str(tmp_path / "g" / "nodes")).count() == 16


XES = """<?xml version="1.0"?><log xmlns="http://www.xes-standard.org/"><extension name="Concept" prefix="concept" uri="u"/>
<global scope="event"><string key="concept:name" value="?"/><string key="a key" value="?"/></global><classifier name="c" keys="concept:name a key"/><string key="name" value="L"/>
<trace><string key="concept:name" value="t1"/><event><string key="concept:name" value="b"/><date key="time:timestamp" value="2020-01-01T00:00:02+01:00"/><int key="n" value="x"/></event>
<event><string key="concept:name" value="a"/><date key="time:timestamp" value="2020-01-01T00:00:01+01:00"/><boolean key="ok" value="true"/><list key="l"><values><int key="i" value="1"/></values></list></event></trace><trace/></log>"""


def test_xes_reading_and_writing(spark, tmp_path):
    (tmp_path / "a.xes").write_text(XES)
    (tmp_path / "b.xes.gz").write_bytes(gzip.compress(XES.encode()))
    log = xes.read_xes(spark, str(tmp_path / "a.xes"))
    assert [(r.activity, r.ts.isoformat()) for r in log.events.orderBy("event_idx").collect()] == [("b", "2019-12-31T23:00:02"), ("a", "2019-12-31T23:00:01")]
    assert log.cases.count() == 2 and log.events.first().attrs["n"] == "0"
    assert [r.activity for r in xes.read_xes(spark, str(tmp_path / "b.xes.gz"), xes.Options(sort_by="time:timestamp")).events.orderBy("event_idx").collect()] == ["a", "b"]
    assert xes.read_xes(spark, str(tmp_path / "*.xes*")).events.count() == 4
    meta = xes.read_meta(XES.encode())
    assert meta.classifiers == [("c", ["concept:name", "a key"])] and meta.attributes == [("name", "string", "L")]
    xes.write_xes(log, str(tmp_path / "c.xes.gz"), meta, {"ok": "boolean", "n": "int", "l": "list"})
    back = xes.read_xes(spark, str(tmp_path / "c.xes.gz"))
    key = lambda l: sorted((r.case_name, r.event_idx, r.activity, r.ts, sorted((k, v) for k, v in r.attrs.items() if k != "time:timestamp")) for r in l.events.collect())  # noqa: E731,E741
    assert key(back) == key(log)
    assert xes.read_meta(gzip.decompress((tmp_path / "c.xes.gz").read_bytes())).classifiers == meta.classifiers
    pruned = xes.read_xes(spark, str(tmp_path / "a.xes"), xes.Options(event_attributes=frozenset(["concept:name"])))
    assert set(pruned.events.first().attrs) == {"concept:name"}
    assert xes.classifier_keys("'a b' c d e", ["c d"]) == ["a b", "c d", "e"]


def test_streaming_counts(spark, tmp_path):
    from eventloom.streaming.dfg import activity_windows

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.xes").write_text(XES)
    stream = activity_windows(xes.stream_xes(spark, str(tmp_path / "in")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("windows").start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.sql("SELECT activity, cnt FROM windows")) == [("a", 1), ("b", 1)]


def test_pnml_and_json_round_trip():
    net = replay_net()
    net.add_transition(None, "tau")
    net.add_arc("p3", "tau")
    back = pnml.read_pnml(pnml.pnml(net).encode())
    assert sorted(t.label or "" for t in back.transitions.values()) == ["", "a", "b", "c", "d"]
    assert len(back.arcs) == len(net.arcs) and list(back.initial_marking.values()) == [1] and [list(m.values()) for m in back.final_markings] == [[1]]
    assert PetriNet.from_json(net.to_json()).signature() == net.signature() and "digraph" in net.to_dot()
    _, _, take, put = net.incidence()
    assert sum(map(sum, take)) == 5 and sum(map(sum, put)) == 4
    net.remove_node("p2")
    assert all("p2" not in a for a in net.arcs)


def test_trees():
    tree = node("sequence", leaf("a"), node("exclusive", leaf("b"), leaf(None)), node("loop", leaf("c"), leaf("d")), node("concurrency", leaf("e"), leaf("f")))
    assert tree.is_valid() and [x.label for x in tree.leaves()] == ["a", "b", None, "c", "d", "e", "f"]
    assert not node("loop", leaf("a")).is_valid() and not node("odd", leaf("a")).is_valid() and not node("sequence").is_valid()
    net = tree.to_petri_net()
    assert sum(t.label is not None for t in net.transitions.values()) == 6 and net.initial_marking == {"start": 1}
    k = frozenset(["o"])
    oct_ = OcTree("sequence", [OcTree(label="a", related=k), OcTree("exclusive", [OcTree(label="b", related=k), OcTree()]), OcTree(label="c", related=k, divergent=k)])
    assert oct_.is_valid()
    got = language(oct_, "o")
    assert got.pairs == {("a", "b"), ("b", "c"), ("a", "c"), ("c", "c")} and got.start == {"a"} and got.end == {"c"} and not got.empty
    assert ("optional", "o", "b", None) in abstraction_of(oct_) and ("df", "o", "a", "b") in abstraction_of(oct_)


def test_partial_orders():
    a = PartialTrace({str(i): {"concept:name": n} for i, n in enumerate("wxyz")}, {("0", "1"), ("0", "2"), ("1", "3"), ("2", "3")})
    assert a.start_events() == {"0"} and a.end_events() == {"3"} and a.ingoing("3") == {"1", "2"} and a.outgoing("0") == {"1", "2"}
    b = PartialTrace({f"e{i}": {"concept:name": n} for i, n in enumerate("zyxw")}, {("e3", "e2"), ("e3", "e1"), ("e2", "e0"), ("e1", "e0")})
    assert a.is_isomorphic(b) and PartialTrace.from_json(a.to_json()).is_isomorphic(a)
    b.remove_relation("e1", "e0")
    b.add_relation("e1", "e2")
    assert not a.is_isomorphic(b)
    a.remove_event("0")
    assert a.start_events() == {"1", "2"}


def test_alpha_discovers_a_simple_net(spark):
    r = random.Random(1)
    log = builders.make_log(spark, ["abd" if r.random() < 0.5 else "acd" for _ in range(60)])
    net = alpha.discover(cc.variants(log))
    places = {(tuple(sorted(net.preset(p))), tuple(sorted(net.postset(p)))) for p in net.places}
    assert places == {((), ("a",)), (("a",), ("b", "c")), (("b", "c"), ("d",)), (("d",), ())}
    assert token_replay(cc.variants(log), net).first().fitness == 1.0
    best, _ = alpha.discover_best(cc.variants(log))
    assert token_replay(cc.variants(log), best).first().fitness > 0.9


def test_alpha_conditions_against_all_pairs_of_sets():
    from itertools import chain, combinations, product

    r = random.Random(4)
    for _ in range(40):
        acts = "abcde"[: r.randint(2, 5)]
        df = {p for p in product(acts, repeat=2) if r.random() < 0.4}
        sets = [frozenset(x) for x in chain.from_iterable(combinations(acts, n) for n in range(1, len(acts) + 1))]
        every = lambda xs, ys: all(p in df for p in product(xs, ys))  # noqa: B023,E731
        none = lambda xs, ys: not any(p in df for p in product(xs, ys))  # noqa: B023,E731
        want = {(a, b) for a in sets for b in sets if every(a, b) and none(a, a - b) and none(b - a, b) and any(p not in df for p in product(b - a, a - b))}
        got = alpha.candidates(df)
        assert got <= want
        # those that pairs of wanted parts or single pairs make up are all found
        assert {c for c in want if not c[0] & c[1]} <= got


def test_alpha_repairs():
    df = alpha.Counter({("S", "a"): 9, ("a", "b"): 20, ("b", "c"): 20, ("c", "a"): 11, ("c", "c"): 9, ("c", "E"): 9})
    df = alpha.Counter({(x.replace("S", alpha.START), y.replace("E", alpha.END)): n for (x, y), n in df.items()})
    assert alpha.loop_pairs(df, 5) == {("c", "a")} and alpha.loop_pairs(df, 12) == set()
    skips = alpha.Counter({(alpha.START, "a"): 10, ("a", "b"): 5, ("a", "c"): 5, ("b", "c"): 5, ("c", alpha.END): 10})
    assert alpha.skip_pairs(skips, 5) == {("a", "c")}


def test_alpha_of_loops_and_skips(spark):
    def places(traces, **config):
        net = alpha.discover(cc.variants(builders.make_log(spark, traces)), alpha.Config(absolute=1, relative=0.0, **config))
        named = lambda x: tuple(sorted(net.transitions[i].label or "tau" for i in x))
        return {(named(net.preset(p)), named(net.postset(p))) for p in net.places}

    assert places(["abc"] * 10 + ["ac"] * 10, skip=0.5) == {((), ("a",)), (("a",), ("b", "tau")), (("b", "tau"), ("c",)), (("c",), ())}
    assert places(["abc"] * 10 + ["ababc"] * 10, loop=0.5, skip=10) == {(("tau",), ("a",)), (("a",), ("b",)), (("b",), ("c", "tau")), (("c",), ())}
    assert places(["abc"] * 10 + ["abbc"] * 2, loop=0.1, skip=10) >= {((), ("a",)), (("c",), ())}  # no silent step between b and itself


def test_appended_logs(spark):
    at = builders.START
    sink = builders.Appender(spark, batch=2)
    sink.declare("event", "pay", [("sum", "float")])
    sink.event("pay", at, "e1", [("sum", "float", "1.5")], [("o1", "of"), ("never", "of")])  # o1 comes later
    made = sink.event("pay", at, objects=[("o1", "of")])
    sink.object("order", "o1", [("state", at, "string", "x")], [("o2", "with")])
    sink.object("order", "o2")
    log = sink.finalize()
    assert rows(log.e2o.select("event_id", "object_id", "qualifier")) == sorted([("e1", "o1", "of"), (made, "o1", "of")])
    assert rows(log.o2o.select("source_id", "target_id", "qualifier")) == [("o1", "o2", "with")]
    assert log.events.count() == 2 and log.event_attrs.count() == 1 and log.types.first().attr == "sum"
    again = builders.Appender(spark)
    again.event("pay", at)
    assert again.event("pay", at, objects=[("o1", "of")]) == made


def test_timestamps(spark):
    texts = ["2020-02-03T04:05:06+01:00", "2020-02-03T03:05:06Z", "2020-02-03 03:05:06", "2020-02-03T03:05:06", "2020-02-03 03:05:06 UTC", "2020/02/03 03:05:06", "Mon, 3 Feb 2020 03:05:06 +0000", "Mon Feb 03 2020 04:05:06 GMT+0100 (CET)", "03-02-2020 03:05:06"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r[0].isoformat() for r in df.select(timestamps.parse(F.col("t"))).collect()} == {"2020-02-03T03:05:06"}
    assert {timestamps.iso(timestamps.parse_python(t)) for t in texts} == {"2020-02-03T03:05:06+00:00"}
    assert timestamps.parse_python("03/02/2020 03:05:06", "%d/%m/%Y %H:%M:%S") and timestamps.parse_python("no") is None
    assert spark.range(1).select(timestamps.parse(F.lit("no")).isNull()).first()[0]


def test_values(spark):
    df = spark.createDataFrame([("true",), ("12",), ("1.5e3",), ("2020-01-01T00:00:00Z",), ("x",)], "v string")
    assert [r[0] for r in df.select(values.infer(F.col("v"))).collect()] == ["boolean", "integer", "float", "time", "string"]
    joined = lambda *t: spark.range(1).select(values.joined_type(F.array(*map(F.lit, t)))).first()[0]
    assert joined("integer", "float") == "float" and joined("integer", "time") == "string" and joined("time", "time") == "time"
    assert spark.range(1).select(values.coerce(F.lit("x"), "integer")).first()[0] is None


def test_registry(spark, log, tmp_path):
    reg = registry.Registry(spark)
    reg.add("log", log)
    assert rows(reg.call("size", log="log")) == [(8, 8)]
    assert reg.call("conversion_rate", log="log", activity="pay", source_type="c", target_type="o").first().rate == 1.0
    path = reg.call("export_ocel", log="log", path=str(tmp_path / "x.json"))
    assert rows(registry.Registry(spark).call("size", log=path)) == [(8, 8)]
    assert '"num_events": 8' in registry.as_json(reg.call("size", log="log"))
    assert {f["name"] for f in registry.list_functions()} >= {"dfg", "synchronisation", "discover"}
    with pytest.raises(KeyError):
        reg.call("nothing")


def test_json_logs_and_frames(spark, tmp_path):
    import json

    from eventloom.sources import json_logs

    log = builders.make_log(spark, ["ab", "", "ba"])
    json_logs.write_log_json(log, str(tmp_path / "l.json"))
    back = json_logs.read_log_json(spark, str(tmp_path / "l.json"))
    cut = lambda l, case="case_id": rows(l.events.select(case, "event_idx", "activity", "ts"))  # noqa: E731,E741
    assert cut(back, "case_name") == cut(log) and back.cases.count() == 3
    assert cut(json_logs.from_frame(json_logs.to_frame(log))) == cut(log)
    v = cc.variants(log)
    assert rows(json_logs.read_projection(spark, json_logs.projection_json(v))) == rows(v)
    graph = json.loads(json_logs.dfg_json(log))
    assert graph["activities"] == {"a": 2, "b": 2} and graph["start_activities"] == ["a", "b"] and "digraph" in json_logs.dfg_dot(json.dumps(graph))
