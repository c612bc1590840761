"""Lookups by name, changed logs, and views for SQL."""

from eventloom import builders, registry


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_lookups_and_changes(spark):
    log = builders.make_ocel(spark, [("place", ["c:1", "o:1"]), ("pay", ["o:1"])], [("c:1", "o:1")])
    reg = registry.Registry(spark)
    reg.add("log", log)
    call = lambda f, **a: rows(reg.call(f, log="log", **a))
    assert call("event_types") == [("pay",), ("place",)] and call("object_types") == [("c",), ("o",)]
    assert call("event_ids_of_type", event_type="pay") == [("ev:1",)] and call("object_ids_of_type", object_type="o") == [("o:1",)]
    assert [r[:2] for r in call("event_of_id", event_id="ev:0")] == [("ev:0", "place")] and call("event_of_id", event_id="no") == []
    assert call("objects_of_event", event_id="ev:0") == [("c:1", "c", "c"), ("o:1", "o", "o")] and [r[0] for r in call("events_of_object", object_id="o:1")] == ["ev:0", "ev:1"]
    assert call("related_from", object_id="c:1") == [("o:1", "o", "o")] and call("related_to", object_id="o:1") == [("c:1", "c", "o")] and call("object_of_id", object_id="o:1") == [("o:1", "o")]
    assert [r[:3] for r in call("object_trace", object_id="o:1")] == [(0, "ev:0", "place"), (1, "ev:1", "pay")]
    assert call("num_events") == [(2,)] and call("num_objects") == [(2,)] and call("full_event", event_id="ev:1")[0][1] == "pay" and call("full_object", object_id="c:1")[0][3][0][0] == "o:1"
    reg.add("more", reg.call("add_e2o", log="log", links='[["ev:1", "c:1", "x"]]'))
    assert rows(reg.call("objects_of_event", log="more", event_id="ev:1")) == [("c:1", "c", "x"), ("o:1", "o", "o")]
    reg.add("less", reg.call("without_e2o", log="more", event_id="ev:1", object_id="o:1"))
    assert rows(reg.call("objects_of_event", log="less", event_id="ev:1")) == [("c:1", "c", "x")]
    assert reg.call("new_ocel").events.count() == 0 and len(registry.list_functions()) >= 79


def test_functions_as_views(spark):
    reg = registry.Registry(spark)
    reg.add("talks", builders.make_log(spark, ["ab", "ab", "b"]))
    reg.add("shop", builders.make_ocel(spark, [("place", ["c:1", "o:1"]), ("pay", ["o:1"])]))
    assert {"talks_dfg", "talks_variants", "talks_events"} <= set(reg.create_views("talks"))
    assert rows(spark.sql("SELECT from_activity, to_activity, cnt FROM talks_dfg")) == [("a", "b", 2)]
    assert rows(spark.sql("SELECT activity, count(*) FROM talks_events GROUP BY activity")) == [("a", 2), ("b", 3)]
    assert "s_flattened_dfg" in reg.create_views("shop", "s")
    assert rows(spark.sql("SELECT object_type, cnt FROM s_flattened_dfg")) == [("o", 1)]
