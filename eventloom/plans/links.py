"""More registered queries: constraints, lookups, frames, attributes and files, each with its SQL."""

from __future__ import annotations

import os
import tempfile
import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.functions import timestamps, values
from eventloom.model import EventLog, Ocel
from eventloom.models.partial_order import partial_variants
from eventloom.operators import casecentric as cc
from eventloom.operators import objectcentric as oc
from eventloom.operators.ocdeclare import Arc, Options, conformance, discover
from eventloom.plans.queries import _OCEL, _SH, _text, query
from eventloom.sources import json_logs, ocel, tables, xes

_US = "epoch_us({0})".format

# -- declarative constraints ------------------------------------------------------------


def _counted(source: str, kind: str, target: str, when: str, through: str | None = None) -> str:
    """SQL for an arc of one association: per source event and object the matching targets."""
    near = f"SELECT s.event_id, s.ts, s.object_id FROM link s WHERE s.event_type = '{source}' AND s.object_type = '{kind}'"
    if through:
        near = f"SELECT DISTINCT s.event_id, s.ts, o2o.target_id AS object_id FROM link s JOIN o2o ON o2o.source_id = s.object_id JOIN ob ON ob.object_id = o2o.target_id AND ob.object_type = '{kind}' WHERE s.event_type = '{source}' AND s.object_type = '{through}'"
    return f"near AS ({near}), c AS (SELECT n.event_id, n.object_id, count(t.event_id) FILTER ({when}) AS n FROM near n LEFT JOIN link t ON t.object_id = n.object_id AND t.event_type = '{target}' GROUP BY ALL)"


def _shares(source: str, bad: str) -> str:
    return f"x AS (SELECT event_id, coalesce(b, false) AS b FROM ev LEFT JOIN (SELECT event_id, bool_or({bad}) AS b FROM c GROUP BY ALL) USING (event_id) WHERE event_type = '{source}') SELECT count(*) AS total, count(*) FILTER (b) AS violated, 1.0::DOUBLE - count(*) FILTER (b)::DOUBLE / count(*) AS conformance FROM x"


def _arc(name: str, arc: Arc, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return conformance(tables.order_ocel(spark, sf_dir), arc)

    run.__doc__ = f"Conformance of the arc {arc}."
    query(f"declare_{name}", sql)(run)


_WITH = f"WITH {_OCEL}, "
_arc("ef_each_supplier", Arc("ship item", "ship item", "EF", each=(("supplier", None),)), _WITH + _counted("ship item", "supplier", "ship item", "t.ts > n.ts") + ", " + _shares("ship item", "n < 1"))
_arc("ep_each_part_max", Arc("ship item", "ship item", "EP", each=(("part", None),), least=0, most=10), _WITH + _counted("ship item", "part", "ship item", "t.ts < n.ts") + ", " + _shares("ship item", "n > 10"))
_arc(
    "ef_any_customer", Arc("place order", "place order", "EF", any=(("customer", None),), least=2),
    _WITH + _counted("place order", "customer", "place order", "t.ts > n.ts").replace(", c AS", ", c0 AS")
    + ", c AS (SELECT ev.event_id, coalesce(sum(c0.n), 0) AS n FROM ev LEFT JOIN c0 USING (event_id) WHERE event_type = 'place order' GROUP BY ALL), " + _shares("place order", "n < 2"),
)
_arc("as_each_o2o", Arc("place order", "ship item", "AS", each=(("part", "order"),), least=2), _WITH + _counted("place order", "part", "ship item", "true", "order") + ", " + _shares("place order", "n < 2"))
_arc("ep_each_order", Arc("ship item", "place order", "EP", each=(("order", None),)), _WITH + _counted("ship item", "order", "place order", "t.ts < n.ts") + ", " + _shares("ship item", "n < 1"))
_NEAREST = """near AS (SELECT event_id, ts, object_id FROM link WHERE event_type = '{source}' AND object_type = '{kind}'),
c AS (SELECT n.event_id, n.object_id, coalesce({pick}(t.event_type, (t.ts, t.event_id)) FILTER (t.ts {op} n.ts) = '{target}', false)::INT AS n FROM near n LEFT JOIN link t USING (object_id) GROUP BY ALL)"""
_arc("df_each_order", Arc("place order", "ship item", "DF", each=(("order", None),)), _WITH + _NEAREST.format(source="place order", kind="order", target="ship item", pick="arg_min", op=">") + ", " + _shares("place order", "n < 1"))
_arc("dp_each_order", Arc("ship item", "ship item", "DP", each=(("order", None),)), _WITH + _NEAREST.format(source="ship item", kind="order", target="ship item", pick="arg_max", op="<") + ", " + _shares("ship item", "n < 1"))
_arc(
    "ef_all_order_any_part", Arc("ship item", "ship item", "EF", all=(("order", None),), any=(("part", None),)),
    _WITH + """c AS (SELECT s.event_id, count(t.event_id) AS n FROM ev s JOIN link so ON so.event_id = s.event_id AND so.object_type = 'order' JOIN link ss ON ss.event_id = s.event_id AND ss.object_type = 'part'
LEFT JOIN (SELECT x.event_id, x.ts, x.object_id AS o, y.object_id AS p FROM link x JOIN link y ON x.event_id = y.event_id AND x.object_type = 'order' AND y.object_type = 'part' AND x.event_type = 'ship item') t ON t.o = so.object_id AND t.p = ss.object_id AND t.ts > s.ts WHERE s.event_type = 'ship item' GROUP BY ALL), """
    + _shares("ship item", "n < 1"),
)

#: SQL for arcs of two objects a source event has: per source event and pair of objects the matching targets.
_TWO = """two AS (SELECT a.event_id, a.event_type, a.ts, a.object_id AS o, b.object_id AS p FROM link a JOIN link b USING (event_id) WHERE a.object_type = 'order' AND b.object_type = '{kind}'),
c AS (SELECT s.event_id, s.o, s.p, {n} AS n FROM two s LEFT JOIN two t ON t.o = s.o AND t.p = s.p AND t.ts {op} s.ts WHERE s.event_type = 'ship item' GROUP BY ALL)"""
_arc("ef_each_order_part", Arc("ship item", "ship item", "EF", each=(("order", None), ("part", None))), _WITH + _TWO.format(kind="part", op=">", n="count(t.event_id)") + ", " + _shares("ship item", "n < 1"))
_arc("dp_each_order_supplier", Arc("ship item", "ship item", "DP", each=(("order", None), ("supplier", None))), _WITH + _TWO.format(kind="supplier", op="<", n="count(t.event_id)") + ", " + _shares("ship item", "n < 1"))
_arc(
    "ef_each_order_part_o2o", Arc("place order", "ship item", "EF", each=(("order", None), ("part", "order"))),
    _WITH + """near AS (SELECT DISTINCT s.event_id, s.ts, s.object_id AS o, o2o.target_id AS p FROM link s JOIN o2o ON o2o.source_id = s.object_id JOIN ob ON ob.object_id = o2o.target_id AND ob.object_type = 'part' WHERE s.event_type = 'place order' AND s.object_type = 'order'),
t AS (SELECT a.event_id, a.ts, a.object_id AS o, b.object_id AS p FROM link a JOIN link b USING (event_id) WHERE a.event_type = 'ship item' AND a.object_type = 'order' AND b.object_type = 'part'),
c AS (SELECT n.event_id, n.o, n.p, count(t.event_id) AS n FROM near n LEFT JOIN t ON t.o = n.o AND t.p = n.p AND t.ts > n.ts GROUP BY ALL), """
    + _shares("place order", "n < 1"),
)
_arc(
    "df_all_customer", Arc("place order", "place order", "DF", all=(("customer", None),)),
    _WITH + _NEAREST.format(source="place order", kind="customer", target="place order", pick="arg_min", op=">") + ", " + _shares("place order", "n < 1"),
)


@query(
    "declare_discover",
    _WITH + """t AS (SELECT object_id, count(*) FILTER (event_type = 'ship item') AS n, count(*) FILTER (event_type = 'place order') AS p FROM link WHERE object_type = 'order' GROUP BY ALL),
f AS (SELECT count(*) FILTER (p > 0 AND n BETWEEN 1 AND 20) AS ok, count(*) FILTER (p > 0) AS every, coalesce(sum(n) FILTER (p > 0), 0) AS back, sum(n) AS ships FROM t)
SELECT 'AS(Each(order), place order, ship item, 1, inf)' AS arc FROM f WHERE ok >= ceil(every * 0.8) UNION ALL SELECT 'AS(Each(order), ship item, place order, 1, inf)' FROM f WHERE back >= ceil(ships * 0.8)""",
)
def declare_discover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Association arcs along orders that most source events satisfy."""
    log = tables.order_ocel(spark, sf_dir)
    found = discover(replace(log, objects=log.objects.filter("object_type = 'order'")), Options(arrows=("AS",)))
    return spark.createDataFrame([(str(a),) for a in found], "arc string")


# -- lookups, repairs, frames -----------------------------------------------------------


@query("ocel_events_of_objects", f"WITH {_OCEL} SELECT object_id, count(DISTINCT event_id) AS cnt FROM link WHERE event_type = 'ship item' GROUP BY ALL")
def ocel_events_of_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shipments of each object."""
    rows = oc.events_of_objects(tables.order_ocel(spark, sf_dir), event_type="ship item")
    return rows.groupBy("object_id").agg(F.countDistinct("event_id").alias("cnt"))


@query("ocel_without_dangling", f"WITH {_OCEL}, k AS (SELECT * FROM ob WHERE object_type != 'supplier') SELECT (SELECT count(*) FROM e2o WHERE object_id IN (SELECT object_id FROM k)) AS e2o, (SELECT count(*) FROM o2o WHERE source_id IN (SELECT object_id FROM k) AND target_id IN (SELECT object_id FROM k)) AS o2o")
def ocel_without_dangling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relationships that are left when suppliers are gone."""
    log = tables.order_ocel(spark, sf_dir)
    clean = oc.without_dangling(replace(log, objects=log.objects.filter("object_type != 'supplier'")))
    return clean.e2o.agg(F.count("*").alias("e2o")).crossJoin(clean.o2o.agg(F.count("*").alias("o2o")))  # one row each


@query("ocel_type_pair_links", f"WITH {_OCEL} SELECT event_id, object_id, qualifier FROM e2o JOIN ob USING (object_id) JOIN ev USING (event_id) WHERE event_type = 'place order' AND object_type = 'customer'")
def ocel_type_pair_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relationships between placed orders and customers."""
    return oc.type_pair_links(tables.order_ocel(spark, sf_dir), "place order", "customer")


@query("ocel_type_pair_objects", f"WITH {_OCEL} SELECT source_id, target_id, qualifier FROM o2o WHERE source_id IN (SELECT object_id FROM ob WHERE object_type = 'part') AND target_id IN (SELECT object_id FROM ob WHERE object_type = 'supplier')")
def ocel_type_pair_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relationships between parts and suppliers."""
    return oc.type_pair_objects(tables.order_ocel(spark, sf_dir), "part", "supplier")


@query("ocel_object_frame", "SELECT 'o-' || o_orderkey AS object_id, o_orderpriority AS priority, o_orderstatus AS status FROM orders")
def ocel_object_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their attributes at the start."""
    rows = oc.frames_of_type(tables.order_ocel(spark, sf_dir), "object", "order")
    return rows.select("object_id", F.col("attr:priority").alias("priority"), F.col("attr:status").alias("status"))


@query("ocel_event_frame", f"SELECT {_SH} AS event_id, epoch_us(l_shipdate) AS ts_us FROM lineitem")
def ocel_event_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shipments as a frame of their own."""
    return oc.frames_of_type(tables.order_ocel(spark, sf_dir), "event", "ship item").select("event_id", F.unix_micros("ts").alias("ts_us"))


@query(
    "ocel_frames_e2o",
    f"WITH {_OCEL} SELECT event_id, event_type, epoch_us(ts) AS ts_us, object_id, object_type, qualifier FROM e2o JOIN ob USING (object_id) JOIN ev USING (event_id)",
)
def ocel_frames_e2o(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The interchange frame of event-to-object relationships."""
    e = oc.frames(tables.order_ocel(spark, sf_dir))["e2o"]
    return e.select(F.col("ocel:eid").alias("event_id"), F.col("ocel:activity").alias("event_type"), F.unix_micros("ocel:timestamp").alias("ts_us"), F.col("ocel:oid").alias("object_id"), F.col("ocel:type").alias("object_type"), F.col("ocel:qualifier").alias("qualifier"))


@query("ocel_frames_objects", "SELECT 'o-' || o_orderkey AS object_id, o_orderstatus AS status FROM orders")
def ocel_frames_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The interchange frame of objects, for orders."""
    o = oc.frames(tables.order_ocel(spark, sf_dir))["objects"].filter(F.col("`ocel:type`") == "order")
    return o.select(F.col("ocel:oid").alias("object_id"), "status")


@query("ocel_frames_changes", "SELECT 'o-' || l_orderkey AS object_id, epoch_us(l_shipdate) AS ts_us, CAST(CAST(sum(l_quantity) AS BIGINT) AS VARCHAR) AS value FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY l_orderkey, l_shipdate")
def ocel_frames_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The interchange frame of object changes."""
    c = oc.frames(tables.order_ocel(spark, sf_dir))["object_changes"].filter(F.col("`ocel:type`") == "order")
    return c.select(F.col("ocel:oid").alias("object_id"), F.unix_micros("ocel:timestamp").alias("ts_us"), "value")


@query(
    "ocel_init_exit_times",
    f"WITH {_OCEL}, s AS (SELECT object_id, object_type, coalesce(min(ts), TIMESTAMP '1970-01-01') AS f, coalesce(max(ts), TIMESTAMP '1970-01-01') AS l FROM ob LEFT JOIN link USING (object_id, object_type) GROUP BY ALL) SELECT '<init> ' || object_id AS event_id, epoch_us(f) AS ts_us FROM s UNION ALL SELECT '<exit> ' || object_id, epoch_us(l) FROM s",
)
def ocel_init_exit_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times of init and exit events."""
    e = oc.with_init_exit(tables.order_ocel(spark, sf_dir)).events.filter("event_type LIKE '<%'")
    return e.select("event_id", F.unix_micros("ts").alias("ts_us"))


@query(
    "ocel_attribute_ties",
    """WITH a AS (SELECT 'o-' || l_orderkey AS object_id, l_shipdate AS ts, arg_max(CAST(CAST(l_quantity AS BIGINT) AS VARCHAR), (l_linenumber, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR))) AS v FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY ALL)
SELECT object_id || '-attrs-' || row_number() OVER (PARTITION BY object_id ORDER BY ts) AS change_id, epoch_us(ts) AS from_us, v AS qty FROM a""",
)
def ocel_attribute_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attribute history in which the last of several changes of one time counts."""
    li = tables.table(spark, sf_dir, "lineitem")
    changes = li.select(F.concat(F.lit("o-"), "l_orderkey").alias("object_id"), F.lit("qty").alias("name"), F.col("l_shipdate").cast("timestamp").alias("ts"), F.lit("integer").alias("type"), F.col("l_quantity").cast("long").cast("string").alias("value"), F.col("l_linenumber").cast("long").alias("idx"))
    h = oc.attribute_history(replace(tables.order_ocel(spark, sf_dir), object_attrs=changes), "order")
    return h.filter("from_ts IS NOT NULL").select("change_id", F.unix_micros("from_ts").alias("from_us"), F.try_element_at("attrs", F.lit("qty")).alias("qty"))


@query(
    "ocel_flatten_attributes",
    """WITH q AS (SELECT 'o-' || l_orderkey AS case_id, arg_min(v, l_shipdate) AS qty FROM (SELECT l_orderkey, l_shipdate, CAST(CAST(sum(l_quantity) AS BIGINT) AS VARCHAR) AS v FROM lineitem GROUP BY ALL) GROUP BY ALL)
SELECT 'o-' || o_orderkey AS case_id, o_orderstatus AS status, o_orderpriority AS priority, qty FROM orders LEFT JOIN q ON q.case_id = 'o-' || o_orderkey""",
)
def ocel_flatten_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Case attributes of a flattened log."""
    cases = oc.flatten(tables.order_ocel(spark, sf_dir), "order").cases
    a = lambda k, name: F.try_element_at("attrs", F.lit(k)).alias(name)
    return cases.select("case_id", a("status", "status"), a("priority", "priority"), a("last_shipped_qty", "qty"))


@query("ocel_first_event", f"WITH {_OCEL} SELECT event_id, event_type, epoch_us(ts) AS ts_us FROM ev WHERE event_type = 'place order'")
def ocel_events_of_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of one type."""
    return oc.events_of_type(tables.order_ocel(spark, sf_dir), "place order").select("event_id", "event_type", F.unix_micros("ts").alias("ts_us"))


@query("ocel_objects_of_type", "SELECT 'p-' || p_partkey AS object_id FROM part")
def ocel_objects_of_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects of one type."""
    return oc.objects_of_type(tables.order_ocel(spark, sf_dir), "part").select("object_id")


# -- attributes, classes, graphs --------------------------------------------------------


def _attributed(spark: SparkSession, sf_dir: str) -> EventLog:
    """Orders as one-event cases with typed attributes."""
    o = tables.table(spark, sf_dir, "orders")
    day = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ssXXX")
    attrs = F.create_map(F.lit("total"), F.col("o_totalprice").cast("string"), F.lit("status"), F.col("o_orderstatus"), F.lit("day"), day, F.lit("key"), F.col("o_orderkey").cast("string"))
    kinds = F.create_map(*[F.lit(x) for x in ("total", "float", "status", "string", "day", "date", "key", "int")])
    events = o.select(F.col("o_orderkey").cast("string").alias("case_id"), F.lit(0).cast("long").alias("event_idx"), F.lit("place order").alias("activity"), F.col("o_orderdate").cast("timestamp").alias("ts"), attrs.alias("attrs"), kinds.alias("attr_types"))
    return EventLog(events)


@query("typed_attributes", "SELECT CAST(o_orderkey AS VARCHAR) AS case_id, o_totalprice AS total, epoch_us(o_orderdate::DATE::TIMESTAMP) AS day_us, o_orderkey::BIGINT AS key, CAST(NULL AS VARCHAR) AS missing FROM orders")
def typed_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes as values of their types."""
    e = _attributed(spark, sf_dir).events
    get = lambda k, t: cc.typed_attribute(e, k, t)
    return e.select("case_id", get("total", "float").alias("total"), F.unix_micros(get("day", "date")).alias("day_us"), get("key", "int").alias("key"), get("nothing", "string").alias("missing"))


@query("changed_attributes", "SELECT CAST(o_orderkey AS VARCHAR) AS case_id, k AS key, CASE k WHEN 'status' THEN 'was ' || o_orderstatus ELSE CAST(o_orderkey AS VARCHAR) END AS value, CASE k WHEN 'status' THEN 'string' ELSE 'int' END AS type FROM orders, (VALUES ('status'), ('key')) v(k)")
def changed_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes after one is set and two are removed, as rows and back."""
    e = _attributed(spark, sf_dir).events
    e = cc.without_attribute(cc.without_attribute(e, "total"), "day")
    e = cc.with_attribute(e, "status", F.concat(F.lit("was "), F.try_element_at("attrs", F.lit("status"))))
    return cc.attribute_rows(cc.attribute_maps(cc.attribute_rows(e))).select("case_id", "key", "value", "type")


@query("event_hashes", "SELECT count(*) AS events, count(DISTINCT user_id || '|' || event_type || '|' || epoch_us(ts)) AS hashes FROM events")
def event_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct hashes of events whose user is an attribute."""
    e = tables.user_log(spark, sf_dir).events.select("activity", "ts", F.create_map(F.lit("user"), F.col("case_id")).alias("attrs"))
    return e.agg(F.count("*").alias("events"), F.countDistinct(cc.event_hash(e)).alias("hashes"))


@query(
    "dfg_membership",
    "WITH q AS (SELECT role AS a, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations) SELECT bool_or(a = 'user' AND b = 'assistant') AS edge, bool_or(coalesce(a = 'nobody', false)) AS missing FROM q",
)
def dfg_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a graph has an edge and an activity."""
    log = tables.conversation_log(spark, sf_dir)
    edge = cc.has_relation(cc.dfg(log, ("event_idx",)), "user", "assistant").withColumnRenamed("found", "edge")
    return edge.crossJoin(cc.has_activity(cc.activity_counts(log), "nobody").withColumnRenamed("found", "missing"))  # one row each


@query("timestamp_formats", "SELECT f AS format, date_trunc('month', o_orderdate)::DATE AS month, count(*) AS cnt, CAST(sum(epoch_us(o_orderdate::DATE::TIMESTAMP)) AS VARCHAR) AS us FROM orders, range(5) r(f) GROUP BY ALL")
def timestamp_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order days written in five ways and parsed again."""
    o = tables.table(spark, sf_dir, "orders")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    ways = F.array(F.concat(day, F.lit("T00:00:00Z")), F.concat(day, F.lit("T01:00:00+01:00")), F.concat(day, F.lit(" 00:00:00")), F.concat(day, F.lit(" 00:00:00 UTC")), F.concat(day, F.lit("T00:00:00.000")))
    rows = o.select("o_orderdate", F.posexplode(ways).alias("format", "text"))
    rows = rows.select(F.col("format").cast("long").alias("format"), F.trunc("o_orderdate", "month").alias("month"), F.unix_micros(timestamps.parse(F.col("text"))).cast("decimal(20,0)").alias("us"))
    return rows.groupBy("format", "month").agg(F.count("us").alias("cnt"), F.sum("us").cast("string").alias("us"))  # sums of all times pass a long


@query("inferred_types", "SELECT 'integer' AS kind, count(*) AS cnt FROM orders UNION ALL SELECT 'string', count(*) FROM orders UNION ALL SELECT 'boolean', count(*) FROM orders")
def inferred_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of values written as text."""
    o = tables.table(spark, sf_dir, "orders")
    rows = o.select(F.explode(F.array(F.col("o_orderkey").cast("string"), F.concat(F.lit("x"), "o_orderstatus"), F.lit("true"))).alias("v"))
    return rows.groupBy(values.infer(F.col("v")).alias("kind")).agg(F.count("*").alias("cnt"))


@query(
    "partial_variants_conversations",
    "WITH c AS (SELECT conv_id, string_agg(role, ',' ORDER BY role) AS roles, count(*) AS n FROM conversations GROUP BY ALL) SELECT roles, n AS n_events, count(*) AS freq FROM c GROUP BY ALL",
)
def partial_variants_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants of conversations in which only the turns of one role are ordered: two are alike if they have as many turns of each role."""
    c = tables.table(spark, sf_dir, "conversations")
    events = c.select("conv_id", F.col("turn").alias("event_id"), F.col("role").alias("activity")).withColumnRenamed("conv_id", "case_id")
    after = F.lead("event_id").over(cc.W.partitionBy("case_id", "activity").orderBy("event_id"))
    relations = events.select("case_id", F.col("event_id").alias("before"), after.alias("after")).filter("after IS NOT NULL")
    found = partial_variants(events, relations)
    roles = F.array_join(F.array_sort(F.from_json(F.get_json_object("variant", "$[0]"), "array<string>")), ",")
    return found.select(roles.alias("roles"), "n_events", "freq")  # no two forms with the same roles


# -- files ------------------------------------------------------------------------------

_TRADE = """tev AS (SELECT 'open-c-' || c_custkey AS event_id, 'open account' AS event_type, TIMESTAMP '2020-01-01' + to_seconds(c_custkey) AS ts FROM customer
  UNION ALL SELECT 'open-s-' || s_suppkey, 'sign contract', TIMESTAMP '2020-01-01' + to_seconds(s_suppkey) FROM supplier),
te2o AS (SELECT 'open-c-' || c_custkey AS event_id, 'c-' || c_custkey AS object_id, 'who' AS qualifier FROM customer UNION ALL SELECT 'open-c-' || c_custkey, 'n-' || c_nationkey, 'where' FROM customer
  UNION ALL SELECT 'open-s-' || s_suppkey, 's-' || s_suppkey, 'who' FROM supplier)"""


def trade_ocel(spark: SparkSession, sf_dir: str) -> Ocel:
    """Customers, suppliers and nations with the events ``open account`` and ``sign contract``, and all kinds of attributes."""
    c, s, n = (tables.table(spark, sf_dir, x) for x in ("customer", "supplier", "nation"))
    at = lambda k: (F.lit("2020-01-01 00:00:00").cast("timestamp") + F.make_interval(secs=F.col(k)))
    events = c.select(F.concat(F.lit("open-c-"), "c_custkey").alias("event_id"), F.col("c_custkey").cast("long").alias("event_idx"), F.lit("open account").alias("event_type"), at("c_custkey").alias("ts"))
    events = events.unionByName(s.select(F.concat(F.lit("open-s-"), "s_suppkey").alias("event_id"), F.col("s_suppkey").cast("long").alias("event_idx"), F.lit("sign contract").alias("event_type"), at("s_suppkey").alias("ts")))
    one = lambda t, prefix, key, kind: t.select(F.concat(F.lit(prefix), key).alias("object_id"), F.col(key).cast("long").alias("object_idx"), F.lit(kind).alias("object_type"))
    objects = one(c, "c-", "c_custkey", "customer").unionByName(one(s, "s-", "s_suppkey", "supplier")).unionByName(one(n, "n-", "n_nationkey", "nation"))
    link = lambda t, ev, key, ob, to, q: t.select(F.concat(F.lit(ev), key).alias("event_id"), F.concat(F.lit(ob), to).alias("object_id"), F.lit(q).alias("qualifier"))
    e2o = link(c, "open-c-", "c_custkey", "c-", "c_custkey", "who").unionByName(link(c, "open-c-", "c_custkey", "n-", "c_nationkey", "where")).unionByName(link(s, "open-s-", "s_suppkey", "s-", "s_suppkey", "who"))
    o2o = s.select(F.concat(F.lit("s-"), "s_suppkey").alias("source_id"), F.concat(F.lit("n-"), "s_nationkey").alias("target_id"), F.lit("in").alias("qualifier"))
    own = c.select(F.concat(F.lit("open-c-"), "c_custkey").alias("event_id"), F.lit("segment").alias("name"), F.lit("string").alias("type"), F.col("c_mktsegment").alias("value"))
    epoch = F.lit(oc.EPOCH).cast("timestamp")
    attr = lambda t, key, name, kind, value, ts=epoch: t.select(F.concat(F.lit(key[0]), F.lit("-"), key[1]).alias("object_id"), F.lit(name).alias("name"), ts.alias("ts"), F.lit(kind).alias("type"), value.cast("string").alias("value"))
    attrs = attr(c, ("c", "c_custkey"), "nation", "integer", F.col("c_nationkey")).unionByName(attr(c, ("c", "c_custkey"), "name", "string", F.col("c_name"), at("c_custkey"))).unionByName(attr(n, ("n", "n_nationkey"), "name", "string", F.col("n_name")))
    return Ocel(events, objects, e2o, o2o, event_attrs=own, object_attrs=attrs)


def _new_file(spark: SparkSession, name: str, local: bool = False) -> str:
    """An unused path in the folder that driver and executors share; in a temporary one where a local master has none.

    ``local``: a path that Python's own file functions open, for databases.
    """
    conf = spark.sparkContext.getConf()
    shared = conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not conf.get("spark.master", "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        return f"{tempfile.mkdtemp(prefix='eventloom-')}/{name}"
    folder = f"{shared.rstrip('/')}/files-{uuid.uuid4().hex}"
    if local:
        if "://" in (folder := folder.removeprefix("file://")):
            raise RuntimeError("databases need a shared folder that is mounted")
        os.makedirs(folder)
    return f"{folder}/{name}"


def _written(spark: SparkSession, sf_dir: str, kind: str) -> Ocel:
    """The trade log written to a file of a kind and read back."""
    path = _new_file(spark, f"log.{kind}", kind in ("sqlite", "duckdb"))
    ocel.write_ocel(trade_ocel(spark, sf_dir), path)
    return ocel.read_ocel(spark, path)


def _file_queries(kind: str, ending: str) -> None:
    def links(spark: SparkSession, sf_dir: str) -> DataFrame:
        log = _written(spark, sf_dir, ending)
        return log.e2o.join(log.events, "event_id").select("event_id", "event_type", F.unix_micros("ts").alias("ts_us"), "object_id", "qualifier")

    def attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
        log = _written(spark, sf_dir, ending)
        rows = log.object_attrs.select("object_id", "name", F.unix_micros("ts").alias("ts_us"), "value")
        return rows.unionByName(log.event_attrs.select(F.col("event_id").alias("object_id"), "name", F.lit(None).cast("long").alias("ts_us"), "value"))

    links.__doc__ = f"Relationships of a log written as {kind} and read back."
    attributes.__doc__ = f"Attributes of a log written as {kind} and read back."
    query(f"file_{kind}_links", f"WITH {_TRADE} SELECT event_id, event_type, epoch_us(ts) AS ts_us, object_id, qualifier FROM te2o JOIN tev USING (event_id)")(links)
    query(
        f"file_{kind}_attributes",
        """SELECT 'c-' || c_custkey AS object_id, 'nation' AS name, 0::BIGINT AS ts_us, CAST(c_nationkey AS VARCHAR) AS value FROM customer
UNION ALL SELECT 'c-' || c_custkey, 'name', epoch_us(TIMESTAMP '2020-01-01' + to_seconds(c_custkey)), c_name FROM customer UNION ALL SELECT 'n-' || n_nationkey, 'name', 0, n_name FROM nation
UNION ALL SELECT 'open-c-' || c_custkey, 'segment', NULL, c_mktsegment FROM customer""",
    )(attributes)


for _kind, _ending in (("json", "jsonocel"), ("xml", "xml"), ("csv", "ocel.csv"), ("sqlite", "sqlite"), ("duckdb", "duckdb")):
    _file_queries(_kind, _ending)


@query("file_ocel_o2o", "SELECT 's-' || s_suppkey AS source_id, 'n-' || s_nationkey AS target_id, 'in' AS qualifier FROM supplier")
def file_ocel_o2o(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relationships between objects of a log written as JSON and read back."""
    return _written(spark, sf_dir, "jsonocel").o2o.select("source_id", "target_id", "qualifier")


def _talks(spark: SparkSession, sf_dir: str) -> EventLog:
    return tables.conversation_log(spark, sf_dir)


def _numbered(log: EventLog) -> DataFrame:
    return log.events.select(F.col("case_name").alias("case_id"), (F.row_number().over(cc.W.partitionBy("case_id").orderBy("event_idx")) - 1).cast("long").alias("n"), "activity")


_TALK_ROWS = "SELECT CAST(conv_id AS VARCHAR) AS case_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n, role AS activity FROM conversations"


@query("file_xes_events", _TALK_ROWS)
def file_xes_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a log written as XES and read back."""
    path = _new_file(spark, "log.xes")
    xes.write_xes(_talks(spark, sf_dir), path)
    return _numbered(xes.read_xes(spark, path))


@query("file_xes_gz_attributes", "SELECT CAST(o_orderkey AS VARCHAR) AS case_id, k AS key, CASE k WHEN 'status' THEN o_orderstatus ELSE CAST(o_orderkey AS VARCHAR) END AS value, CASE k WHEN 'status' THEN 'string' ELSE 'int' END AS type FROM orders, (VALUES ('status'), ('key')) v(k)")
def file_xes_gz_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed attributes of a log written as gzipped XES and read back."""
    path = _new_file(spark, "log.xes.gz")
    xes.write_xes(_attributed(spark, sf_dir), path)
    rows = cc.attribute_rows(xes.read_xes(spark, path).events, ("case_name", "event_idx"))
    return rows.filter("key IN ('status', 'key')").select(F.col("case_name").alias("case_id"), "key", "value", "type")


def _named_alike(spark: SparkSession, sf_dir: str) -> EventLog:
    """Conversations of which many have one name, and every fifth none."""
    talks = _talks(spark, sf_dir)
    n = F.col("case_id").cast("long")
    name = F.when(n % 5 != 0, F.concat(F.lit("talk "), (n % 7).cast("string")))
    cases = talks.events.select("case_id").distinct().select("case_id", n.alias("trace_idx"), F.when(name.isNotNull(), F.create_map(F.lit("concept:name"), name)).otherwise(F.create_map().cast("map<string,string>")).alias("attrs"))
    return EventLog(talks.events, cases)


_ALIKE = "WITH n AS (SELECT conv_id, CASE WHEN conv_id % 5 != 0 THEN 'talk ' || conv_id % 7 END AS name, role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations) SELECT name, role AS from_activity, nxt AS to_activity, count(*) AS cnt FROM n WHERE nxt IS NOT NULL GROUP BY ALL"


def _graph_by_name(log: EventLog) -> DataFrame:
    names = log.case_frame().select("case_id", F.col("case_name").alias("name"))
    pairs = cc.sequenced(log, ("event_idx",)).filter("next IS NOT NULL").join(names, "case_id")
    return pairs.groupBy("name", F.col("activity").alias("from_activity"), F.col("next").alias("to_activity")).agg(F.count("*").alias("cnt"))


@query("file_xes_same_names", _ALIKE)
def file_xes_same_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graphs by case name of a log whose traces share names or have none, written as one XES file and read back."""
    path = _new_file(spark, "log.xes")
    xes.write_xes(_named_alike(spark, sf_dir), path)
    return _graph_by_name(xes.read_xes(spark, path))


@query("file_xes_folder", _ALIKE)
def file_xes_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a folder of XES files that executors wrote."""
    path = _new_file(spark, "log.xes/")
    xes.write_xes(_named_alike(spark, sf_dir), path)
    return _graph_by_name(xes.read_xes(spark, path))


@query("file_log_json_events", _TALK_ROWS)
def file_log_json_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a log written as JSON and read back."""
    path = _new_file(spark, "log.json")
    json_logs.write_log_json(_talks(spark, sf_dir), path)
    return _numbered(json_logs.read_log_json(spark, path))


@query(
    "file_json_types",
    "SELECT CAST(o_orderkey AS VARCHAR) AS case_id, o_orderkey::BIGINT AS key, o_totalprice AS total, epoch_us(o_orderdate::DATE::TIMESTAMP) AS day_us, o_orderstatus AS status, 'int float date string' AS kinds FROM orders",
)
def file_json_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types and typed values of attributes of a log written as JSON documents and read back."""
    path = _new_file(spark, "log.json/")
    json_logs.write_log_json(_attributed(spark, sf_dir), path)
    e = json_logs.read_log_json(spark, path).events
    get = lambda k, t: cc.typed_attribute(e, k, t)
    kinds = F.concat_ws(" ", *[F.try_element_at("attr_types", F.lit(k)) for k in ("key", "total", "day", "status")])
    return e.select(F.col("case_name").alias("case_id"), get("key", "int").alias("key"), get("total", "float").alias("total"), F.unix_micros(get("day", "date")).alias("day_us"), get("status", "string").alias("status"), kinds.alias("kinds"))


@query("frame_of_log", "SELECT CAST(o_orderkey AS VARCHAR) AS case_id, o_orderstatus AS status FROM orders")
def frame_of_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log as a wide frame and back."""
    back = json_logs.from_frame(json_logs.to_frame(_attributed(spark, sf_dir)))
    return back.events.select("case_id", F.try_element_at("attrs", F.lit("status")).alias("status"))


@query("projection_round_trip", "SELECT variant, count(*) AS freq FROM (SELECT conv_id, string_agg(role, '->' ORDER BY turn) AS variant FROM conversations GROUP BY ALL) GROUP BY ALL")
def projection_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants of a projection written as JSON and read back."""
    found = cc.variants(_talks(spark, sf_dir), ("event_idx",))
    return _text(json_logs.read_projection(spark, json_logs.projection_json(found)))
