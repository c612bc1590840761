"""The engine's queries over the test tables and the DuckDB SQL with the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.models.petri import PetriNet
from eventloom.operators import casecentric as cc
from eventloom.operators import objectcentric as oc
from eventloom.operators.ocdeclare import Arc, conformance
from eventloom.operators.replay import token_replay
from eventloom.sources import tables

QUERIES: dict = {}
SQL: dict[str, str] = {}

# -- SQL building blocks: the logs as common table expressions --------------------------

_USERS = "log AS (SELECT CAST(user_id AS VARCHAR) AS case_id, event_id AS idx, event_type AS activity, ts FROM events)"
_TALKS = "log AS (SELECT CAST(conv_id AS VARCHAR) AS case_id, turn AS idx, role AS activity FROM conversations)"
_ORDERS = """log AS (SELECT CAST(o_orderkey AS VARCHAR) AS case_id, 'place order' AS activity, o_orderdate AS ts, epoch_us(o_orderdate) AS idx FROM orders
  UNION ALL SELECT CAST(l_orderkey AS VARCHAR), 'ship ' || l_returnflag, l_shipdate, epoch_us(l_shipdate) FROM lineitem)"""
_SH = "concat_ws('-', 'sh', l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y%m%d'))"
_OCEL = f"""ev AS (SELECT 'po-' || o_orderkey AS event_id, 'place order' AS event_type, o_orderdate AS ts FROM orders
  UNION ALL SELECT {_SH}, 'ship item', l_shipdate FROM lineitem),
ob AS (SELECT 'c-' || c_custkey AS object_id, 'customer' AS object_type FROM customer UNION ALL SELECT 'o-' || o_orderkey, 'order' FROM orders
  UNION ALL SELECT 'p-' || p_partkey, 'part' FROM part UNION ALL SELECT 's-' || s_suppkey, 'supplier' FROM supplier),
e2o AS (SELECT 'po-' || o_orderkey AS event_id, 'o-' || o_orderkey AS object_id, 'order' AS qualifier FROM orders
  UNION ALL SELECT 'po-' || o_orderkey, 'c-' || o_custkey, 'buyer' FROM orders
  UNION ALL SELECT {_SH}, 'o-' || l_orderkey, 'order' FROM lineitem
  UNION ALL SELECT {_SH}, 'p-' || l_partkey, 'item' FROM lineitem
  UNION ALL SELECT {_SH}, 's-' || l_suppkey, 'seller' FROM lineitem),
o2o AS (SELECT DISTINCT * FROM (SELECT 'c-' || o_custkey AS source_id, 'o-' || o_orderkey AS target_id, 'places' AS qualifier FROM orders
  UNION ALL SELECT 'o-' || l_orderkey, 'p-' || l_partkey, 'contains' FROM lineitem UNION ALL SELECT 'p-' || l_partkey, 's-' || l_suppkey, 'from' FROM lineitem)),
link AS (SELECT * FROM (SELECT DISTINCT event_id, object_id FROM e2o) JOIN ob USING (object_id) JOIN ev USING (event_id))"""
_SEQ = "seq AS (SELECT case_id, activity, lead(activity) OVER w AS nxt, row_number() OVER w AS n FROM log WINDOW w AS (PARTITION BY case_id ORDER BY {order}))"
_VARIANTS = "v AS (SELECT variant, count(*) AS freq FROM (SELECT case_id, string_agg(activity, '->' ORDER BY {order}) AS variant FROM log GROUP BY case_id) GROUP BY variant)"
_TALK_ORDER = ("event_idx",)


def query(name: str, sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame and the SQL that checks it."""

    def put(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return put


def _text(rows: DataFrame) -> DataFrame:
    """Variants as text, which two engines compare alike."""
    return rows.withColumn("variant", F.array_join("variant", "->"))


def _talk_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cc.variants(tables.conversation_log(spark, sf_dir), _TALK_ORDER)


# -- case-centric ----------------------------------------------------------------------


@query("dfg_users", f"WITH {_USERS}, {_SEQ.format(order='ts, idx')} SELECT activity AS from_activity, nxt AS to_activity, count(*) AS cnt FROM seq WHERE nxt IS NOT NULL GROUP BY ALL")
def dfg_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directly-follows graph of the user log."""
    return cc.dfg(tables.user_log(spark, sf_dir))


@query("dfg_conversations", f"WITH {_TALKS}, {_SEQ.format(order='idx')} SELECT activity AS from_activity, nxt AS to_activity, count(*) AS cnt FROM seq WHERE nxt IS NOT NULL GROUP BY ALL")
def dfg_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directly-follows graph of conversations."""
    return cc.dfg(tables.conversation_log(spark, sf_dir), _TALK_ORDER)


@query(
    "dfg_orders",
    f"WITH {_ORDERS}, {_SEQ.format(order='ts, idx, activity')} SELECT activity AS from_activity, nxt AS to_activity, count(*) AS cnt FROM seq WHERE nxt IS NOT NULL GROUP BY ALL",
)
def dfg_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directly-follows graph of orders; equal times in the order of activities."""
    return cc.dfg(tables.order_log(spark, sf_dir), ("ts", "event_idx", "activity"))


@query("activity_counts", "SELECT event_type AS activity, count(*) AS cnt FROM events GROUP BY ALL")
def activity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each activity."""
    return cc.activity_counts(tables.user_log(spark, sf_dir))


@query(
    "start_end_activities",
    f"WITH {_USERS}, {_SEQ.format(order='ts, idx')} SELECT 'start' AS kind, activity, count(*) AS cnt FROM seq WHERE n = 1 GROUP BY ALL UNION ALL SELECT 'end', activity, count(*) FROM seq WHERE nxt IS NULL GROUP BY ALL",
)
def start_end_activities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activities that start and end cases."""
    return cc.start_end_activities(tables.user_log(spark, sf_dir))


@query("variants_users", f"WITH {_USERS}, {_VARIANTS.format(order='ts, idx')} SELECT * FROM v")
def variants_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants of the user log."""
    return _text(cc.variants(tables.user_log(spark, sf_dir)))


@query("variants_conversations", f"WITH {_TALKS}, {_VARIANTS.format(order='idx')} SELECT variant, freq, freq * 100.0::DOUBLE / sum(freq) OVER () AS percentage FROM v")
def variants_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants of conversations with their share."""
    return _text(cc.variant_shares(_talk_variants(spark, sf_dir)))


@query("top_variants", f"WITH {_TALKS}, {_VARIANTS.format(order='idx')} SELECT * FROM v ORDER BY freq DESC, string_split(variant, '->') LIMIT 5")
def top_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most frequent conversation variants."""
    return _text(cc.top_variants(_talk_variants(spark, sf_dir), 5))


@query("projection_stats", f"WITH {_TALKS}, {_VARIANTS.format(order='idx')} SELECT count(*) AS n_variants, CAST(sum(freq) AS BIGINT) AS n_cases, (SELECT count(DISTINCT activity) FROM log) AS n_activities FROM v")
def projection_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of variants, cases and activities."""
    return cc.projection_stats(_talk_variants(spark, sf_dir))


@query(
    "weighted_dfg",
    f"WITH {_TALKS}, {_SEQ.format(order='idx')}, x AS (SELECT case_id, activity, nxt FROM seq UNION ALL SELECT case_id, '__START', activity FROM seq WHERE n = 1) SELECT activity AS from_activity, coalesce(nxt, '__END') AS to_activity, count(*) AS cnt FROM x GROUP BY ALL",
)
def weighted_dfg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directly-follows graph of variants with artificial start and end."""
    return cc.weighted_dfg(cc.with_start_end(_talk_variants(spark, sf_dir)))


@query("weighted_activity_counts", "SELECT role AS activity, count(*) AS cnt FROM conversations GROUP BY ALL")
def weighted_activity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activities of variants by frequency."""
    return cc.weighted_activity_counts(_talk_variants(spark, sf_dir))


@query(
    "filtered_dfg",
    f"""WITH {_USERS}, {_SEQ.format(order='ts, idx')}, d AS (SELECT activity AS from_activity, nxt AS to_activity, count(*) AS cnt FROM seq WHERE nxt IS NOT NULL GROUP BY ALL)
SELECT from_activity, to_activity, cnt FROM (SELECT *, avg(cnt) OVER (PARTITION BY from_activity) AS o, avg(cnt) OVER (PARTITION BY to_activity) AS i FROM d) WHERE cnt >= 10 AND (cnt >= 1.0 * o OR cnt >= 1.0 * i)""",
)
def filtered_dfg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations that are frequent for one of their ends."""
    return cc.filter_dfg(cc.dfg(tables.user_log(spark, sf_dir)), 10, 1.0)


@query("dfg_neighbours", f"WITH {_USERS}, {_SEQ.format(order='ts, idx')} SELECT 'in' AS side, activity, count(*) AS cnt FROM seq WHERE nxt = 'click' GROUP BY ALL UNION ALL SELECT 'out', nxt, count(*) FROM seq WHERE activity = 'click' AND nxt IS NOT NULL GROUP BY ALL")
def dfg_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pre- and postset of an activity."""
    d = cc.dfg(tables.user_log(spark, sf_dir))
    return cc.preset(d, "click").select(F.lit("in").alias("side"), "activity", "cnt").unionByName(cc.postset(d, "click").select(F.lit("out").alias("side"), "activity", "cnt"))


@query(
    "timestamp_histogram",
    f"""WITH {_USERS}, e AS (SELECT (epoch_us(ts) // 1000) AS ms, activity FROM log), s AS (SELECT min(ms) AS lo, max(ms) AS hi, (max(ms) - min(ms))::DOUBLE / 100 AS w FROM e)
SELECT CAST(round(lo + (b + 0.5) * w) AS BIGINT) AS bin_ms, activity, count(*) AS cnt FROM (SELECT *, least(floor((ms - lo)::DOUBLE / w), 99) AS b FROM e, s) GROUP BY ALL""",
)
def timestamp_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by time bin and activity."""
    return cc.timestamp_histogram(tables.user_log(spark, sf_dir))


@query(
    "dotted_chart",
    f"""WITH {_USERS}, d AS (SELECT case_id, idx AS event_idx, activity AS label, (epoch_us(ts) // 1000) AS x_absolute, first_value((epoch_us(ts) // 1000)) OVER w AS f, last_value((epoch_us(ts) // 1000)) OVER (PARTITION BY case_id ORDER BY ts, idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l, row_number() OVER w - 1 AS x_step FROM log WINDOW w AS (PARTITION BY case_id ORDER BY ts, idx)),
c AS (SELECT case_id, row_number() OVER (ORDER BY min(f) NULLS FIRST, case_id) - 1 AS y_case FROM d GROUP BY case_id),
y AS (SELECT label, row_number() OVER (ORDER BY m) - 1 AS y_label FROM (SELECT label, min([y_case, x_step]) AS m FROM d JOIN c USING (case_id) GROUP BY label))
SELECT case_id, event_idx, label, x_absolute, x_absolute - f AS x_since_start, CASE WHEN l = f THEN 0.0 ELSE (x_absolute - f)::DOUBLE / (l - f) END AS x_relative, x_step, y_case, y_label FROM d JOIN c USING (case_id) JOIN y USING (label)""",
)
def dotted_chart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All dots of the dotted chart."""
    return cc.dotted_chart(tables.user_log(spark, sf_dir))


@query("log_statistics", "SELECT count(DISTINCT user_id) AS n_cases, count(*) AS n_events, count(*)::DOUBLE / count(DISTINCT user_id) AS mean_events FROM events")
def log_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases, events and their mean."""
    return cc.log_statistics(tables.user_log(spark, sf_dir))


@query("classifier_counts", "SELECT event_type || '+' || coalesce(json_extract_string(props, '$.k'), '') AS activity, count(*) AS cnt FROM events GROUP BY ALL")
def classifier_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class identities of a two-key classifier."""
    e = tables.table(spark, sf_dir, "events").select("event_type", F.get_json_object("props", "$.k").alias("k"))
    return cc.classify(e, ["event_type", "k"]).groupBy("activity").agg(F.count("*").alias("cnt"))


@query("activity_split", "SELECT CASE WHEN event_type IN ('click', 'view') THEN 0 ELSE 1 END AS part, user_id::VARCHAR AS case_id, count(*) AS cnt FROM events GROUP BY ALL")
def activity_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each case in two sub-logs by activity."""
    log = tables.user_log(spark, sf_dir)
    acts = {r[0] for r in cc.activity_counts(log).select("activity").collect()}  # the log's alphabet
    parts = cc.split_by_activity(log, [acts & {"click", "view"}, acts - {"click", "view"}])
    counted = [p.events.groupBy(F.lit(i).alias("part"), "case_id").agg(F.count("*").alias("cnt")) for i, p in enumerate(parts)]
    return counted[0].unionByName(counted[1])


@query("random_split_total", "SELECT count(*) AS n_events FROM events")
def random_split_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A random split loses and doubles no event."""
    parts = cc.split_at_random(tables.user_log(spark, sf_dir), 3, seed=7)
    every = parts[0].events.unionByName(parts[1].events).unionByName(parts[2].events)
    return every.agg(F.countDistinct("event_idx").alias("n_events"))


@query("inserted_variants", f"WITH {_TALKS}, {_VARIANTS.format(order='idx')} SELECT replace(replace(variant, 'user->assistant', 'user->tau->assistant'), 'user->assistant', 'user->tau->assistant') AS variant, CAST(sum(freq) AS BIGINT) AS freq FROM v GROUP BY ALL")
def inserted_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A silent activity put between two that follow each other."""
    return _text(cc.insert_between(_talk_variants(spark, sf_dir), "user", "assistant", "tau"))


def _talk_net() -> PetriNet:
    net = PetriNet()
    for p in ("p1", "p2", "p3"):
        net.add_place(p)
    for t, a, b in (("user", "p1", "p2"), ("assistant", "p2", "p1"), ("system", "p1", "p3")):
        net.add_transition(t, t)
        net.add_arc(a, t)
        net.add_arc(t, b)
    net.initial_marking, net.final_markings = {"p1": 1}, [{"p3": 1}]
    return net


@query(
    "token_replay",
    # one token per place: replay row by row with a recursive table over each case's steps
    f"""WITH RECURSIVE {_TALKS}, s AS (SELECT case_id, activity, row_number() OVER (PARTITION BY case_id ORDER BY idx) AS n FROM log WHERE activity IN ('user', 'assistant', 'system')),
r AS (SELECT case_id, CAST(0 AS BIGINT) AS n, 1::BIGINT AS a, 0::BIGINT AS b, 0::BIGINT AS c, 0::BIGINT AS miss FROM (SELECT DISTINCT case_id FROM log)
  UNION ALL SELECT r.case_id, s.n,
    CASE activity WHEN 'assistant' THEN a + 1 ELSE greatest(a - 1, 0) END,
    CASE activity WHEN 'user' THEN b + 1 WHEN 'assistant' THEN greatest(b - 1, 0) ELSE b END,
    CASE activity WHEN 'system' THEN c + 1 ELSE c END,
    miss + CASE WHEN activity = 'assistant' THEN greatest(1 - b, 0) ELSE greatest(1 - a, 0) END
  FROM r JOIN s ON s.case_id = r.case_id AND s.n = r.n + 1),
f AS (SELECT r.* FROM r JOIN (SELECT case_id, max(n) AS n FROM r GROUP BY case_id) USING (case_id, n)),
t AS (SELECT CAST(sum(n + 1) AS BIGINT) AS produced, CAST(sum(n + 1) AS BIGINT) AS consumed, CAST(sum(miss + greatest(1 - c, 0)) AS BIGINT) AS missing, CAST(sum(a + b + greatest(c - 1, 0)) AS BIGINT) AS remaining FROM f)
SELECT *, 0.5 * (1.0 - missing::DOUBLE / consumed) + 0.5 * (1.0 - remaining::DOUBLE / produced) AS fitness FROM t""",
)
def replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token-based replay of conversations on a small net."""
    return token_replay(_talk_variants(spark, sf_dir), _talk_net())


# -- object-centric --------------------------------------------------------------------


@query("ocel_size", f"WITH {_OCEL} SELECT (SELECT count(*) FROM ev) AS num_events, (SELECT count(*) FROM ob) AS num_objects")
def ocel_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of events and objects."""
    return oc.size(tables.order_ocel(spark, sf_dir))


@query("ocel_type_stats", f"WITH {_OCEL} SELECT 'event' AS kind, event_type AS type, count(*) AS cnt FROM ev GROUP BY ALL UNION ALL SELECT 'object', object_type, count(*) FROM ob GROUP BY ALL")
def ocel_type_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events and objects by type."""
    return oc.type_stats(tables.order_ocel(spark, sf_dir))


@query("ocel_type_links", f"WITH {_OCEL} SELECT event_type, object_type, count(*) AS cnt FROM e2o JOIN ob USING (object_id) JOIN ev USING (event_id) GROUP BY ALL")
def ocel_type_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E2O rows by event and object type."""
    return oc.type_link_counts(tables.order_ocel(spark, sf_dir))


@query(
    "ocel_conversion_rate",
    f"""WITH {_OCEL} SELECT count(*) FILTER (object_id IN (SELECT source_id FROM o2o WHERE target_id IN (SELECT object_id FROM link WHERE object_type = 'order' AND event_type = 'ship item')))::DOUBLE / count(*) AS rate FROM ob WHERE object_type = 'customer'""",
)
def ocel_conversion_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with a shipped order."""
    return oc.conversion_rate(tables.order_ocel(spark, sf_dir), "ship item", "customer", "order")


@query("ocel_orphans", f"WITH {_OCEL} SELECT object_type, count(*) AS cnt FROM ob WHERE object_id IN (SELECT object_id FROM e2o) GROUP BY ALL")
def ocel_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects by type without those that no event has."""
    return oc.without_orphans(tables.order_ocel(spark, sf_dir)).objects.groupBy("object_type").agg(F.count("*").alias("cnt"))


@query(
    "ocel_involvement",
    f"WITH {_OCEL} SELECT event_type, object_type, min(n) AS least, max(n) AS most FROM (SELECT event_id, event_type, object_type, count(*) AS n FROM e2o JOIN ob USING (object_id) JOIN ev USING (event_id) GROUP BY ALL) GROUP BY ALL",
)
def ocel_involvement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects of a type in an event."""
    return oc.involvement(tables.order_ocel(spark, sf_dir))


_OO = "SELECT object_type, other_type, min(n) AS least, max(n) AS most FROM (SELECT {a}, x.object_type, y.object_type AS other_type, count(*) AS n FROM o2o JOIN ob x ON x.object_id = {a} JOIN ob y ON y.object_id = {b} GROUP BY ALL) GROUP BY ALL"


@query("ocel_object_involvement", f"WITH {_OCEL} {_OO.format(a='source_id', b='target_id')}")
def ocel_object_involvement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects related to an object."""
    return oc.object_involvement(tables.order_ocel(spark, sf_dir))


@query("ocel_object_involvement_reverse", f"WITH {_OCEL} {_OO.format(a='target_id', b='source_id')}")
def ocel_object_involvement_reverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects that an object is related from."""
    return oc.object_involvement(tables.order_ocel(spark, sf_dir), reverse=True)


@query("ocel_related_objects", f"WITH {_OCEL} SELECT qualifier, other_type, count(*) AS cnt FROM (SELECT DISTINCT source_id, target_id, qualifier, object_type AS other_type FROM o2o JOIN ob ON object_id = target_id) GROUP BY ALL")
def ocel_related_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O2O by qualifier and type."""
    return oc.related_objects(tables.order_ocel(spark, sf_dir)).groupBy("qualifier", "other_type").agg(F.count("*").alias("cnt"))


_OSEQ = "q AS (SELECT object_id, object_type, event_type, event_id, ts, lead(event_type) OVER w AS nxt, lag(ts) OVER w AS prev, row_number() OVER w AS n FROM link WINDOW w AS (PARTITION BY object_id ORDER BY ts, event_id))"


@query("ocel_dfg", f"WITH {_OCEL}, {_OSEQ} SELECT object_type, event_type AS from_activity, nxt AS to_activity, count(*) AS cnt FROM q WHERE nxt IS NOT NULL GROUP BY ALL")
def ocel_dfg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directly-follows graphs along objects."""
    return oc.object_dfg(tables.order_ocel(spark, sf_dir))


@query(
    "ocel_flattened_dfg",
    f"""WITH {_OCEL}, l AS (SELECT * FROM e2o JOIN ob USING (object_id) JOIN ev USING (event_id)),
q AS (SELECT object_type, event_type, lead(event_type) OVER (PARTITION BY object_id ORDER BY ts, event_id) AS nxt FROM l) SELECT object_type, event_type AS from_activity, nxt AS to_activity, count(*) AS cnt FROM q WHERE nxt IS NOT NULL GROUP BY ALL""",
)
def ocel_flattened_dfg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directly-follows graphs of all flattened logs."""
    return oc.flattened_dfg(tables.order_ocel(spark, sf_dir))


@query("ocel_flatten", f"WITH {_OCEL} SELECT object_id AS case_id, count(*) AS cnt FROM e2o JOIN ob USING (object_id) JOIN ev USING (event_id) WHERE object_type = 'supplier' GROUP BY ALL")
def ocel_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each case of a flattened log."""
    return oc.flatten(tables.order_ocel(spark, sf_dir), "supplier").events.groupBy("case_id").agg(F.count("*").alias("cnt"))


@query(
    "ocel_variants",
    f"WITH {_OCEL}, v AS (SELECT object_id, string_agg(event_type, '->' ORDER BY ts, event_id) AS variant FROM link WHERE object_type = 'order' GROUP BY object_id) SELECT coalesce(variant, '') AS variant, count(*) AS freq FROM ob LEFT JOIN v USING (object_id) WHERE object_type = 'order' GROUP BY ALL",
)
def ocel_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants along orders."""
    return _text(oc.object_variants(tables.order_ocel(spark, sf_dir), "order"))


_PERF = f"WITH {_OCEL}, {_OSEQ}, p AS (SELECT event_id, event_type, ts, epoch_us(max(prev)) AS hi, epoch_us(min(prev)) AS lo FROM q WHERE prev IS NOT NULL GROUP BY ALL)"
_SYNC = f"{_PERF} SELECT p.event_id, p.event_type, hi - lo AS sync_us, min(q.object_id) AS delaying_object FROM p JOIN q ON q.event_id = p.event_id AND epoch_us(q.prev) = hi GROUP BY ALL"
_SOJOURN = f"{_PERF} SELECT event_id, event_type, epoch_us(ts) - hi AS sojourn_us FROM p"


@query("ocel_synchronisation", _SYNC)
def ocel_synchronisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Synchronisation time of every event."""
    return oc.synchronisation(tables.order_ocel(spark, sf_dir))


@query("ocel_sojourn", _SOJOURN)
def ocel_sojourn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sojourn time of every event."""
    return oc.sojourn(tables.order_ocel(spark, sf_dir))


@query("ocel_top_synchronisation", f"SELECT * FROM ({_SYNC}) ORDER BY sync_us DESC, event_id LIMIT 20")
def ocel_top_synchronisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 longest synchronisation times."""
    return oc.longest(oc.synchronisation(tables.order_ocel(spark, sf_dir)), "sync_us", 20)


@query("ocel_top_sojourn", f"SELECT * FROM ({_SOJOURN}) ORDER BY sojourn_us DESC, event_id LIMIT 20")
def ocel_top_sojourn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 longest sojourn times."""
    return oc.longest(oc.sojourn(tables.order_ocel(spark, sf_dir)), "sojourn_us", 20)


@query("ocel_first_last", f"WITH {_OCEL} SELECT object_type, object_id, coalesce(epoch_us(min(ts)), 0) AS first_us, coalesce(epoch_us(max(ts)), 0) AS last_us FROM ob LEFT JOIN link USING (object_id, object_type) GROUP BY ALL")
def ocel_first_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last event time of every object."""
    return oc.first_last(tables.order_ocel(spark, sf_dir)).select("object_type", "object_id", F.unix_micros("first_ts").alias("first_us"), F.unix_micros("last_ts").alias("last_us"))


@query("ocel_init_exit", f"WITH {_OCEL} SELECT event_type, count(*) AS cnt FROM (SELECT event_type FROM ev UNION ALL SELECT '<init> ' || object_type FROM ob UNION ALL SELECT '<exit> ' || object_type FROM ob) GROUP BY ALL")
def ocel_init_exit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by type with init and exit events."""
    return oc.with_init_exit(tables.order_ocel(spark, sf_dir)).events.groupBy("event_type").agg(F.count("*").alias("cnt"))


@query(
    "ocel_attribute_history",
    f"""WITH a AS (SELECT 'o-' || o_orderkey AS object_id, o_orderstatus AS status, o_orderpriority AS priority, NULL AS qty, TIMESTAMP '1970-01-01' AS ts FROM orders
  UNION ALL SELECT 'o-' || l_orderkey, NULL, NULL, CAST(CAST(sum(l_quantity) AS BIGINT) AS VARCHAR), l_shipdate FROM lineitem GROUP BY l_orderkey, l_shipdate),
h AS (SELECT object_id, row_number() OVER w AS n, epoch_us(ts) AS from_us, epoch_us(lead(ts) OVER w) AS to_us, last_value(status IGNORE NULLS) OVER w AS status, last_value(priority IGNORE NULLS) OVER w AS priority, last_value(qty IGNORE NULLS) OVER w AS qty FROM a WINDOW w AS (PARTITION BY object_id ORDER BY ts))
SELECT object_id, object_id || '-attrs-' || n AS change_id, from_us, to_us, status, priority, qty FROM h
UNION ALL SELECT object_id, object_id || '-attrs-0', NULL, epoch_us(min(ts)), NULL, NULL, NULL FROM a GROUP BY object_id""",
)
def ocel_attribute_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attribute history of orders as intervals."""
    h = oc.attribute_history(tables.order_ocel(spark, sf_dir), "order")
    a = lambda k, name: F.try_element_at("attrs", F.lit(k)).alias(name)
    return h.select("object_id", "change_id", F.unix_micros("from_ts").alias("from_us"), F.unix_micros("to_ts").alias("to_us"), a("status", "status"), a("priority", "priority"), a("last_shipped_qty", "qty"))


@query(
    "ocel_abstraction",
    f"""WITH {_OCEL}, {_OSEQ}, n AS (SELECT event_type, object_type, count(DISTINCT event_id) AS e, count(DISTINCT object_id) AS o FROM link GROUP BY ALL),
t AS (SELECT event_type, count(DISTINCT event_id) AS e FROM link GROUP BY ALL), c AS (SELECT object_type, count(*) AS o FROM ob GROUP BY ALL),
s AS (SELECT x.object_id, x.object_type, x.event_type, x.event_id, coalesce(string_agg(y.object_id, ',' ORDER BY y.object_id), '') AS k FROM link x LEFT JOIN link y ON y.event_id = x.event_id AND y.object_type != x.object_type GROUP BY ALL)
SELECT 'related' AS property, object_type, event_type AS ev_a, NULL AS ev_b FROM n
UNION ALL SELECT 'deficient', object_type, event_type, NULL FROM n JOIN t USING (event_type) WHERE n.e < t.e
UNION ALL SELECT 'optional', object_type, event_type, NULL FROM n JOIN c USING (object_type) WHERE n.o < c.o
UNION ALL SELECT DISTINCT 'convergent', object_type, event_type, NULL FROM (SELECT event_id, event_type, object_type FROM link GROUP BY ALL HAVING count(*) > 1)
UNION ALL SELECT DISTINCT 'divergent', object_type, event_type, NULL FROM (SELECT object_id, object_type, event_type FROM s GROUP BY ALL HAVING count(DISTINCT k) > 1)
UNION ALL SELECT DISTINCT 'start', object_type, event_type, NULL FROM q WHERE n = 1
UNION ALL SELECT DISTINCT 'end', object_type, event_type, NULL FROM q WHERE nxt IS NULL
UNION ALL SELECT DISTINCT 'df', object_type, event_type, nxt FROM q WHERE nxt IS NOT NULL""",
)
def ocel_abstraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language abstraction of the log."""
    return oc.abstraction(tables.order_ocel(spark, sf_dir))


_DECLARE_ARCS = {
    "ef_each": (Arc("place order", "ship item", "EF", each=(("order", None),), least=1), "count(*) FILTER (t.ts > s.ts) >= 1"),
    "ep_each_max": (Arc("place order", "ship item", "EP", each=(("order", None),), least=0, most=1), "count(*) FILTER (t.ts < s.ts) <= 1"),
    "as_all": (Arc("place order", "ship item", "AS", all=(("order", None),), least=1, most=6), "count(t.ts) BETWEEN 1 AND 6"),
}


def _declare(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return conformance(tables.order_ocel(spark, sf_dir), _DECLARE_ARCS[name][0])

    run.__doc__ = f"Conformance of the arc {_DECLARE_ARCS[name][0]}."
    return run


for _name, (_, _test) in _DECLARE_ARCS.items():
    query(
        f"declare_{_name}",
        f"""WITH {_OCEL}, s AS (SELECT event_id, ts, object_id FROM link WHERE event_type = 'place order' AND object_type = 'order'),
t AS (SELECT event_id, ts, object_id FROM link WHERE event_type = 'ship item' AND object_type = 'order'),
k AS (SELECT s.event_id, {_test} AS good FROM s LEFT JOIN t ON t.object_id = s.object_id GROUP BY s.event_id)
SELECT count(*) AS total, count(*) FILTER (NOT good) AS violated, 1.0 - count(*) FILTER (NOT good)::DOUBLE / count(*) AS conformance FROM k""",
    )(_declare(_name))
