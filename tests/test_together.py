"""Events with their objects in one row say what joins of the tables say, on odd tables too."""

import datetime
from dataclasses import replace

import pytest

from eventloom.operators import objectcentric as oc
from eventloom.operators.ocdeclare import Arc, _counted, conformance
from eventloom.sources import tables


def day(n):
    return datetime.datetime(2020, 1, 1) + datetime.timedelta(n)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def write(spark, folder, orders, lines):
    frames = {
        "customer": spark.createDataFrame([(1,), (2,)], "c_custkey long"), "part": spark.createDataFrame([(i,) for i in range(1, 4)], "p_partkey long"),
        "supplier": spark.createDataFrame([(1,), (2,)], "s_suppkey long"),
        "orders": spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz, o_orderstatus string, o_orderpriority string"),
        "lineitem": spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_shipdate timestamp_ntz, l_quantity double"),
    }
    for name, frame in frames.items():
        frame.coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


ORDERS = [(1, 1, day(0), "O", "1"), (2, 2, day(3), "F", "2"), (3, 9, day(4), "F", "2"), (4, None, day(5), "F", "2")]
#: One shipment twice, of an order, a part and a supplier that aren't there, and of columns that are null.
LINES = [
    (1, 1, 1, 1, day(1), 1.0), (1, 2, 2, 1, day(2), 1.0), (1, 2, 2, 1, day(2), 1.0), (2, 1, 1, 2, day(3), 1.0), (2, 2, 1, 1, day(5), 1.0), (7, 1, 1, 1, day(6), 1.0), (3, 1, 8, 1, day(6), 1.0),
    (3, 2, 1, 8, day(7), 1.0), (3, 1, None, 1, day(7), 1.0), (3, 1, 1, None, day(7), 1.0), (None, 3, 1, 1, day(8), 1.0), (2, 3, 3, 2, None, 1.0), (1, 3, 1, 1, day(9), 1.0),
]


def test_relationships_need_no_join(spark, tmp_path):
    log = tables.order_ocel(spark, write(spark, tmp_path / "t", [x for x in ORDERS if x[1]], [x for x in LINES if None not in x]))
    assert log.rows() is not None
    assert "Join" not in log.linked()._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("twice", [False, True])
def test_odd_tables_give_what_joins_give(spark, tmp_path, twice):
    """With an order twice, of two customers, the tables are joined."""
    log = tables.order_ocel(spark, write(spark, tmp_path / "t", ORDERS + ([(1, 2, day(0), "O", "1")] if twice else []), LINES))
    plain = replace(log, together=None)
    assert (log.rows() is None) == twice
    columns = ["event_id", "object_id", "object_type", "event_type", "ts", "event_idx"]
    assert rows(log.linked().select(columns)) == rows(plain.linked().select(columns))
    few = log.objects.filter("object_type = 'part'")
    assert rows(replace(log, objects=few).linked().select(columns)) == rows(replace(plain, objects=few).linked().select(columns))
    assert replace(log, events=log.events.limit(1)).rows() is None


ARCS = [
    Arc("ship item", "ship item", "DP", each=(("order", None), ("supplier", None))), Arc("ship item", "ship item", "EF", all=(("order", None),), any=(("part", None),)),
    Arc("place order", "ship item", "DF", each=(("order", None),)), Arc("place order", "ship item", "EF", each=(("order", None), ("part", "order"))),
    Arc("place order", "ship item", "AS", all=(("order", None),), least=1, most=2), Arc("ship item", "place order", "EP", each=(("order", None),)),
]


@pytest.mark.parametrize("arc", ARCS, ids=str)
def test_arcs_along_rows_equal_those_along_sets(spark, tmp_path, arc):
    log = tables.order_ocel(spark, write(spark, tmp_path / "t", [x for x in ORDERS if x[1]], [x for x in dict.fromkeys(LINES) if None not in x]))
    assert (_counted(log, [arc]) is not None) == (arc.arrow == "AS")
    assert rows(conformance(log, arc)) == rows(conformance(replace(log, together=None), arc))


def test_an_event_of_an_unknown_object_has_no_time_before(spark, tmp_path):
    """Of the events before, those of known objects count, as in SQL."""
    log = tables.order_ocel(spark, write(spark, tmp_path / "t", [x for x in ORDERS if x[1]], [(7, 1, 1, 1, day(1), 1.0), (7, 2, 2, 2, day(2), 1.0)]))
    assert oc.sojourn(log).isEmpty()
