"""Databases and XML of many rows: whole, and held a batch at a time."""

import io
import time

from eventloom.plans import links
from eventloom.sources import ocel


def test_duckdb_takes_rows_at_once(tmp_path):
    import duckdb

    con = duckdb.connect(str(tmp_path / "x.duckdb"))
    ocel._run_duckdb(con, 'CREATE TABLE "a" (x TEXT, y BIGINT, z TEXT)')
    began = time.perf_counter()
    for k in range(10):
        ocel._run_duckdb(con, 'INSERT INTO "a" VALUES (?, ?, ?)', [(str(i), i if i % 3 else None, None) for i in range(k * 5000, k * 5000 + 5000)])
    assert time.perf_counter() - began < 10  # row by row takes longer
    ocel._run_duckdb(con, 'INSERT INTO "a" VALUES (?, ?, ?)', [("one", 1, 5), ("two", None, "5.0"), ("three", 2, True)])
    assert con.execute("SELECT count(*), count(y), sum(y) FROM a WHERE z IS NULL").fetchone() == (50_000, 33_333, sum(i for i in range(50_000) if i % 3))
    assert sorted(r[0] for r in con.execute("SELECT z FROM a WHERE z IS NOT NULL").fetchall()) == ["5", "5.0", "true"]


def test_tables_are_read_as_a_stream(spark):
    """No list of rows is made: ``ask`` gives each row once, and no more than a batch is held."""
    n, held = 45_000, []

    def ask(sql):
        if "map_type" in sql:
            return iter([("a", "a")] if "event" in sql else [("b", "b")])
        if "event_object" in sql or "object_object" in sql:
            return iter([("e0", "o1", "q"), ("e0", "o1", "q")])
        return ((f"{'e' if 'event_' in sql else 'o'}{i // 2}", "2020-01-01 00:00:00", None, i) for i in range(n) if not held.append(1))

    log = ocel._from_sql(spark, ask, lambda t: [("ocel_id", "TEXT"), ("ocel_time", "TIMESTAMP"), ("v", "BIGINT")])
    assert log.events.count() == n and log.objects.count() == (n + 1) // 2 and log.e2o.count() == log.o2o.count() == 1
    assert log.event_attrs.count() == log.object_attrs.count() == n
    assert log.objects.orderBy("object_idx").first().object_id == "o0"
    assert len(log.objects.inputFiles()) == 1  # what was read lies in a file, not in the driver


def test_xml_elements_are_let_go(tmp_path):
    """Memory doesn't grow with the number of elements."""
    import tracemalloc

    event = '<event id="e%d" type="a" time="2020-01-01T00:00:00Z"><attributes/><objects><relationship object-id="o" qualifier="q"/></objects></event>'
    head = '<log><event-types><event-type name="a"><attributes/></event-type></event-types><events>'

    def peak(n):
        text = io.BytesIO((head + "".join(event % i for i in range(n)) + "</events></log>").encode())
        tracemalloc.start()
        found = sum(1 for _ in ocel.parse_xml(text))
        top = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert found == n + 1
        return top

    assert peak(40_000) < 2 * peak(10_000)


def test_xml_files_are_no_rows(spark, tmp_path):
    """A file's bytes never become a value, of which 2 GB is the most."""
    path = str(tmp_path / "log.xml")
    ocel.write_ocel(links.trade_ocel(spark, "/root/testdata/sf0.001"), path)
    log = ocel.read_ocel(spark, path)
    assert "ReadSchema: struct<path:string>" in log.events._jdf.queryExecution().executedPlan().toString()
    assert log.events.count() > 0
