"""Windows along objects of which one has half of all events."""

import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventloom.operators import segments


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("share", [1, 4, 1024, 10**6])
def test_neighbours_equal_plain_windows(spark, monkeypatch, share):
    monkeypatch.setattr(segments, "HOT_SHARE", share)
    monkeypatch.setattr(segments, "SEGMENTS", 7)
    r = random.Random(share)
    data = [("hot" if i % 2 else f"o{r.randrange(9)}", r.choice([None, *range(40)]), i, r.choice(["a", "b", None])) for i in range(400)]
    frame = spark.createDataFrame(data, "o string, t long, i long, x string").withColumn("ts", F.timestamp_seconds("t"))
    w = W.partitionBy("o").orderBy("ts", "i")
    want = frame.withColumns({"nx": F.lead("x").over(w), "pt": F.lag("ts").over(w), "n": F.row_number().over(w)})
    got = segments.Along(frame, "o", segments.hot_keys(frame, "o"), ("ts", "i")).with_neighbours({"nx": "x"}, {"pt": "ts"}, "n")
    assert rows(got.select(*want.columns)) == rows(want)


def test_a_hot_object_is_spread_over_tasks(spark):
    frame = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("o"), (F.col("id") % 5000).cast("string"))).alias("o"), F.timestamp_seconds("id").alias("ts"), F.col("id").alias("i"))
    hot = segments.hot_keys(frame, "o")
    assert [r.o for r in hot.collect()] == ["hot"]
    marked = segments.segmented(frame, "o", hot, F.unix_micros("ts"))
    spread = marked.filter("o = 'hot'").groupBy("_seg").count()
    assert spread.count() == segments.SEGMENTS and spread.agg(F.max("count")).first()[0] <= 2 * 10_000 / segments.SEGMENTS
    assert marked.filter("o != 'hot' AND _seg IS NOT NULL").isEmpty()


def test_constraints_with_hot_objects_and_batches(spark, monkeypatch):
    """Counts along divided objects and in batches equal those of plain pairs of events."""
    from eventloom import builders
    from eventloom.operators import ocdeclare
    from eventloom.operators.ocdeclare import Arc

    r = random.Random(12)
    events = [(r.choice("abc"), sorted({f"h:{r.randrange(2)}", f"o:{r.randrange(12)}", f"o:{r.randrange(12)}"} - ({"h:1"} if r.random() < 0.3 else set()))) for _ in range(120)]
    log = builders.make_ocel(spark, events)
    arcs = [Arc(x, y, arrow, **{kind: ((k, None),)}, least=least, most=most) for x, y in ("ab", "bc", "aa") for arrow in ("AS", "EF", "EP") for kind in ("each", "any") for k in "ho" for least, most in ((1, None), (0, 9))]

    def brute(arc):
        (kind, _), = arc.each + arc.any
        bad = total = 0
        for i, (x, objects) in enumerate(events):
            if x != arc.source:
                continue
            total += 1
            when = {"AS": lambda j: True, "EF": lambda j: j > i, "EP": lambda j: j < i}[arc.arrow]  # noqa: B023
            counts = [sum(y == arc.target and o in other and when(j) for j, (y, other) in enumerate(events)) for o in objects if o.startswith(kind)]
            counts = counts if arc.each else [sum(counts)]
            bad += any(n < arc.least or arc.most is not None and n > arc.most for n in counts)
        return total, bad

    want = [brute(a) for a in arcs]
    for share, n in ((1, 5), (10, 3), (1024, 256)):
        monkeypatch.setattr(segments, "HOT_SHARE", share)
        monkeypatch.setattr(segments, "SEGMENTS", n)
        assert ocdeclare.conformances(log, arcs) == want
    monkeypatch.setattr(ocdeclare, "LEAST_BATCHED", 0)
    for noise in (0.0, 0.2, 0.5):
        got = ocdeclare.conformances(log, arcs, noise=noise)
        assert [t and ocdeclare.holds(t, v, noise) for t, v in got] == [t and ocdeclare.holds(t, v, noise) for t, v in want]
        assert all(v == w or v < w and not ocdeclare.holds(t, v, noise) for (t, v), (_, w) in zip(got, want))


def test_constraints_of_several_objects(spark, monkeypatch):
    """Sets of objects, with every arrow and kind of association, against pairs of events in Python."""
    import itertools

    from eventloom import builders
    from eventloom.operators import ocdeclare
    from eventloom.operators.ocdeclare import Arc

    r = random.Random(7)
    events = [(r.choice("abc"), sorted({"h:0", *(f"o:{r.randrange(5)}" for _ in range(r.randrange(3))), *(f"p:{r.randrange(3)}" for _ in range(r.randrange(3)))} - ({"h:0"} if r.random() < 0.2 else set()))) for _ in range(90)]
    log = builders.make_ocel(spark, events)
    kinds = [
        {"each": "op"}, {"each": "ho"}, {"each": "oo"}, {"all": "o"}, {"all": "ho"}, {"each": "o"}, {"any": "o"}, {"each": "o", "all": "p"},
        {"each": "h", "any": "o"}, {"all": "o", "any": "p"}, {"any": "op"}, {"each": "op", "any": "h", "all": "p"},
    ]
    arcs = [
        Arc(x, y, arrow, **{k: tuple((t, None) for t in v) for k, v in kind.items()}, least=least, most=most)
        for kind in kinds for arrow in ocdeclare.ARROWS for x, y, least, most in (("a", "b", 1, None), ("a", "a", 0, 2))
    ]

    def brute(arc):
        total = bad = 0
        of = lambda objects, x: [o for o in objects if o.startswith(x[0])]
        for i, (x, objects) in enumerate(events):
            if x != arc.source:
                continue
            total += 1
            counts = []
            for own in itertools.product(*(of(objects, e) for e in arc.each)):
                must = {*own, *(o for a in arc.all for o in of(objects, a))}
                some = [of(objects, a) for a in arc.any]
                loose = not (arc.each or arc.all) and all(len(g) > 1 for g in some)
                near, n = [], 0
                for j, (y, other) in enumerate(events):
                    if {"AS": False, "EF": j <= i, "DF": j <= i, "EP": j >= i, "DP": j >= i}[arc.arrow]:
                        continue
                    if not must and not any(some) or not must <= set(other) or not all(set(g) & set(other) for g in some):
                        continue
                    near.append(y)
                    n += (y == arc.target) * (max((len(g), len(set(g) & set(other))) for g in some)[1] if loose else 1)
                if arc.arrow in ("DF", "DP"):
                    n = int(bool(near) and near[0 if arc.arrow == "DF" else -1] == arc.target)
                counts.append(n)
            bad += any(n < arc.least or arc.most is not None and n > arc.most for n in counts)
        return total, bad

    want = [brute(a) for a in arcs]
    assert len({b for _, b in want}) > 10
    for share, n in ((1024, 256), (3, 4)):
        monkeypatch.setattr(segments, "HOT_SHARE", share)
        monkeypatch.setattr(segments, "SEGMENTS", n)
        got = ocdeclare.conformances(log, arcs)
        assert got == want, [(str(a), g, w) for a, g, w in zip(arcs, got, want) if g != w][:5]
