"""Canonical forms of partial orders against all permutations, and of many like events."""

import random
import time
from itertools import permutations

from eventloom.models.partial_order import PartialTrace, canonical_form, partial_variants


def test_canonical_forms_equal_those_of_all_orders():
    r = random.Random(5)
    forms = {}
    for _ in range(150):
        n = r.randint(0, 5)
        labels = [r.choice("ab") for _ in range(n)]
        edges = [(i, j) for i in range(n) for j in range(n) if i != j and r.random() < r.choice([0.2, 0.5])]
        least = min(([labels[v] for v in p], sorted((p.index(a), p.index(b)) for a, b in edges)) for p in permutations(range(n))) if n else ([], [])
        form = canonical_form(labels, edges)
        assert forms.setdefault(str(least), form) == form
        p = list(range(n))
        r.shuffle(p)
        assert canonical_form([labels[v] for v in p], [(p.index(a), p.index(b)) for a, b in edges]) == form
    assert len(set(forms.values())) == len(forms)


def test_like_events_take_no_time():
    r = random.Random(1)
    graphs = {
        "alone": (30, []), "pairs": (30, [(2 * i, 2 * i + 1) for i in range(15)]), "chains": (30, [(i, i + 1) for i in range(29) if i % 5 != 4]),
        "between": (30, [(0, i) for i in range(1, 29)] + [(i, 29) for i in range(1, 29)]), "ring": (30, [(i, (i + 1) % 30) for i in range(30)]), "layers": (30, [(i, j) for i in range(15) for j in range(15, 30)]),
    }
    for name, (n, edges) in graphs.items():
        began, p = time.perf_counter(), list(range(n))
        form = canonical_form(["a"] * n, edges)
        assert time.perf_counter() - began < 1, name
        r.shuffle(p)
        assert canonical_form(["a"] * n, [(p.index(a), p.index(b)) for a, b in edges]) == form, name
    assert len({canonical_form(["a"] * n, e) for n, e in graphs.values()}) == 6


def test_traces_and_variants(spark):
    a = PartialTrace({str(i): {"concept:name": n} for i, n in enumerate("wxyz")}, {("0", "1"), ("0", "2"), ("1", "3"), ("2", "3")})
    b = PartialTrace({f"e{i}": {"concept:name": n} for i, n in enumerate("zyxw")}, {("e3", "e2"), ("e3", "e1"), ("e2", "e0"), ("e1", "e0")})
    assert a.canonical() == b.canonical() and PartialTrace().canonical() == PartialTrace().canonical()
    events = spark.createDataFrame([("1", 0, "a"), ("1", 1, "b"), ("2", 7, "b"), ("2", 8, "a"), ("3", 0, "a"), ("3", 1, "b"), ("4", 0, None)], "case_id string, event_id long, activity string")
    relations = spark.createDataFrame([("1", 0, 1), ("2", 8, 7), ("2", 8, 99), ("5", 0, 1)], "case_id string, before long, after long")
    assert sorted((r.n_events, r.freq) for r in partial_variants(events, relations).collect()) == [(1, 1), (2, 1), (2, 2)]
