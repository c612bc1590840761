"""Loop pairs against an enumeration of simple paths, and in dense graphs."""

import random
import time
from collections import Counter

from eventloom.models import alpha
from eventloom.operators.casecentric import START


def by_enumeration(df, least):
    after = {}
    for (a, b), n in df.items():
        if n >= least:
            after.setdefault(a, []).append(b)
    found = set()

    def walk(path):
        for b in after.get(path[-1], ()):
            if b in path:
                if b != path[-1]:
                    found.add((path[-1], b))
            else:
                walk([*path, b])

    walk([START])
    return {(x, y) for x, y in found if y != START}


def test_loop_pairs_equal_enumeration():
    r = random.Random(3)
    for n in range(400):
        acts = [START, *"abcdefg"[: r.randint(2, 7)]]
        df = Counter({(a, b): r.randint(1, 3) for a in acts for b in acts if b != START and r.random() < r.choice([0.2, 0.35, 0.6])})
        assert alpha.loop_pairs(df, 2) == by_enumeration(df, 2), df
    assert alpha.loop_pairs(Counter(), 1) == set()


def test_dense_graphs_take_no_time():
    acts = [f"a{i}" for i in range(30)]
    df = Counter({(a, b): 1 for a in acts for b in acts})
    df |= Counter({(START, "h"): 1, **{("h", a): 1 for a in acts}, **{(a, "h"): 1 for a in acts}})
    began = time.perf_counter()
    got = alpha.loop_pairs(df, 1)
    assert time.perf_counter() - began < 1
    assert got == {(a, b) for a in [*acts] for b in [*acts, "h"] if a != b}  # never (h, a): all ways lead over h


def test_a_cut_between_both_halves():
    """Both ways need c: each could be gone, not both."""
    df = Counter({(a, b): 1 for a, b in ((START, "c"), ("c", "y"), ("y", "c"), ("c", "x"), ("x", "y"))})
    assert alpha.loop_pairs(df, 1) == by_enumeration(df, 1) and ("x", "y") not in alpha.loop_pairs(df, 1)


def by_steps(variant, a, b):
    fits, tokens = [True, True], 0
    for x in variant:
        if x in a and x in b:
            fits[1] &= tokens > 0
        else:
            tokens += (x in a) - (x in b)
            fits = [f and tokens >= 0 for f in fits]
    return fits[0] and not tokens, fits[0] and fits[1] and not tokens


def test_fitness_equals_replay_step_by_step(spark):
    r = random.Random(6)
    variants = [("".join(r.choice("abcd") for _ in range(r.randint(0, 7))), r.randint(1, 5)) for _ in range(60)]
    sets = lambda: frozenset(r.sample("abcde", r.randint(1, 3)))
    listed = [(sets(), sets()) for _ in range(40)]
    got = alpha.fitness(spark.createDataFrame([(list(v), n) for v, n in variants], "variant array<string>, freq long"), listed)
    for a, b in listed:
        own = [(v, n, by_steps(v, a, b)) for v, n in variants if set(v) & (a | b)]
        total = sum(n for _, n, _ in own)
        share = lambda rows: sum(n for _, n, f in rows if f[0]) / sum(n for _, n, _ in rows)
        least = min(share(rows) for x in a | b if (rows := [o for o in own if x in o[0]]))
        assert got[a, b] == (share(own), least, sum(n for _, n, f in own if f[1]) / total)
    assert alpha.fitness(spark.createDataFrame([], "variant array<string>, freq long"), listed[:1]) == {listed[0]: (0.0, 0.0, 0.0)}


def test_shuffled_pairs():
    from eventloom.models.trees import shuffle_pairs

    assert shuffle_pairs([{"a", "b"}, {"c"}, set()]) == {("a", "c"), ("b", "c"), ("c", "a"), ("c", "b")}
    assert shuffle_pairs([{"a", "b"}, {"b"}]) == {("a", "b"), ("b", "a"), ("b", "b")} and shuffle_pairs([{"a"}]) == set()
