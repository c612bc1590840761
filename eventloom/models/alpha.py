"""Petri-net discovery from variants by place candidates (an extended alpha algorithm).

Spark holds the variants: relations, counts and the fitness of candidates are
aggregates over them, and repairs rewrite them in place.  The driver sees what the
alphabet bounds: relations, candidates and the net.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.models.petri import PetriNet
from eventloom.operators.casecentric import END, START

SILENT = "__SILENT__"
Relation = tuple[str, str]
Candidate = tuple[frozenset[str], frozenset[str]]


@dataclass(frozen=True)
class Config:
    """Thresholds of the steps."""

    balance: float = 0.2
    fitness: float = 0.75
    replay: float = 0.0
    skip: float = 2.0
    loop: float = 2.0
    absolute: int = 10
    relative: float = 0.1


# fixed values: the configurations that ``discover_best`` tries, in this order
# balance, fitness, replay, skip, loop, absolute, relative
AUTO = (
    Config(0.6, 0.4, 0.0, 4.0, 4.0, 1, 0.01),
    Config(0.6, 0.4, 0.0, 2.0, 2.0, 1, 0.01),
    Config(0.4, 0.6, 0.0, 4.0, 4.0, 1, 0.01),
    Config(0.4, 0.6, 0.0, 2.0, 2.0, 1, 0.01),
    Config(0.4, 0.6, 0.0, 2.0, 2.0, 5, 0.05),
    Config(0.1, 0.8, 0.0, 2.0, 2.0, 5, 0.05),
    Config(0.25, 0.75, 0.0, 2.0, 2.0, 25, 0.1),
    Config(0.1, 0.8, 0.0, 4.0, 4.0, 1, 0.01),
    Config(0.1, 0.8, 0.0, 2.0, 2.0, 1, 0.01),
    Config(0.1, 0.9, 0.0, 4.0, 4.0, 1, 0.01),
    Config(0.1, 0.9, 0.0, 2.0, 2.0, 1, 0.01),
)


# -- over variants (Spark) ---------------------------------------------------------------


def bordered(found: DataFrame) -> DataFrame:
    """Variants (variant, freq) between a start and an end activity."""
    return found.select(F.concat(F.array(F.lit(START)), "variant", F.array(F.lit(END))).alias("variant"), F.col("freq").cast("long").alias("freq"))


def relations(found: DataFrame) -> Counter:
    """Directly-follows pairs of variants by frequency; a row for each pair of the alphabet comes back."""
    steps = found.select("freq", F.explode(F.arrays_zip(F.expr("slice(variant, 1, size(variant) - 1)").alias("a"), F.expr("slice(variant, 2, size(variant) - 1)").alias("b"))).alias("p"))
    return Counter({(r.a, r.b): r.n for r in steps.groupBy("p.a", "p.b").agg(F.sum("freq").alias("n")).collect()})


def inserted(found: DataFrame, names: dict[Relation, str]) -> DataFrame:
    """Variants with a silent activity between the two of every named pair."""
    if not names:
        return found
    known = F.create_map(*[F.lit(x) for (a, b), name in sorted(names.items()) for x in (f"{a}\x00{b}", name)])
    grown = F.transform("variant", lambda x, i: F.array_compact(F.array(F.when(i > 0, known[F.concat(F.get("variant", i - 1), F.lit("\x00"), x)]), x)))
    return found.select(F.flatten(grown).alias("variant"), "freq")


def fitness(found: DataFrame, candidates: Iterable[Candidate]) -> dict[Candidate, tuple[float, float, float]]:
    """For each candidate: the share of cases that a place there fits, the least such share over its activities, and the strict share.

    Cases without any of its activities don't count.  Strictly, an activity on both
    sides needs a token to be there.
    """
    listed = sorted(set(candidates), key=lambda c: (sorted(c[0]), sorted(c[1])))
    if not listed:
        return {}

    acts = sorted({x for a, b in listed for x in a | b})
    number = {x: i for i, x in enumerate(acts)}
    sides = [([number[x] for x in a], [number[x] for x in b]) for a, b in listed]

    def tallied(batches: Iterator) -> Iterator:
        import pyarrow as pa

        # of each candidate: cases and fitting cases by activity, the last column is the case itself; and strictly fitting cases
        every, fit, strictly = (np.zeros((len(listed), len(acts) + 1), np.int64) for _ in range(3))
        for batch in batches:
            variants = batch.column(0)
            sizes, freq = pc.fill_null(pc.list_value_length(variants), 0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy()
            codes = pc.index_in(variants.flatten(), pa.array(acts, pa.string())).fill_null(len(acts)).to_numpy(zero_copy_only=False).astype(np.int64)
            cases = np.repeat(np.arange(len(sizes)), sizes)
            has = np.zeros((len(sizes), len(acts) + 1), bool)
            has[cases, codes] = True
            for i, (a, b) in enumerate(sides):
                fits, strict = replayed(codes, cases, len(sizes), len(acts) + 1, a, b)
                own = sorted({*a, *b})
                touched = has[:, own].any(axis=1)
                columns, weight = [*own, len(acts)], np.column_stack((has[:, own], touched)) * freq[:, None]
                every[i, columns] += weight.sum(axis=0)
                fit[i, columns] += weight[fits].sum(axis=0)
                strictly[i, -1] += freq[strict & touched].sum()
        out = [(i, acts[x] if x < len(acts) else "", what, int(table[i, x])) for what, table in (("all", every), ("fit", fit), ("strict", strictly)) for i, x in zip(*np.nonzero(table))]
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], t) for j, t in enumerate((pa.int32(), pa.string(), pa.string(), pa.int64()))], names=["i", "act", "what", "n"])

    rows = found.select("variant", "freq").mapInArrow(tallied, "i int, act string, what string, n long")
    got = {(r.i, r.act, r.what): r.n for r in rows.groupBy("i", "act", "what").agg(F.sum("n").alias("n")).collect()}  # candidates by activities
    out = {}
    for i, c in enumerate(listed):
        total = got.get((i, "", "all"), 0)
        least = min((got.get((i, x, "fit"), 0) / got[i, x, "all"] for x in c[0] | c[1] if got.get((i, x, "all"))), default=0.0)
        out[c] = (got.get((i, "", "fit"), 0) / total, least, got.get((i, "", "strict"), 0) / total) if total else (0.0, 0.0, 0.0)
    return out


def replayed(codes: np.ndarray, cases: np.ndarray, n: int, n_codes: int, a: list[int], b: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Whether a place from ``a`` to ``b`` fits each of ``n`` cases: no token is missing, none is left; and whether it does so strictly.

    ``codes`` are the cases' activities one case after the other, ``cases`` whose they are.
    """
    change = np.zeros(n_codes, np.int64)
    np.add.at(change, a, 1)
    np.add.at(change, b, -1)
    steps = change[codes]
    upto = np.cumsum(steps)
    starts = np.searchsorted(cases, np.arange(n))
    before = np.concatenate(([0], upto))[starts]
    tokens = upto - before[cases]
    bad = tokens < 0
    left = np.bincount(cases, weights=steps, minlength=n) != 0
    fits = ~left & (np.bincount(cases[bad], minlength=n) == 0)
    both = np.zeros(n_codes, bool)
    both[list(set(a) & set(b))] = True
    bare = both[codes] & (tokens < 1)
    return fits, fits & (np.bincount(cases[bare], minlength=n) == 0)


# -- over the alphabet -------------------------------------------------------------------


def filtered(df: Counter, absolute: int, relative: float) -> set[Relation]:
    """Pairs frequent enough, absolutely and against the mean of one of their ends."""
    out, into = {}, {}
    for (a, b), n in df.items():
        out.setdefault(a, []).append(n)
        into.setdefault(b, []).append(n)
    mean = lambda xs: sum(xs) / len(xs)
    return {(a, b) for (a, b), n in df.items() if n >= absolute and (n >= relative * mean(out[a]) or n >= relative * mean(into[b]))}


def loop_pairs(df: Counter, least: int) -> set[Relation]:
    """Frequent pairs (x, y), x other than y, that close a loop: a simple frequent path from the start goes over y to x.

    Sets of activities are bits of integers.  A pair goes at once if all ways to y
    lead over x, or y doesn't lead to x; for most others the shortest ways do.
    """
    acts = sorted({x for p, n in df.items() if n >= least for x in p})
    bit = {x: 1 << i for i, x in enumerate(acts)}
    after = [0] * len(acts)
    for (a, b), n in df.items():
        if n >= least:
            after[bit[a].bit_length() - 1] |= bit[b]
    if START not in bit:
        return set()
    pairs = ((a, b) for (a, b), n in df.items() if n >= least and a != b)
    return {(x, y) for x, y in pairs if x != START and y != START and leads_over(after, bit[START], bit[y], bit[x])}


def _spread(after: list[int], start: int, blocked: int) -> int:
    """What can be reached from ``start`` without stepping on ``blocked``; ``start`` itself only if it comes again."""
    seen, new = 0, start
    while new:
        step = 0
        while new:
            low = new & -new
            new ^= low
            step |= after[low.bit_length() - 1]
        new = step & ~seen & ~blocked
        seen |= new
    return seen


def _nearest_first(after: list[int], goal: int, blocked: int) -> dict[int, int]:
    """Steps from each activity to ``goal`` that avoid ``blocked``, by breadth-first search against the arrows."""
    far, level, n = {goal: 0}, goal, 0
    while level:
        n += 1
        found = 0
        for i, out in enumerate(after):
            one = 1 << i
            if out & level and one not in far and not one & blocked:
                far[one] = n
                found |= one
        level = found
    return far


def leads_over(after: list[int], start: int, middle: int, end: int) -> bool:
    """Whether a simple path leads from ``start`` over ``middle`` to ``end``.

    A depth-first search for the way to ``middle``, nearest steps first; a step is
    taken only if it still leads to ``middle``, and ``middle`` to ``end``, beside the path.
    """
    if not _spread(after, start, end) & middle or not _spread(after, middle, start) & end:
        return False
    far = _nearest_first(after, middle, end)
    dead: set[tuple[int, int, int]] = set()  # places that failed, and what both ways could still step on
    stack = [(start, start)]
    while stack:
        at, path = stack.pop()
        if at == middle:
            return True  # what was asked before the step
        # of the path only what it takes from either way matters
        state = (at, _spread(after, at, path | end), _spread(after, middle, path))
        if state in dead:
            continue
        dead.add(state)
        steps = []
        for one in (1 << i for i in range(len(after)) if after[at.bit_length() - 1] >> i & 1):
            if one & (path | end) or one not in far:
                continue
            if (one == middle or _spread(after, one, path | one | end) & middle) and _spread(after, middle, path | one) & end:
                steps.append(one)
        stack += [(one, path | one) for one in sorted(steps, key=far.__getitem__, reverse=True)]
    return False


def skip_pairs(df: Counter, least: int) -> set[Relation]:
    """Pairs (a, c) of neighbours between which an activity may have been skipped.

    After an activity a that never follows itself, those activities can be skipped
    whose frequent successors all are frequent successors of a, unless they repeat
    or go back to a frequently; c is any successor of a that can't be skipped.
    """
    acts = {x for p in df for x in p}
    strong = {a: frozenset(b for b in acts if df[a, b] >= least) for a in acts}
    out = set()
    for a in acts - {START}:
        if strong[a] and not df[a, a]:
            near = {b for b in acts if df[a, b]}
            can = {b for b in near - {END} if df[b, b] < least and df[b, a] < least and strong[b] <= strong[a]}
            if can:
                out |= {(a, c) for c in near - can}
    return out


def candidates(df: set[Relation]) -> set[Candidate]:
    """Pairs (A, B) of activity sets between which a place may lie, by the directly-follows relation.

    Wanted are pairs in which (1) every activity of A is followed by every one of
    B, (2) none of A by one of A without B, (3) none of B without A by one of B,
    and (4) some activity of B without A isn't followed by some one of A without B.
    Pairs of single activities grow level by level: two pairs are joined where
    either A is followed by all of the other's B, and the join is wanted.
    """
    acts = sorted({x for p in df for x in p})
    bit = {x: 1 << i for i, x in enumerate(acts)}
    after = {bit[x]: 0 for x in acts}
    for x, y in df:
        after[bit[x]] |= bit[y]
    bits = lambda m: [1 << i for i in range(m.bit_length()) if m >> i & 1]
    full = (1 << len(acts)) - 1
    every = lambda m: reduce(lambda r, x: r & after[x], bits(m), full)  # noqa: E731  # what follows all of m
    some = lambda m: reduce(lambda r, x: r | after[x], bits(m), 0)  # noqa: E731  # what follows any of m

    def wanted(a: int, b: int) -> bool:
        only_a, only_b = a & ~b, b & ~a
        return not (b & ~every(a) or some(a) & only_a or some(only_b) & b) and bool(only_b) and bool(only_a & ~every(only_b))

    level = {(bit[x], bit[y]): every(bit[x]) for x, y in df}
    known, out = dict(level), {c for c in level if wanted(*c)}
    while level:
        grown = {}
        for (a, b), follow in level.items():
            for (c, d), other in known.items():
                if d & ~follow or b & ~other:
                    continue
                p = (a | c, b | d)
                if p not in known and p not in grown and p[0] != p[1] and p[0] & ~every(p[1]) and wanted(*p):
                    grown[p] = every(p[0])
        known |= grown
        out |= set(grown)
        level = grown
    names = lambda m: frozenset(x for x in acts if m & bit[x])
    return {(names(a), names(b)) for a, b in out}


def balance(c: Candidate, count: Counter) -> float:
    """Difference of the sets' frequencies as a share of the larger."""
    x, y = (sum(count[k] for k in s) for s in c)
    return abs(x - y) / max(x, y) if max(x, y) else 0.0


def net_of(places: Iterable[Candidate], acts: Iterable[str]) -> PetriNet:
    """The net with a place for each candidate and a transition for each activity; silent ones without places go."""
    net, initial, final = PetriNet(), {}, {}
    for x in sorted(acts):
        if x not in (START, END):
            net.add_transition(None if x.startswith(SILENT) else x, x)
    for n, (a, b) in enumerate(sorted(places, key=lambda c: (sorted(c[0]), sorted(c[1])))):
        p = net.add_place(f"p{n}")
        for x in sorted(a - {START}):
            net.add_arc(x, p)
        for x in sorted(b - {END}):
            net.add_arc(p, x)
        if START in a:
            initial[p] = 1
        if END in b:
            final[p] = 1
    for i, t in list(net.transitions.items()):
        if t.label is None and not net.preset(i) and not net.postset(i):
            net.remove_node(i)
    net.initial_marking, net.final_markings = initial, [final]
    return net


def discover_all(found: DataFrame, configs: Iterable[Config]) -> list[PetriNet]:
    """A net for each configuration; those of equal repairs share their aggregates."""
    configs, cases, nets = list(configs), bordered(found), {}
    first = relations(cases)
    mean = sum(first.values()) / len(first) if first else 0.0
    for loop, skip in dict.fromkeys((c.loop, c.skip) for c in configs):
        mine = [c for c in configs if (c.loop, c.skip) == (loop, skip)]
        looped = inserted(cases, {(a, b): f"{SILENT}loop_{a}_{b}" for a, b in loop_pairs(first, math.ceil(loop * mean))})
        rows = inserted(looped, {(a, b): f"{SILENT}skip_{a}" for a, b in skip_pairs(relations(looped), math.ceil(skip * mean))})
        df = relations(rows)
        count: Counter = Counter()
        for (a, b), n in df.items():
            count[a] += n  # every activity but the end is followed by one
            count[b] += n * (b == END)
        asked = {c: {x for x in candidates(filtered(df, c.absolute, c.relative)) if balance(x, count) <= c.balance} for c in mine}
        fit = fitness(rows, {x for xs in asked.values() for x in xs})
        for c, xs in asked.items():
            good = [x for x in xs if fit[x][0] >= c.fitness and fit[x][1] >= c.fitness]
            largest = [x for x in good if not any(x != y and x[0] <= y[0] and x[1] <= y[1] for y in good)]
            nets[c] = net_of([x for x in largest if fit[x][2] >= c.replay], count)
    return [nets[c] for c in configs]


def discover(found: DataFrame, config: Config = Config()) -> PetriNet:
    """A net from variants (variant, freq)."""
    return discover_all(found, [config])[0]


def score(net: PetriNet, config: Config) -> float:
    """What ``discover_best`` compares: strict thresholds, and few transitions that aren't well connected.

    A transition is if it has a label, and on either side a place that is marked at
    the start or the end or that a labelled transition shares.
    """
    marked = set(net.initial_marking or {}) | {p for m in net.final_markings or [] for p in m}
    named = {i for i, t in net.transitions.items() if t.label is not None}
    fed = {p for p in net.places if p in marked or named & set(net.preset(p))}
    used = {p for p in net.places if p in marked or named & set(net.postset(p))}
    well = {i for i in named if fed & set(net.preset(i)) and used & set(net.postset(i))}
    off = (len(net.transitions) - len(well)) / len(named) if named else 1.0
    return config.fitness * (1 - config.balance) * (1 - off) ** 2


def discover_best(found: DataFrame) -> tuple[PetriNet, Config]:
    """The net of greatest ``score`` of the configurations ``AUTO``, and its configuration; the first of several."""
    nets = discover_all(found, AUTO)
    best = max(range(len(AUTO)), key=lambda i: (score(nets[i], AUTO[i]), -i))
    return nets[best], AUTO[best]


def place_names(places: Iterable[Candidate]) -> list[tuple[list[str], list[str]]]:
    """Candidates as sorted lists of activity names, in order."""
    return sorted((sorted(a), sorted(b)) for a, b in places)
