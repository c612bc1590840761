"""Partially ordered traces: events and the relation between them, and a form that equal ones share.

The canonical form makes equal traces equal texts, so Spark groups them by key.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class PartialTrace:
    """Events by id with their attributes, and relations (before, after)."""

    events: dict[str, dict] = field(default_factory=dict)
    relations: set[tuple[str, str]] = field(default_factory=set)

    def add_event(self, ident: str, attributes: dict) -> None:
        self.events[ident] = attributes

    def remove_event(self, ident: str) -> None:
        self.events.pop(ident, None)
        self.relations = {r for r in self.relations if ident not in r}

    def add_relation(self, before: str, after: str) -> None:
        if before not in self.events or after not in self.events:
            raise KeyError((before, after))
        self.relations.add((before, after))

    def remove_relation(self, before: str, after: str) -> None:
        self.relations.discard((before, after))

    def start_events(self) -> set[str]:
        return set(self.events) - {b for _, b in self.relations}

    def end_events(self) -> set[str]:
        return set(self.events) - {a for a, _ in self.relations}

    def ingoing(self, ident: str) -> set[str]:
        return {a for a, b in self.relations if b == ident}

    def outgoing(self, ident: str) -> set[str]:
        return {b for a, b in self.relations if a == ident}

    def label(self, ident: str) -> str:
        return str(self.events[ident].get("concept:name", ""))

    def canonical(self) -> str:
        """A text that two traces share if, and only if, activities and relations are the same up to event ids."""
        place = {e: i for i, e in enumerate(self.events)}
        return canonical_form([self.label(e) for e in self.events], [(place[a], place[b]) for a, b in self.relations])

    def is_isomorphic(self, other: PartialTrace) -> bool:
        """Whether activities and relations are the same up to event ids."""
        return len(self.events) == len(other.events) and len(self.relations) == len(other.relations) and self.canonical() == other.canonical()

    def to_json(self) -> str:
        return json.dumps({"event_map": self.events, "partial_relations": sorted(self.relations)})

    @classmethod
    def from_json(cls, text: str) -> PartialTrace:
        d = json.loads(text)
        return cls(d["event_map"], {tuple(r) for r in d["partial_relations"]})

    def to_dot(self) -> str:
        """Graphviz source."""
        out = ["digraph {", *(f'  "{e}" [shape=box, label={json.dumps(self.label(e))}];' for e in sorted(self.events))]
        return "\n".join([*out, *(f'  "{a}" -> "{b}";' for a, b in sorted(self.relations)), "}"])


class _Canon:
    """The least form of a labelled graph over all orders that refinement allows.

    Colours are refined by those of the neighbours until they are stable; where events
    still look alike one of them is singled out, and each is tried but for those that
    an automorphism found before maps to one that was tried.
    """

    def __init__(self, labels: list[str], edges: list[tuple[int, int]]):
        self.labels, self.edges, n = labels, sorted(set(edges)), len(labels)
        self.before: list[list[int]] = [[] for _ in range(n)]
        self.after: list[list[int]] = [[] for _ in range(n)]
        for a, b in self.edges:
            self.after[a].append(b)
            self.before[b].append(a)
        self.first: tuple | None = None  # form, order and path of the first leaf, and of the best
        self.best: tuple | None = None
        self.same: list[list[int]] = []  # automorphisms

    def refined(self, colours: list[int]) -> list[int]:
        while True:
            looks = [(colours[v], sorted(colours[x] for x in self.before[v]), sorted(colours[x] for x in self.after[v])) for v in range(len(colours))]
            rank = {k: i for i, k in enumerate(sorted({(c, *map(tuple, (p, q))) for c, p, q in looks}))}
            new = [rank[c, tuple(p), tuple(q)] for c, p, q in looks]
            if len(rank) == len(set(colours)):
                return new
            colours = new

    def search(self, colours: list[int], path: list[int]) -> int:
        """Look at all orders below a path; returns how much of the path still has others to try."""
        colours = self.refined(colours)
        cells: dict[int, list[int]] = {}
        for v, c in enumerate(colours):
            cells.setdefault(c, []).append(v)
        several = [(len(vs), c) for c, vs in cells.items() if len(vs) > 1]
        if not several:
            return self.leaf(colours, path)
        tried: list[int] = []
        for v in cells[min(several)[1]]:
            if v in self.reached(tried, path):
                continue
            back = self.search([2 * c + (u != v) for u, c in enumerate(colours)], [*path, v])
            if back < len(path):
                return back
            tried.append(v)
        return len(path)

    def leaf(self, colours: list[int], path: list[int]) -> int:
        order = sorted(range(len(colours)), key=colours.__getitem__)
        at = {v: i for i, v in enumerate(order)}
        form = sorted((at[a], at[b]) for a, b in self.edges)
        for known in (self.first, self.best):
            if known and known[0] == form:
                mapped = [0] * len(order)
                for a, b in zip(known[1], order):
                    mapped[a] = b
                self.same.append(mapped)
                return next((i for i, (a, b) in enumerate(zip(known[2], path)) if a != b), len(path))
        self.first = self.first or (form, order, path)
        if self.best is None or form < self.best[0]:
            self.best = (form, order, path)
        return len(path)

    def reached(self, tried: list[int], path: list[int]) -> set[int]:
        """What automorphisms that keep the path map the tried events to."""
        keep = [m for m in self.same if all(m[v] == v for v in path)]
        seen, todo = set(tried), list(tried)
        while todo:
            v = todo.pop()
            for m in keep:
                if m[v] not in seen:
                    seen.add(m[v])
                    todo.append(m[v])
        return seen


def canonical_form(labels: list[str], edges: list[tuple[int, int]]) -> str:
    """JSON of labels and relations (places of labels) in an order that doesn't depend on the given one."""
    canon = _Canon(labels, edges)
    names = {x: i for i, x in enumerate(sorted(set(labels)))}
    if labels:
        canon.search([names[x] for x in labels], [])
        form, order, _ = canon.best
    else:
        form, order = [], []
    return json.dumps([[labels[v] for v in order], form])


def partial_variants(events: DataFrame, relations: DataFrame) -> DataFrame:
    """Partially ordered variants: variant (canonical text), n_events, freq.

    ``events`` has case_id, event_id and activity, ``relations`` case_id, before and
    after (event ids; those of unknown events don't count).  A case and its
    relations meet in one row; cases are grouped by their canonical texts.
    """
    own = events.groupBy("case_id").agg(F.collect_list(F.struct("event_id", "activity")).alias("events"))
    rel = relations.groupBy("case_id").agg(F.collect_set(F.struct("before", "after")).alias("relations"))

    def told(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            out = []
            for listed, pairs in zip(*(c.to_pylist() for c in batch.columns)):
                place = {x["event_id"]: i for i, x in enumerate(listed)}
                edges = [(place[r["before"]], place[r["after"]]) for r in pairs or () if r["before"] in place and r["after"] in place]
                out.append((canonical_form([x["activity"] or "" for x in listed], edges), len(listed)))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.string()), pa.array([n for _, n in out], pa.int64())], names=["variant", "n_events"])

    rows = own.join(rel, "case_id", "left").select("events", "relations").mapInArrow(told, "variant string, n_events long")
    return rows.groupBy("variant", "n_events").agg(F.count("*").alias("freq"))
