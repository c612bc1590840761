"""Process trees, case-centric and object-centric, and the language of the latter."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field
from itertools import product

from eventloom.models.petri import PetriNet

OPERATORS = ("sequence", "exclusive", "concurrency", "loop")


@dataclass
class Tree:
    """A node: an operator with children, or a leaf (operator None) with a label (None: silent)."""

    operator: str | None = None
    children: list[Tree] = field(default_factory=list)
    label: str | None = None

    def is_valid(self) -> bool:
        """Operators have children (a loop two at least) that are valid; leaves have none."""
        if self.operator is None:
            return not self.children
        least = 2 if self.operator == "loop" else 1
        return self.operator in OPERATORS and len(self.children) >= least and all(c.is_valid() for c in self.children)

    def leaves(self) -> list[Tree]:
        """All leaves from left to right."""
        return [self] if self.operator is None else [x for c in self.children for x in c.leaves()]

    def to_petri_net(self) -> PetriNet:
        """A workflow net of the same language."""
        if not self.is_valid():
            raise ValueError("the tree isn't valid")
        net = PetriNet()
        start, end = net.add_place("start"), net.add_place("end")
        n = [0]

        def place() -> str:
            n[0] += 1
            return net.add_place(f"p{n[0]}")

        def step(label: str | None, a: str, b: str) -> None:
            n[0] += 1
            t = net.add_transition(label, f"t{n[0]}")
            net.add_arc(a, t)
            net.add_arc(t, b)

        def build(node: Tree, a: str, b: str) -> None:
            if node.operator is None:
                step(node.label, a, b)
            elif node.operator == "sequence":
                at = a
                for i, c in enumerate(node.children):
                    to = b if i == len(node.children) - 1 else place()
                    build(c, at, to)
                    at = to
            elif node.operator == "exclusive":
                for c in node.children:
                    build(c, a, b)
            elif node.operator == "concurrency":
                n[0] += 2
                fork, join = net.add_transition(None, f"t{n[0] - 1}"), net.add_transition(None, f"t{n[0]}")
                net.add_arc(a, fork)
                net.add_arc(join, b)
                for c in node.children:
                    x, y = place(), place()
                    net.add_arc(fork, x)
                    net.add_arc(y, join)
                    build(c, x, y)
            else:  # loop: the first child, then any number of times a later one and the first again
                x, y = place(), place()
                step(None, a, x)
                step(None, y, b)
                build(node.children[0], x, y)
                for c in node.children[1:]:
                    build(c, y, x)

        build(self, start, end)
        net.initial_marking, net.final_markings = {start: 1}, [{end: 1}]
        return net

    def to_dot(self) -> str:
        """Graphviz source."""
        out, signs = ["digraph {"], {"sequence": "→", "exclusive": "×", "concurrency": "∧", "loop": "↻"}

        def walk(node: Tree, name: str) -> None:
            out.append(f'  {name} [label="{signs.get(node.operator or "", node.label or "τ")}"];')
            for i, c in enumerate(node.children):
                out.append(f"  {name} -> {name}_{i};")
                walk(c, f"{name}_{i}")

        walk(self, "n")
        return "\n".join([*out, "}"])


def leaf(label: str | None) -> Tree:
    """A leaf."""
    return Tree(label=label)


def node(operator: str, *children: Tree) -> Tree:
    """An operator node."""
    return Tree(operator, list(children))


@dataclass
class OcTree(Tree):
    """An object-centric process tree: leaves carry their related, divergent, convergent, deficient and optional object types."""

    related: frozenset[str] = frozenset()
    divergent: frozenset[str] = frozenset()
    convergent: frozenset[str] = frozenset()
    deficient: frozenset[str] = frozenset()
    optional: frozenset[str] = frozenset()

    def is_valid(self) -> bool:
        """Valid as a tree, and side sets are within the related types."""
        own = all(s <= self.related for s in (self.divergent, self.convergent, self.deficient, self.optional))
        return super().is_valid() and (self.operator is not None or own)

    def object_types(self) -> frozenset[str]:
        """Types that any leaf is related to."""
        return frozenset().union(*(x.related for x in self.leaves()))  # type: ignore[attr-defined]


@dataclass(frozen=True)
class Language:
    """First and last activities, directly-follows pairs, and whether the empty sequence is in."""

    start: frozenset[str]
    end: frozenset[str]
    pairs: frozenset[tuple[str, str]]
    empty: bool


def shuffle_pairs(alphabets: list[set[str]]) -> set[tuple[str, str]]:
    """Directly-follows pairs between different alphabets whose sequences are shuffled: each activity of one with each of another."""
    often = Counter(x for a in alphabets for x in a)
    every = set(often)
    # an activity of the same alphabet counts only if another alphabet has it, too
    return {(x, y) for a in alphabets for x in a for y in every if often[y] > (y in a)}


def language(tree: OcTree, kind: str) -> Language:
    """Directly-follows language of the sequences that objects of a type can see."""
    none: frozenset = frozenset()
    if tree.operator is None:
        if tree.label is None or kind not in tree.related:
            return Language(none, none, none, True)
        me = frozenset([tree.label])
        repeats = frozenset([(tree.label, tree.label)]) if kind in tree.divergent else none
        return Language(me, me, repeats, kind in tree.optional)
    parts = [language(c, kind) for c in tree.children]  # type: ignore[arg-type]
    pairs = set().union(*(p.pairs for p in parts))
    if tree.operator == "sequence":
        start, end = set(), set()
        for p in parts:
            start |= p.start
            if not p.empty:
                break
        for p in reversed(parts):
            end |= p.end
            if not p.empty:
                break
        for i, p in enumerate(parts):
            for q in parts[i + 1 :]:
                pairs |= set(product(p.end, q.start))
                if not q.empty:
                    break
        return Language(frozenset(start), frozenset(end), frozenset(pairs), all(p.empty for p in parts))
    start, end = frozenset().union(*(p.start for p in parts)), frozenset().union(*(p.end for p in parts))
    if tree.operator == "exclusive":
        return Language(start, end, frozenset(pairs), any(p.empty for p in parts))
    if tree.operator == "concurrency":
        pairs |= shuffle_pairs([{x for pair in p.pairs for x in pair} | p.start | p.end for p in parts])
        return Language(start, end, frozenset(pairs), all(p.empty for p in parts))
    do, redo = parts[0], parts[1:]
    back_start, back_end = frozenset().union(*(p.start for p in redo)), frozenset().union(*(p.end for p in redo))
    pairs |= set(product(do.end, back_start)) | set(product(back_end, do.start))
    if any(p.empty for p in redo):
        pairs |= set(product(do.end, do.start))
    if do.empty:
        pairs |= set(product(back_end, back_start))
    start = do.start | (back_start if do.empty else none)
    end = do.end | (back_end if do.empty else none)
    return Language(frozenset(start), frozenset(end), frozenset(pairs), do.empty)


def abstraction_of(tree: OcTree) -> set[tuple[str, str, str, str | None]]:
    """The tree's abstraction as rows (property, object_type, ev_a, ev_b), as ``objectcentric.abstraction`` gives for a log."""
    out: set[tuple[str, str, str, str | None]] = set()
    optional: dict[tuple[str, str], bool] = {}

    def walk(n, skip: frozenset[str]) -> None:
        if n.operator is None:
            if n.label is not None:
                for k in n.related:
                    optional[k, n.label] = optional.get((k, n.label), True) and (k in n.optional or k in skip)
                for name in ("related", "divergent", "convergent", "deficient"):
                    out.update((name, k, n.label, None) for k in getattr(n, name))
            return
        for i, c in enumerate(n.children):
            alone = n.operator == "exclusive" and len(n.children) > 1 or n.operator == "loop" and i > 0
            walk(c, tree.object_types() if alone else skip)

    walk(tree, frozenset())
    out |= {("optional", k, a, None) for (k, a), yes in optional.items() if yes}
    for k in tree.object_types():
        l = language(tree, k)  # noqa: E741
        out |= {("start", k, a, None) for a in l.start} | {("end", k, a, None) for a in l.end} | {("df", k, a, b) for a, b in l.pairs}
    return out


#: Properties of single event types that ``fitness_precision`` compares.
PATTERNS = ("start", "end", "related", "divergent", "convergent", "deficient", "optional")


def fitness_precision(log: set[tuple], model: set[tuple]) -> tuple[float, float]:
    """Fitness and precision of a model's abstraction against a log's, over event types in a directly-follows pair of the log.

    Per event type and property, and per pair of event types, the share of the
    object types of one side that the other has too; where a side has none the share
    doesn't count.  Shares are averaged over an event type's properties, then over
    event types, and over pairs; the result is the mean of both averages (0 where
    there is nothing to average).
    """
    acts = {x for p, _, a, b in log if p == "df" for x in (a, b)}
    kinds = [{}, {}]  # of the log and the model: (property, ev_a, ev_b) -> object types
    for side, rows in zip(kinds, (log, model)):
        for p, k, a, b in rows:
            if a in acts and (p in PATTERNS or p == "df" and b in acts):
                side.setdefault((p, a, b), set()).add(k)
    mean = lambda xs: sum(xs) / len(xs) if xs else 0.0

    def against(side: dict, other: dict) -> float:
        share = {key: len(own & other.get(key, set())) / len(own) for key, own in side.items()}
        by_type = [[share[p, a, None] for p in PATTERNS if (p, a, None) in share] for a in acts]
        return (mean([mean(x) for x in by_type if x]) + mean([v for (p, _, _), v in share.items() if p == "df"])) / 2

    return against(*kinds), against(*reversed(kinds))
