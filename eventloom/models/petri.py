"""Petri nets: small models that live on the driver."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field


@dataclass
class Transition:
    """A transition; without a label it is silent."""

    id: str
    label: str | None


@dataclass
class PetriNet:
    """Places, transitions, weighted arcs (source, target, weight) and markings (place -> tokens)."""

    places: set[str] = field(default_factory=set)
    transitions: dict[str, Transition] = field(default_factory=dict)
    arcs: list[tuple[str, str, int]] = field(default_factory=list)
    initial_marking: dict[str, int] | None = None
    final_markings: list[dict[str, int]] = field(default_factory=list)

    def add_place(self, place: str | None = None) -> str:
        place = place or str(uuid.uuid4())
        self.places.add(place)
        return place

    def add_transition(self, label: str | None, ident: str | None = None) -> str:
        ident = ident or str(uuid.uuid4())
        self.transitions[ident] = Transition(ident, label)
        return ident

    def add_arc(self, source: str, target: str, weight: int = 1) -> None:
        if (source in self.places) == (target in self.places) or not {source, target} <= self.places | set(self.transitions):
            raise ValueError(f"no arc between {source} and {target}")
        self.arcs.append((source, target, weight))

    def remove_node(self, node: str) -> None:
        """Remove a place or transition with its arcs and tokens."""
        self.places.discard(node)
        self.transitions.pop(node, None)
        self.arcs = [a for a in self.arcs if node not in a[:2]]
        for marking in [self.initial_marking or {}, *self.final_markings]:
            marking.pop(node, None)

    def remove_arc(self, source: str, target: str) -> None:
        self.arcs = [a for a in self.arcs if a[:2] != (source, target)]

    def preset(self, node: str) -> list[str]:
        return [a for a, b, _ in self.arcs if b == node]

    def postset(self, node: str) -> list[str]:
        return [b for a, b, _ in self.arcs if a == node]

    def initial_places(self) -> set[str]:
        return {p for p, n in (self.initial_marking or {}).items() if n}

    def incidence(self) -> tuple[list[str], list[str], list[list[int]], list[list[int]]]:
        """places, transitions, tokens taken and tokens put (places by transitions; an arc counts 1)."""
        places, trans = sorted(self.places), sorted(self.transitions)
        take = [[0] * len(trans) for _ in places]
        put = [[0] * len(trans) for _ in places]
        for a, b, _ in self.arcs:
            if a in self.places:
                take[places.index(a)][trans.index(b)] += 1
            else:
                put[places.index(b)][trans.index(a)] += 1
        return places, trans, take, put

    def signature(self) -> tuple:
        """A value that is equal for nets that differ in place ids alone (labels being unique)."""
        name = lambda t: self.transitions[t].label or f"silent:{t}"
        held = self.initial_marking or {}
        return tuple(sorted((tuple(sorted(map(name, self.preset(p)))), tuple(sorted(map(name, self.postset(p)))), held.get(p, 0), tuple(m.get(p, 0) for m in self.final_markings)) for p in self.places))

    def to_json(self) -> str:
        arcs = [{"from_to": {"type": "PlaceTransition" if a in self.places else "TransitionPlace", "nodes": [a, b]}, "weight": w} for a, b, w in self.arcs]
        return json.dumps(
            {
                "places": {p: {"id": p} for p in sorted(self.places)},
                "transitions": {i: {"label": t.label, "id": i} for i, t in sorted(self.transitions.items())},
                "arcs": arcs,
                "initial_marking": self.initial_marking,
                "final_markings": self.final_markings or None,
            }
        )

    @classmethod
    def from_json(cls, text: str) -> PetriNet:
        d = json.loads(text)
        net = cls(set(d["places"]), {i: Transition(i, t.get("label")) for i, t in d["transitions"].items()})
        for a in d["arcs"]:
            net.add_arc(*a["from_to"]["nodes"], a.get("weight", 1))
        net.initial_marking, net.final_markings = d.get("initial_marking"), d.get("final_markings") or []
        return net

    def to_dot(self) -> str:
        """Graphviz source."""
        out = ["digraph {", "  rankdir=LR;"]
        for p in sorted(self.places):
            n = (self.initial_marking or {}).get(p, 0)
            out.append(f'  "{p}" [shape=circle, label="{n or ""}"];')
        for i, t in sorted(self.transitions.items()):
            out.append(f'  "{i}" [shape=box, label={json.dumps(t.label or "")}{"" if t.label else ", style=filled, fillcolor=black"}];')
        out += [f'  "{a}" -> "{b}"' + (f' [label="{w}"]' if w != 1 else "") + ";" for a, b, w in self.arcs]
        return "\n".join([*out, "}"])
