"""Petri nets as PNML files."""

from __future__ import annotations

import uuid
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

from eventloom.models.petri import PetriNet

#: Label that marks a silent transition in files.
SILENT = "$invisible$"


def _name(e) -> str:
    return e.tag.rsplit("}", 1)[-1]


def _text(e, path: str) -> str | None:
    for step in path.split("/"):
        e = next((c for c in e if _name(c) == step), None)
        if e is None:
            return None
    return e.text


def read_pnml(source) -> PetriNet:
    """A net from a path, file or bytes; nodes get new ids, arcs between unlike nodes alone are kept."""
    root = ElementTree.fromstring(source) if isinstance(source, bytes) else ElementTree.parse(source).getroot()
    net, ids, initial = PetriNet(), {}, {}
    for e in root.iter():
        if _name(e) == "place" and e.get("id") and not e.get("idref"):
            ids[e.get("id")] = p = net.add_place(str(uuid.uuid4()))
            if (n := _text(e, "initialMarking/text")) and int(n):
                initial[p] = int(n)
        elif _name(e) == "transition" and e.get("id"):
            tool = any(_name(c) == "toolspecific" and c.get("activity") == SILENT for c in e)
            label = _text(e, "name/text")
            ids[e.get("id")] = net.add_transition(None if tool or label == SILENT else label)
    for e in root.iter():
        if _name(e) == "arc":
            a, b = ids.get(e.get("source")), ids.get(e.get("target"))
            if a and b and (a in net.places) != (b in net.places):
                net.add_arc(a, b, int(_text(e, "inscription/text") or 1))
    net.initial_marking = initial or None
    for m in (x for x in root.iter() if _name(x) == "marking"):
        held = {ids[p.get("idref")]: int(_text(p, "text") or 0) for p in m if _name(p) == "place" and p.get("idref") in ids}
        if held := {p: n for p, n in held.items() if n}:
            net.final_markings.append(held)
    return net


def pnml(net: PetriNet) -> str:
    """A net as PNML text."""
    out = ['<?xml version="1.0" encoding="UTF-8"?>', '<pnml><net id="net1" type="http://www.pnml.org/version-2009/grammar/pnmlcoremodel"><page id="n0">']
    for p in sorted(net.places):
        n = (net.initial_marking or {}).get(p, 0)
        mark = f"<initialMarking><text>{n}</text></initialMarking>" if n else ""
        out.append(f"<place id={quoteattr(p)}><name><text>{escape(p)}</text></name>{mark}</place>")
    for i, t in sorted(net.transitions.items()):
        tool = f'<toolspecific tool="ProM" version="6.4" activity="{SILENT}" localNodeID={quoteattr(i)}/>' if t.label is None else ""
        out.append(f"<transition id={quoteattr(i)}><name><text>{escape(t.label or SILENT)}</text></name>{tool}</transition>")
    for n, (a, b, w) in enumerate(net.arcs):
        out.append(f'<arc id="arc{n}" source={quoteattr(a)} target={quoteattr(b)}><inscription><text>{w}</text></inscription></arc>')
    out.append("</page><finalmarkings>")
    for m in net.final_markings:
        out.append("<marking>" + "".join(f"<place idref={quoteattr(p)}><text>{n}</text></place>" for p, n in sorted(m.items())) + "</marking>")
    return "\n".join([*out, "</finalmarkings></net></pnml>"])


def write_pnml(net: PetriNet, path: str) -> None:
    """Write a net to a file."""
    with open(path, "w", encoding="utf-8") as f:
        f.write(pnml(net))
