"""Functions by name, with arguments given as text: the surface of the command line and of bindings."""

from __future__ import annotations

import inspect
import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from eventloom.model import EventLog, Ocel

FUNCTIONS: dict[str, Callable] = {}


def register(f: Callable) -> Callable:
    """Add a function under its own name; annotations say how its arguments are read."""
    FUNCTIONS[f.__name__] = f
    return f


def list_functions() -> list[dict]:
    """Name, documentation and arguments (a JSON schema) of every function."""
    names = {"int": "integer", "float": "number", "bool": "boolean", "str": "string"}
    out = []
    for name, f in sorted(FUNCTIONS.items()):
        params = {k: p for k, p in inspect.signature(f).parameters.items()}
        kind = lambda p: {"type": names[p.annotation]} if p.annotation in names else {"type": "string", "x-registry-ref": str(p.annotation)}
        out.append({"name": name, "doc": (f.__doc__ or "").strip().split("\n")[0], "args": {"type": "object", "properties": {k: kind(p) for k, p in params.items()}, "required": [k for k, p in params.items() if p.default is p.empty]}})
    return out


class Registry:
    """Logs and other values by id, loaded from files when first asked for."""

    def __init__(self, spark: SparkSession):
        self.spark, self.items = spark, {}

    def add(self, name: str, value: Any) -> str:
        self.items[name] = value
        return name

    def create_views(self, name: str, prefix: str | None = None) -> list[str]:
        """Temporary views for SQL of all functions that need nothing but the log ``name``: ``<prefix>_<function>``; the views' names.

        Views are lazy plans: only what a query asks for is computed.
        """
        value, out = self.items[name], []
        for function, f in sorted(FUNCTIONS.items()):
            wanted = [p for p in inspect.signature(f).parameters.values() if p.default is p.empty]
            if len(wanted) == 1 and wanted[0].annotation == type(value).__name__ and inspect.signature(f).return_annotation == "DataFrame":
                out.append(f"{prefix or name}_{function}")
                f(value).createOrReplaceTempView(out[-1])
        for part in ("events", "cases", "objects", "e2o", "o2o"):
            if isinstance(frame := getattr(value, part, None), DataFrame):
                out.append(f"{prefix or name}_{part}")
                frame.createOrReplaceTempView(out[-1])
        return out

    def load(self, path: str, kind: str) -> Any:
        """A log of a kind from a file."""
        if kind == "Ocel":
            from eventloom.sources.ocel import read_ocel

            return read_ocel(self.spark, path)
        if kind == "EventLog":
            return read_log(self.spark, path)
        if kind == "PetriNet":
            from eventloom.sources.pnml import read_pnml

            return read_pnml(path)
        raise ValueError(f"can't load a {kind}")

    def resolve(self, text: Any, kind: str) -> Any:
        """An argument: a value, an id of the registry, a path (where a log is wanted), or JSON."""
        if not isinstance(text, str):
            return text
        if text in self.items:
            return self.items[text]
        if kind in ("Ocel", "EventLog", "PetriNet"):
            return self.items.setdefault(text, self.load(text, kind))
        if kind == "str":
            return text
        if text.endswith(".json"):
            with open(text, encoding="utf-8") as f:
                return json.load(f)
        return json.loads(text)

    def call(self, name: str, **arguments: Any) -> Any:
        """Call a function with arguments as text or values."""
        if name not in FUNCTIONS:
            raise KeyError(f"no function {name}; there are {', '.join(sorted(FUNCTIONS))}")
        f = FUNCTIONS[name]
        params = inspect.signature(f).parameters
        if unknown := set(arguments) - set(params):
            raise TypeError(f"{name} has no argument {', '.join(sorted(unknown))}")
        kind = lambda p: p.annotation if isinstance(p.annotation, str) else getattr(p.annotation, "__name__", "")
        return f(**{k: self.resolve(v, kind(params[k])) for k, v in arguments.items()})


def read_log(spark: SparkSession, path: str) -> EventLog:
    """A case-centric log: JSON by its ending, else XES, plain or gzipped."""
    from eventloom.sources import json_logs, xes

    return json_logs.read_log_json(spark, path) if path.endswith(".json") else xes.read_xes(spark, path)


def write_log(log: EventLog, path: str) -> None:
    """Write a case-centric log as JSON or XES, by the path's ending."""
    from eventloom.sources import json_logs, xes

    (json_logs.write_log_json if path.endswith(".json") else xes.write_xes)(log, path)


def arc_of(given: dict) -> Any:
    """A declarative arc of its JSON form: source, target, arrow, least, most, and lists each, any, all of [type, reached from] pairs."""
    from eventloom.operators.ocdeclare import Arc

    part = lambda k: tuple((x, None) if isinstance(x, str) else (x[0], x[1]) for x in given.get(k, ()))
    return Arc(given["source"], given["target"], given.get("arrow", "AS"), part("each"), part("any"), part("all"), given.get("least", 1), given.get("most"))


def as_json(value: Any) -> str:
    """A result as JSON; frames as lists of rows."""
    if isinstance(value, DataFrame):
        return json.dumps([r.asDict(recursive=True) for r in value.toLocalIterator()], default=str)
    if hasattr(value, "to_json"):
        return value.to_json()
    if isinstance(value, list) and value and hasattr(value[0], "__dataclass_fields__"):
        return json.dumps([str(x) for x in value])
    return json.dumps(value, default=str)


def _register_all() -> None:
    from eventloom.operators import casecentric as cc
    from eventloom import builders
    from eventloom.operators import lookups, ocdeclare
    from eventloom.operators import objectcentric as oc

    for f in (
        lookups.event_types, lookups.object_types, lookups.attributes_of_type, lookups.event_ids_of_type, lookups.object_ids_of_type, lookups.event_of_id, lookups.object_of_id,
        lookups.objects_of_event, lookups.events_of_object, lookups.related_from, lookups.related_to, lookups.object_trace, lookups.event_attribute, lookups.object_attribute_values,
        lookups.full_event, lookups.full_object, lookups.num_events, lookups.num_objects,
        builders.add_events, builders.add_objects, builders.without_e2o, builders.without_o2o, builders.declare_types,
    ):
        register(f)

    @register
    def new_ocel() -> Ocel:
        """An object-centric log without events and objects."""
        from pyspark.sql import SparkSession

        return builders.make_ocel(SparkSession.active(), [])

    @register
    def add_e2o(log: Ocel, links: list) -> Ocel:
        """The log with relationships [event, object, qualifier] added."""
        return builders.add_events(log, [], [tuple(x) for x in links])

    @register
    def add_o2o(log: Ocel, links: list) -> Ocel:
        """The log with relationships [object, other object, qualifier] added."""
        return builders.add_objects(log, [], [tuple(x) for x in links])

    @register
    def projection_numbers(log: EventLog) -> DataFrame:
        """n_variants, n_cases and n_activities of a log's projection."""
        return cc.projection_stats(cc.variants(log))

    @register
    def export_graph(log: Ocel, folder: str, typed: bool = False) -> str:
        """Node and edge folders of a log for graph databases."""
        from eventloom.sources.ocel import write_graph

        write_graph(log, folder, typed)
        return folder

    @register
    def graph_dot(log: EventLog) -> str:
        """Graphviz source of the directly-follows graph."""
        from eventloom.sources.json_logs import dfg_dot, dfg_json

        return dfg_dot(dfg_json(log))

    for f in (cc.dfg, cc.activity_counts, cc.start_end_activities, cc.variants, cc.timestamp_histogram, cc.dotted_chart, cc.log_statistics):
        register(f)
    for f in (
        oc.size, oc.type_stats, oc.type_link_counts, oc.conversion_rate, oc.involvement, oc.object_involvement, oc.object_dfg, oc.flattened_dfg, oc.object_variants, oc.flatten,
        oc.synchronisation, oc.sojourn, oc.attribute_history, oc.attribute_changes, oc.first_last, oc.abstraction, oc.events_of_type, oc.objects_of_type, oc.event, oc.object_,
        oc.objects_of_events, oc.events_of_objects, oc.related_objects, oc.without_orphans, oc.with_init_exit,
    ):
        register(f)
    register(ocdeclare.discover)

    @register
    def discover_net(log: EventLog) -> Any:
        """A Petri net of a case-centric log."""
        from eventloom.models.alpha import discover

        return discover(cc.variants(log))

    @register
    def export_ocel(log: Ocel, path: str) -> str:
        """Write an object-centric log to a file of the format that its name says."""
        from eventloom.sources.ocel import write_ocel

        write_ocel(log, path)
        return path

    @register
    def export_log(log: EventLog, path: str) -> str:
        """Write a case-centric log as XES or JSON."""
        write_log(log, path)
        return path

    @register
    def discover_best_net(log: EventLog) -> Any:
        """The Petri net of the best of several configurations."""
        from eventloom.models.alpha import discover_best

        return discover_best(cc.variants(log))[0]

    @register
    def token_replay(log: EventLog, net: PetriNet) -> DataFrame:
        """Token-based fitness of a log on a net."""
        from eventloom.operators.replay import token_replay as replay

        return replay(cc.variants(log), net)

    @register
    def declare_conformance(log: Ocel, arc: dict) -> DataFrame:
        """total, violated and conformance of a declarative arc."""
        return ocdeclare.conformance(log, arc_of(arc))

    @register
    def declare_reduction(arcs: list, lossless: bool = False) -> list:
        """Declarative arcs without those that a path of others implies."""
        return ocdeclare.reduce([arc_of(a) for a in arcs], lossless)

    @register
    def top_synchronisation(log: Ocel, k: int) -> DataFrame:
        """The k events of longest synchronisation time."""
        return oc.longest(oc.synchronisation(log), "sync_us", k)

    @register
    def top_sojourn(log: Ocel, k: int) -> DataFrame:
        """The k events of longest sojourn time."""
        return oc.longest(oc.sojourn(log), "sojourn_us", k)

    @register
    def most_frequent_variants(log: EventLog, n: int) -> DataFrame:
        """The n most frequent variants."""
        return cc.top_variants(cc.variants(log), n)

    @register
    def variant_percentages(log: EventLog) -> DataFrame:
        """Variants with their share of the cases."""
        return cc.variant_shares(cc.variants(log))

    @register
    def activity_projection(log: EventLog) -> str:
        """A log's variants as a projection in JSON."""
        from eventloom.sources.json_logs import projection_json

        return projection_json(cc.variants(log))

    @register
    def graph_json(log: EventLog) -> str:
        """The directly-follows graph as JSON."""
        from eventloom.sources.json_logs import dfg_json

        return dfg_json(log)

    @register
    def graph_successors(log: EventLog, act: str, least: int = 1) -> DataFrame:
        """Activities that follow an activity."""
        return cc.postset(cc.dfg(log), act, least)

    @register
    def graph_predecessors(log: EventLog, act: str, least: int = 1) -> DataFrame:
        """Activities that an activity follows."""
        return cc.preset(cc.dfg(log), act, least)

    @register
    def graph_has_relation(log: EventLog, a: str, b: str) -> DataFrame:
        """Whether an activity directly follows another."""
        return cc.has_relation(cc.dfg(log), a, b)

    @register
    def split_log(log: EventLog, parts: list) -> list:
        """Sub-logs of sets of activities, as numbers of events."""
        return [x.events.count() for x in cc.split_by_activity(log, [set(p) for p in parts])]

    for f in (oc.frames_of_type, oc.type_pair_links, oc.type_pair_objects, oc.object_dfg_json, oc.object_dfg_dot, oc.without_dangling, oc.object_variants):
        register(f)


_register_all()
