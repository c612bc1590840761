"""Token-based replay of variants on a Petri net, as one fold over each variant."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.models.petri import PetriNet


def token_replay(found: DataFrame, net: PetriNet, strict_silent: bool = False) -> DataFrame:
    """Totals over all cases: produced, consumed, missing, remaining and fitness.

    ``found``: variants (variant, freq).  Activities that no transition has are
    skipped; tokens that are missing are counted and put in; the final marking is
    consumed at the end.  The net must have an initial and one final marking and
    no label twice; with ``strict_silent`` silent transitions are an error too.
    """
    initial, final = net.initial_marking, net.final_markings
    if not initial:
        raise ValueError("the net has no initial marking")
    if len(final) != 1:
        raise ValueError("the net has no final marking" if not final else "the net has more than one final marking")
    labels = [t.label for t in net.transitions.values() if t.label is not None]
    if len(labels) != len(set(labels)):
        raise ValueError("two transitions have one label")
    if strict_silent and len(labels) != len(net.transitions):
        raise ValueError("the net has silent transitions")
    places = sorted(net.places)
    at = {p: i for i, p in enumerate(places)}
    zero = [0] * len(places)
    pre, post = {}, {}
    for t in net.transitions.values():
        if t.label is None:
            continue
        a, b = list(zero), list(zero)
        for p in net.preset(t.id):
            a[at[p]] += 1
        for p in net.postset(t.id):
            b[at[p]] += 1
        pre[t.label], post[t.label] = a, b
    vector = lambda xs: F.array(*[F.lit(int(x)).cast("long") for x in xs])
    start, end = [initial.get(p, 0) for p in places], [final[0].get(p, 0) for p in places]

    def step_map(x: dict[str, list[int]]):
        entries = [y for k, v in sorted(x.items()) for y in (F.lit(k), vector(v))]
        return F.create_map(*entries) if entries else F.create_map().cast("map<string,array<bigint>>")

    before, after = step_map(pre), step_map(post)
    sums = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda s, x: s + x)
    lacking = lambda m: sums(F.transform(m, lambda x: F.greatest(-x, F.lit(0).cast("long"))))
    filled = lambda m: F.transform(m, lambda x: F.greatest(x, F.lit(0).cast("long")))

    def step(state, act):
        left = F.zip_with(state["m"], before[act], lambda x, y: x - y)
        return F.when(
            F.map_contains_key(before, act),
            F.struct(
                F.zip_with(filled(left), after[act], lambda x, y: x + y).alias("m"),
                (state["p"] + sums(after[act])).alias("p"),
                (state["c"] + sums(before[act])).alias("c"),
                (state["miss"] + lacking(left)).alias("miss"),
            ),
        ).otherwise(state)

    long = lambda x: F.lit(int(x)).cast("long")
    begin = F.struct(vector(start).alias("m"), long(sum(start)).alias("p"), long(0).alias("c"), long(0).alias("miss"))
    ended = found.select("freq", F.aggregate("variant", begin, step).alias("s"))
    left = F.zip_with(F.col("s.m"), vector(end), lambda x, y: x - y)
    per = ended.select(
        "freq", F.col("s.p").alias("p"), (F.col("s.c") + long(sum(end))).alias("c"), (F.col("s.miss") + lacking(left)).alias("miss"), sums(filled(left)).alias("rest")
    )
    total = lambda c: F.coalesce(F.sum(F.col(c) * F.col("freq")), F.lit(0)).cast("long")
    out = per.agg(total("p").alias("produced"), total("c").alias("consumed"), total("miss").alias("missing"), total("rest").alias("remaining"))
    share = lambda a, b: F.when(F.col(b) == 0, F.lit(float("nan"))).otherwise(F.lit(1.0) - F.col(a).cast("double") / F.col(b))
    return out.withColumn("fitness", F.lit(0.5) * share("missing", "consumed") + F.lit(0.5) * share("remaining", "produced"))
