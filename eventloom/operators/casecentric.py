"""Operators over case-centric logs: lazy plans, one shuffle by case where order matters."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventloom.model import NO_ACTIVITY, UNKNOWN, EventLog

START, END = "__START", "__END"


def activity(column: str = "activity") -> Column:
    """The activity of an event, with a name for missing ones."""
    return F.coalesce(F.col(column), F.lit(NO_ACTIVITY))


def classify(events: DataFrame, keys: Sequence[str], name: str = "activity") -> DataFrame:
    """Set ``name`` to the class identity by a classifier: values joined by ``+``, missing ones empty."""
    return events.withColumn(name, F.concat_ws("+", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]))


def attribute(events: DataFrame, key: str, default: str | None = None, attrs: str = "attrs") -> Column:
    """An attribute of an event or case, or the log's global default."""
    return F.coalesce(F.col(attrs)[key], F.lit(default))


#: Spark types of attribute types; other ones are text.
ATTRIBUTE_TYPES = {"int": "bigint", "integer": "bigint", "float": "double", "boolean": "boolean", "date": "timestamp", "time": "timestamp"}


def typed_attribute(events: DataFrame, key: str, kind: str, attrs: str = "attrs") -> Column:
    """An attribute as a value of its type (null where the text isn't one)."""
    text = F.try_element_at(attrs, F.lit(key))
    if ATTRIBUTE_TYPES.get(kind) == "timestamp":
        from eventloom.functions.timestamps import parse

        return parse(text)
    return text.try_cast(ATTRIBUTE_TYPES[kind]) if kind in ATTRIBUTE_TYPES else text


def with_attribute(events: DataFrame, key: str, value: Column, kind: str = "string") -> DataFrame:
    """Events (or cases) with an attribute set, in the place of an older value; a null value takes it away."""
    out = without_attribute(events.withColumn("_value", value.cast("string")), key)  # the value may be made of the older one
    none = F.create_map().cast("map<string,string>")
    text = F.col("_value")
    for column, x in (("attrs", text), ("attr_types", F.lit(kind))):
        if column in out.columns:
            out = out.withColumn(column, F.map_concat(F.coalesce(column, none), F.when(text.isNotNull(), F.create_map(F.lit(key), x)).otherwise(none)))
    return out.drop("_value")


def without_attribute(events: DataFrame, key: str) -> DataFrame:
    """Events (or cases) without an attribute."""
    for column in ("attrs", "attr_types"):
        if column in events.columns:
            events = events.withColumn(column, F.map_filter(column, lambda k, _: k != key))
    return events


def attribute_rows(events: DataFrame, keys: Sequence[str] = ("case_id", "event_idx")) -> DataFrame:
    """Attributes as rows: keys, key, value and, where it is known, type."""
    kind = F.try_element_at("attr_types", F.col("key")) if "attr_types" in events.columns else F.lit(None).cast("string")
    return events.select(*keys, *(c for c in ("attr_types",) if c in events.columns), F.explode("attrs").alias("key", "value")).select(*keys, "key", "value", kind.alias("type"))


def attribute_maps(rows: DataFrame, keys: Sequence[str] = ("case_id", "event_idx")) -> DataFrame:
    """The maps of ``attribute_rows``: keys, attrs and attr_types."""
    of = lambda c: F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", c))))
    return rows.groupBy(*keys).agg(of("value").alias("attrs"), of("type").alias("attr_types"))


def has_relation(relations: DataFrame, a: str, b: str) -> DataFrame:
    """Whether a graph has an edge: one row, found."""
    return relations.filter((F.col("from_activity") == a) & (F.col("to_activity") == b)).agg((F.count("*") > 0).alias("found"))


def has_activity(counts: DataFrame, act: str) -> DataFrame:
    """Whether a graph has a node: one row, found."""
    return counts.filter(F.col("activity") == act).agg((F.count("*") > 0).alias("found"))


def event_hash(events: DataFrame) -> Column:
    """A 64-bit hash of an event's activity, time and attributes, whatever the order of the latter."""
    attrs = F.sort_array(F.map_entries("attrs")) if "attrs" in events.columns else F.lit(None).cast("string")
    return F.xxhash64("activity", "ts", attrs)


def sequenced(log: EventLog, order: Sequence[str] = ("ts", "event_idx")) -> DataFrame:
    """Events with the next activity of their case and whether they are its first or last."""
    w = W.partitionBy("case_id").orderBy(*order)
    return log.events.select(
        "case_id",
        activity().alias("activity"),
        F.lead(activity()).over(w).alias("next"),
        (F.row_number().over(w) == 1).alias("is_start"),
    ).withColumn("is_end", F.col("next").isNull())


def dfg(log: EventLog, order: Sequence[str] = ("ts", "event_idx")) -> DataFrame:
    """Directly-follows relations with their counts: from_activity, to_activity, cnt."""
    pairs = sequenced(log, order).filter("next IS NOT NULL")
    return pairs.groupBy(F.col("activity").alias("from_activity"), F.col("next").alias("to_activity")).agg(F.count("*").alias("cnt"))


def activity_counts(log: EventLog) -> DataFrame:
    """Events of each activity: activity, cnt."""
    return log.events.groupBy(activity().alias("activity")).agg(F.count("*").alias("cnt"))


def start_end_activities(log: EventLog, order: Sequence[str] = ("ts", "event_idx")) -> DataFrame:
    """Activities that start and end cases, with counts: kind (start or end), activity, cnt."""
    s = sequenced(log, order).filter("is_start OR is_end")
    kind = F.explode(F.array_compact(F.array(F.when(F.col("is_start"), "start"), F.when(F.col("is_end"), "end"))))
    return s.select("activity", kind.alias("kind")).groupBy("kind", "activity").agg(F.count("*").alias("cnt"))


def full_dfg(log: EventLog, order: Sequence[str] = ("ts", "event_idx")) -> dict[str, DataFrame]:
    """activities, relations, starts and ends of the directly-follows graph."""
    ends = start_end_activities(log, order)
    return {
        "activities": activity_counts(log),
        "relations": dfg(log, order),
        "starts": ends.filter("kind = 'start'").drop("kind"),
        "ends": ends.filter("kind = 'end'").drop("kind"),
    }


def traces(log: EventLog, order: Sequence[str] = ("ts", "event_idx")) -> DataFrame:
    """The activities of every case in order: case_id, variant (array); empty for cases without events."""
    sort = F.array_sort(F.collect_list(F.struct(*order, activity().alias("a"))))
    own = log.events.groupBy("case_id").agg(F.transform(sort, lambda x: x["a"]).alias("variant"))
    if log.cases is None:
        return own
    return log.cases.select("case_id").join(own, "case_id", "left").select("case_id", F.coalesce("variant", F.array().cast("array<string>")).alias("variant"))


def variants(log: EventLog, order: Sequence[str] = ("ts", "event_idx")) -> DataFrame:
    """Distinct activity sequences with their number of cases: variant (array), freq."""
    return traces(log, order).groupBy("variant").agg(F.count("*").alias("freq"))


def variant_shares(found: DataFrame) -> DataFrame:
    """Variants with their percentage of all cases (0 if there are none)."""
    total = found.agg(F.coalesce(F.sum("freq"), F.lit(0)).alias("_cases"))
    return found.crossJoin(F.broadcast(total)).select(
        "variant", "freq", F.when(F.col("_cases") == 0, 0.0).otherwise(F.col("freq") * 100.0 / F.col("_cases")).alias("percentage")
    )  # one row on the broadcast side


def top_variants(found: DataFrame, n: int) -> DataFrame:
    """The n most frequent variants; ties in the order of their activities."""
    return found.orderBy(F.desc("freq"), "variant").limit(n)


def projection_stats(found: DataFrame) -> DataFrame:
    """n_variants, n_cases and n_activities of a projection."""
    acts = found.select(F.explode("variant").alias("a")).agg(F.countDistinct("a").alias("n_activities"))
    return found.agg(F.count("*").alias("n_variants"), F.coalesce(F.sum("freq"), F.lit(0)).alias("n_cases")).crossJoin(acts)


def with_start_end(found: DataFrame) -> DataFrame:
    """Variants with artificial start and end activities."""
    return found.withColumn("variant", F.concat(F.array(F.lit(START)), "variant", F.array(F.lit(END))))


def weighted_dfg(found: DataFrame) -> DataFrame:
    """Directly-follows relations of variants weighted by their frequency: from_activity, to_activity, cnt."""
    v = F.col("variant")
    pairs = F.when(F.size(v) > 1, F.arrays_zip(F.slice(v, F.lit(1), F.size(v) - 1).alias("f"), F.slice(v, F.lit(2), F.size(v) - 1).alias("t")))
    rows = found.select("freq", F.explode(pairs).alias("p"))
    return rows.groupBy(F.col("p.f").alias("from_activity"), F.col("p.t").alias("to_activity")).agg(F.sum("freq").alias("cnt"))


def weighted_activity_counts(found: DataFrame) -> DataFrame:
    """Activities of variants weighted by their frequency: activity, cnt."""
    return found.select(F.explode("variant").alias("activity"), "freq").groupBy("activity").agg(F.sum("freq").alias("cnt"))


def filter_dfg(relations: DataFrame, absolute: int, relative: float) -> DataFrame:
    """Relations of at least ``absolute`` that reach ``relative`` of the mean going out of their source or into their target."""
    out, into = W.partitionBy("from_activity"), W.partitionBy("to_activity")
    scored = relations.withColumns({"_out": F.avg("cnt").over(out), "_in": F.avg("cnt").over(into)})
    keep = (F.col("cnt") >= absolute) & ((F.col("cnt") >= relative * F.col("_out")) | (F.col("cnt") >= relative * F.col("_in")))
    return scored.filter(keep).drop("_out", "_in")


def preset(relations: DataFrame, act: str, least: int = 1) -> DataFrame:
    """Activities that directly precede ``act`` at least so often."""
    return relations.filter((F.col("to_activity") == act) & (F.col("cnt") >= least)).select(F.col("from_activity").alias("activity"), "cnt")


def postset(relations: DataFrame, act: str, least: int = 1) -> DataFrame:
    """Activities that directly follow ``act`` at least so often."""
    return relations.filter((F.col("from_activity") == act) & (F.col("cnt") >= least)).select(F.col("to_activity").alias("activity"), "cnt")


def between(relations: DataFrame, a: str, b: str) -> DataFrame:
    """The relation from a to b, if it occurs."""
    return relations.filter((F.col("from_activity") == a) & (F.col("to_activity") == b))


def without_activity(relations: DataFrame, act: str) -> DataFrame:
    """Relations without those of an activity."""
    return relations.filter((F.col("from_activity") != act) & (F.col("to_activity") != act))


def timestamp_histogram(log: EventLog, bins: int = 100) -> DataFrame:
    """Events by time bin and activity: bin_ms (middle of the bin, epoch ms), activity, cnt.

    All events of one time fall into bin 0, whose middle is that time.
    """
    e = log.events.filter("ts IS NOT NULL").select(F.unix_millis("ts").alias("ms"), F.coalesce("activity", F.lit(UNKNOWN)).alias("activity"))
    span = e.agg(F.min("ms").alias("lo"), F.max("ms").alias("hi"))
    width = (F.col("hi") - F.col("lo")).cast("double") / bins
    b = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.floor((F.col("ms") - F.col("lo")).cast("double") / width), F.lit(bins - 1)))
    binned = e.crossJoin(F.broadcast(span)).withColumn("bin", b.cast("long"))  # the broadcast side is one row
    middle = F.when(F.col("hi") == F.col("lo"), F.col("lo")).otherwise(F.round(F.col("lo") + (F.col("bin") + 0.5) * width).cast("long"))
    return binned.groupBy(middle.alias("bin_ms"), "activity").agg(F.count("*").alias("cnt"))


def dotted_chart(log: EventLog, color: str = "activity", order: Sequence[str] = ("ts", "event_idx")) -> DataFrame:
    """A dot for every event: case_id, event_idx, x in four forms, y by case and by colour label.

    x_absolute (epoch ms), x_since_start (ms), x_relative (share of the case's
    duration, 0 if that is 0), x_step (from 0); y_case is the rank of the case by
    its first time (missing first), y_label the order of a label's first dot.
    """
    w = W.partitionBy("case_id").orderBy(*order)
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    e = log.events.select("case_id", *[c for c in order if c != "case_id"], F.coalesce(F.col(color).cast("string"), F.lit(UNKNOWN)).alias("label"))
    ms = F.unix_millis("ts")
    dots = e.withColumns(
        {
            "x_absolute": ms,
            "_first": F.first(ms).over(whole),
            "_last": F.last(ms).over(whole),
            "x_step": (F.row_number().over(w) - 1).cast("long"),
        }
    )
    span = F.col("_last") - F.col("_first")
    dots = dots.withColumns(
        {
            "x_since_start": F.col("x_absolute") - F.col("_first"),
            "x_relative": F.when(span == 0, 0.0).otherwise((F.col("x_absolute") - F.col("_first")).cast("double") / span),
        }
    )
    ranks = ranked(dots.groupBy("case_id").agg(F.min("_first").alias("_first")), [F.col("_first").asc_nulls_first(), F.col("case_id").asc()], "y_case").drop("_first")
    dots = dots.join(ranks, "case_id")
    seen = dots.groupBy("label").agg(F.min(F.struct("y_case", "x_step")).alias("_seen"))
    labels = ranked(seen, [F.col("_seen").asc()], "y_label").drop("_seen")
    return dots.join(labels, "label").select("case_id", "event_idx", "label", "x_absolute", "x_since_start", "x_relative", "x_step", "y_case", "y_label")


def checkpointed(rows: DataFrame) -> DataFrame:
    """``rows`` written once to the folder of ``spark.checkpoint.dir``, so what depends on how they are dealt is the same wherever it is read.

    With a local master a temporary folder is taken where the setting is missing.
    """
    context = rows.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = context.getConf().get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="eventloom-")
        context.setCheckpointDir(folder)
    return rows.checkpoint()


def ranked(rows: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Rows with their place (from 0) in an order, which ranges of rows share out: only a count for each range meets in one task.

    Ranges are drawn from a sample, so they are written once.
    """
    spread = rows.repartitionByRange(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order)
    placed = checkpointed(spread.withColumn("_range", F.spark_partition_id()))
    inside = placed.withColumn("_n", F.row_number().over(W.partitionBy("_range").orderBy(*order)))
    counts = placed.groupBy("_range").agg(F.count("*").alias("_c"))
    before = counts.select("_range", F.coalesce(F.sum("_c").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return inside.join(F.broadcast(before), "_range").withColumn(name, (F.col("_before") + F.col("_n") - 1).cast("long")).drop("_range", "_n", "_before")


def log_statistics(log: EventLog) -> DataFrame:
    """n_cases, n_events and the mean number of events of a case."""
    n = log.events.agg(F.count("*").alias("n_events"))
    return log.case_frame().agg(F.count("*").alias("n_cases")).crossJoin(n).withColumn("mean_events", F.when(F.col("n_cases") > 0, F.col("n_events") / F.col("n_cases")))


def split_by_activity(log: EventLog, parts: Sequence[set[str]]) -> list[EventLog]:
    """A sub-log for each set of activities, every one with all cases; activities of no set are left out."""
    for i, a in enumerate(parts):
        for b in parts[i + 1 :]:
            if a & b:
                raise ValueError(f"activities in two sets: {sorted(a & b)}")
    cases = log.case_frame()
    return [EventLog(log.events.filter(F.col("activity").isin(sorted(p))), cases, log.meta) for p in parts]


def split_at_random(log: EventLog, n: int, seed: int = 0) -> list[EventLog]:
    """n sub-logs of events dealt uniformly; the same seed deals the same."""
    cases = log.case_frame()
    place = F.pmod(F.xxhash64(F.lit(seed), "case_id", "event_idx"), F.lit(n))
    return [EventLog(log.events.filter(place == i), cases, log.meta) for i in range(n)]


def random_activity_sets(activities: Sequence[str], n: int, seed: int = 0) -> list[set[str]]:
    """A random partition of activities into exactly n sets."""
    import random

    if not 1 <= n <= len(set(activities)):
        raise ValueError("n must be between 1 and the number of activities")
    rng, acts = random.Random(seed), sorted(set(activities))
    rng.shuffle(acts)
    out = [{a} for a in acts[:n]]
    for a in acts[n:]:
        out[rng.randrange(n)].add(a)
    return out


def random_activity_sets_up_to(activities: Sequence[str], most: int, seed: int = 0) -> list[set[str]]:
    """A random partition into 2 to ``most`` sets, both included."""
    import random

    most = min(most, len(set(activities)))
    return random_activity_sets(activities, random.Random(seed).randint(min(2, most), most), seed)


def insert_between(found: DataFrame, a: str, b: str, inserted: str) -> DataFrame:
    """Variants with ``inserted`` put between every direct succession of a and b."""
    v = F.col("variant")
    grown = F.flatten(F.transform(v, lambda x, i: F.when((x == a) & (F.get(v, i + 1) == b), F.array(x, F.lit(inserted))).otherwise(F.array(x))))
    return found.withColumn("variant", grown).groupBy("variant").agg(F.sum("freq").alias("freq"))
