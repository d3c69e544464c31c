"""Traces: spans, their events, counters, and graphs of parents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ablatrix.checkpoints import checkpointed
from ablatrix.operators.sets import difference


def spans(traces: DataFrame) -> DataFrame:
    return traces.select(F.explode("spans").alias("s")).select("s.*")


def span_events(traces: DataFrame) -> DataFrame:
    flat = spans(traces).select("trace_id", "span_id", F.col("name").alias("span"), F.explode("events").alias("e"))
    return flat.select("trace_id", "span_id", "span", F.col("e.name").alias("event"), F.col("e.timestamp").alias("timestamp"), F.col("e.attributes").alias("attributes"))


def counter_points(traces: DataFrame) -> DataFrame:
    flat = traces.select("trace_id", F.explode("metrics").alias("m")).select("trace_id", F.col("m.name").alias("counter"), F.explode("m.points").alias("p"))
    return flat.select("trace_id", "counter", F.col("p.attributes").alias("attributes"), F.col("p.value").alias("value"))


def reach_roots(nodes: DataFrame, node: str, parent: str) -> DataFrame:
    """Each node's root and depth by pointer doubling: after k rounds all nodes down to depth 2**k are known.

    nodes: one row a node, parent null at a root.  A node on a cycle, or below a parent that doesn't exist, never
    reaches a root: root and depth are null.  Every node above a known one is known, so the first round that settles
    none is the last; there are log2 of the depth.  Each is checkpointed so that the plan stays small.
    """
    start = nodes.select(F.col(node).alias("id"), F.coalesce(parent, node).alias("at"), F.col(parent).isNull().alias("done"))
    known = checkpointed(start.withColumn("depth", F.when(F.col("done"), 0).otherwise(1).cast("long")))
    settled = -1
    while (now := known.agg(F.count_if("done")).first()[0]) > settled:
        settled = now
        above = known.select(F.col("id").alias("p"), F.col("at").alias("next"), F.col("depth").alias("more"), F.col("done").alias("ends"))
        known = checkpointed(
            known.join(above, F.col("at") == F.col("p"), "left").select(
                "id", F.coalesce("next", "at").alias("at"), (F.col("done") | F.coalesce("ends", F.lit(False))).alias("done"),
                F.when(F.col("done"), F.col("depth")).otherwise(F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"),
            )
        )
    return known.select(F.col("id").alias(node), F.when(F.col("done"), F.col("at")).alias("root"), F.when(F.col("done"), F.col("depth")).alias("depth"))


def on_cycles(nodes: DataFrame, node: str, parent: str, max_rounds: int = 40) -> DataFrame:
    """The nodes that lie on a cycle of parents, apart from those that merely hang below one.

    Every node jumps 1, 2, 4 ... steps up; those whose way ends, at a root or where a parent doesn't exist, drop out.  What
    jumps reach shrinks until a round reaches as many nodes as the one before: then all of these are on cycles.  A round
    looks at distinct targets alone, so that a hub of very many nodes is one row.
    """
    step = nodes.filter(F.col(parent).isNotNull()).select(F.col(node).alias("id"), F.col(parent).alias("at")).distinct()
    jump, reached = checkpointed(step), None
    for _ in range(max_rounds):
        targets = jump.select("at").distinct()
        live = checkpointed(targets.join(jump.select(F.col("id").alias("at"), F.col("at").alias("next")), "at"))
        now = live.select("next").distinct().count()
        if now in (0, reached):
            break
        reached = now
        jump = checkpointed(jump.join(live, "at").select("id", F.col("next").alias("at")))
    else:
        raise RuntimeError(f"cycles did not settle in {max_rounds} rounds")
    return live.select(F.col("next").alias(node)).distinct()


def graph_violations(nodes: DataFrame, graph: str, node: str, parent: str) -> DataFrame:
    """By graph: ids that repeat, parents that don't exist, another number of roots than one."""
    again = nodes.groupBy(graph, node).agg(F.count("*").alias("n")).filter("n > 1").select(graph, F.col(node).alias("node"), F.lit("duplicate_span").alias("reason"))
    ids = nodes.select(graph, F.col(node).alias("p")).distinct()
    lost = nodes.filter(F.col(parent).isNotNull()).alias("n").join(ids.alias("i"), (F.col(f"n.{graph}") == F.col(f"i.{graph}")) & (F.col(parent) == F.col("p")), "left_anti")
    lost = lost.select(graph, F.col(node).alias("node"), F.lit("parent_missing").alias("reason"))
    roots = nodes.groupBy(graph).agg(F.count_if(F.col(parent).isNull()).alias("n")).filter("n <> 1")
    return again.unionByName(lost).unionByName(roots.select(graph, F.lit(None).cast(nodes.schema[node].dataType).alias("node"), F.lit("not_one_root").alias("reason")))


def topology_violations(components: DataFrame, model: str, component: str, parent: str, order: str) -> DataFrame:
    """By model: ids that repeat, parents that don't exist, orders below zero, and components that reach no root.

    The hierarchy is held as one graph whose nodes are (model, component); a component whose ancestors end in a missing
    parent or go round reaches none.
    """
    of = [F.col(model).alias("model"), F.col(component).alias("component")]
    again = components.groupBy(model, component).agg(F.count("*").alias("n")).filter("n > 1").select(*of, F.lit("component_duplicated").alias("reason"))
    negative = components.filter(F.col(order) < 0).select(*of, F.lit("order_negative").alias("reason"))
    known = components.select(F.col(model).alias("m"), F.col(component).alias("c")).distinct()
    lost = components.filter(F.col(parent).isNotNull()).join(known, (F.col(model) == F.col("m")) & (F.col(parent) == F.col("c")), "left_anti")
    lost = lost.select(*of, F.lit("parent_missing").alias("reason"))
    nodes = components.select(
        *of, F.to_json(F.struct(F.col(model).alias("m"), F.col(component).alias("c"))).alias("node"),
        F.when(F.col(parent).isNotNull(), F.to_json(F.struct(F.col(model).alias("m"), F.col(parent).alias("c")))).alias("above"),
    ).dropDuplicates(["node"])
    rootless = reach_roots(nodes, "node", "above").filter("root IS NULL").select("node")
    rootless = nodes.join(rootless, "node").select("model", "component", F.lit("no_root_above").alias("reason"))
    return again.unionByName(negative).unionByName(lost).unionByName(rootless)


def hook_balance(counters: DataFrame, segment: str) -> DataFrame:
    """Segments in which hooks were left active or a clean-up failed: counters are rows (segment, kind, value)."""
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("value")).otherwise(0))
    out = counters.groupBy(segment).agg(of("active").alias("active"), of("removed").alias("removed"), of("failed").alias("failed"), of("cleanup_failed").alias("cleanup_failed"))
    return out.filter((F.col("active") != F.col("removed") + F.col("failed")) | (F.col("cleanup_failed") > 0))


def missing_decisions(required: DataFrame, decisions: DataFrame) -> DataFrame:
    return required.join(decisions.select(*required.columns).distinct(), required.columns, "left_anti")


def counter_equality(events: DataFrame, points: DataFrame, keys: Sequence[str], corrections: DataFrame | None = None) -> DataFrame:
    """Keys whose number of events isn't the sum of their counter points; corrections (keys, value) are owed by events still open."""
    counted = events.groupBy(*keys).agg(F.count("*").alias("events"))
    if corrections is not None:
        extra = corrections.groupBy(*keys).agg(F.sum("value").alias("extra"))
        counted = counted.join(extra, list(keys), "full").select(*keys, (F.coalesce("events", F.lit(0)) + F.coalesce("extra", F.lit(0))).alias("events"))
    summed = points.groupBy(*keys).agg(F.sum("value").alias("counter"))
    both = counted.join(summed, list(keys), "full")
    return both.filter(~F.col("events").eqNullSafe(F.col("counter")))


def count_bounds(counted: DataFrame, bounds: DataFrame) -> DataFrame:
    """Names whose count isn't exact, or is below the minimum: bounds are name, exact, minimum, either null."""
    both = bounds.join(counted.select("name", "n"), "name", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return both.filter(F.coalesce(F.col("n") != F.col("exact"), F.lit(False)) | F.coalesce(F.col("n") < F.col("minimum"), F.lit(False)))


def record_coverage(span_records: DataFrame, observations: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Multisets of (task, record) that spans and observations should share."""
    return difference(observations.select(*keys), span_records.select(*keys))


def completeness(traces: DataFrame, semantics: str = "2") -> DataFrame:
    """Segments that version 2 doesn't take as complete; version 1 lets the state be unknown."""
    whole = F.col("complete") & (F.coalesce("dropped_spans", F.lit(-1)) == 0)
    fine = F.coalesce(whole, F.lit(False)) if semantics == "2" else F.coalesce(F.col("complete"), F.lit(True)) & (F.coalesce("dropped_spans", F.lit(0)) == 0)
    return traces.filter(~fine).select("trace_id", "complete", "dropped_spans")


def uncommitted(tasks: DataFrame, committed: DataFrame, key: str) -> DataFrame:
    """Completed tasks without a committed span."""
    return tasks.select(key).distinct().join(committed.select(key).distinct(), key, "left_anti")
