"""Iterated plans over arcs: conserved attention diffusion and best-path expansion.

State is a table (qid, node, a), so many queries run in one job. Every step is one written table
(lineage stays short, and a lost executor repeats tasks of one step only). Arcs have source,
target, edge_id, arc_direction and effective; with a qid column they are each query's own,
else all queries share them. Iterations write them once and deal them when a step expands many nodes
(adjacency.WrittenArcs), or take an adjacency that the caller has written and drops.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from convmem.operators.graph import normalize
from convmem.plans.adjacency import Adjacency, WrittenArcs
from convmem.plans.scratch import ScratchTables


@dataclass(frozen=True)
class Dynamics:
    """Parameters of the diffusion; the defaults are those of plain reads."""

    temperature: float = 1.0
    flow_floor: float = 0.0005
    max_outflow: float = 0.45
    gamma: float = 1.15
    anchor: float = 0.08
    threshold: float = 0.04
    steps: int = 8

    def __post_init__(self) -> None:
        for name, low, high in (("temperature", 0.2, 4), ("flow_floor", 0, 1), ("max_outflow", 0, 1), ("gamma", 1, 3), ("anchor", 0, 1), ("threshold", 0, 1), ("steps", 1, 32)):
            if not low <= getattr(self, name) <= high:
                raise ValueError(f"{name} must be between {low} and {high}")


def _arc_key(arcs: DataFrame) -> list[str]:
    return ["qid", "source"] if "qid" in arcs.columns else ["source"]


Gate = Callable[[DataFrame], DataFrame]


@contextmanager
def _in_place(arcs: DataFrame | Adjacency) -> Iterator[Adjacency | WrittenArcs]:
    """The arcs where steps read them, deleted in the end if they were written here."""
    if isinstance(arcs, Adjacency):
        yield arcs
        return
    written = WrittenArcs(arcs, _arc_key(arcs))
    try:
        yield written
    finally:
        written.drop()


def _reached(mass: DataFrame, arcs: DataFrame | Adjacency | WrittenArcs, gate: Gate | None) -> DataFrame:
    """The arcs of the sources (qid, source, …) that a step expands, gated if asked. Only these arcs
    meet a query, so a gate costs nothing for the rest of the graph."""
    out = arcs.of(mass) if isinstance(arcs, Adjacency | WrittenArcs) else mass.join(arcs, _arc_key(arcs))
    return gate(out) if gate else out


def _flows(mass: DataFrame, arcs: Adjacency | WrittenArcs, config: Dynamics, gate: Gate | None) -> DataFrame:
    """What each source (qid, source, a) sends along its arcs: (qid, source, target, edge_id,
    arc_direction, amount, out), out being all that the source sends."""
    p = F.col("a") * F.col("effective") - config.flow_floor
    open_arcs = _reached(mass, arcs, gate).withColumn("p", p).where("p > 0").select("qid", "source", "target", "edge_id", "arc_direction", "a", "p")
    asked = open_arcs.groupBy("qid", "source").agg(F.sum("p").alias("total"), F.first("a").alias("_a")).select("qid", "source", "total", F.least(F.col("_a") * config.max_outflow, "total").alias("out"))
    return open_arcs.join(asked, ["qid", "source"]).select("qid", "source", "target", "edge_id", "arc_direction", (F.col("out") * F.col("p") / F.col("total")).alias("amount"), "out")


def diffuse(arcs: DataFrame | Adjacency, seeds: DataFrame, config: Dynamics = Dynamics(), gate: Gate | None = None) -> DataFrame:
    """The trace of the diffusion: one row per (qid, step, node) with raw, competed and a.

    Each step a node sends out at most max_outflow of its attention, dealt over its arcs by
    max(0, a * effective - flow_floor); what arrives and what stays (raw) competes by the
    power gamma, normalised per query; the next state mixes that with the seeds by `anchor`. The
    sums of raw and of a are 1 for every query at every step. Step 0 holds the seeds. gate changes
    the effects of the arcs that a step reads (see recall.gated_arcs).
    """
    with _in_place(arcs) as adjacency:
        return _diffused(adjacency, seeds, config, gate)


def _diffused(arcs: Adjacency | WrittenArcs, seeds: DataFrame, config: Dynamics, gate: Gate | None) -> DataFrame:
    tables = ScratchTables()
    start = tables.write(normalize(seeds.select("qid", "node", F.col("weight").cast("double").alias("weight")), ["qid"]), "diffuse-seeds")
    state = start.select("qid", "node", F.col("weight").alias("a"))
    trace = [state.select("qid", F.lit(0).alias("step"), "node", F.lit(None).cast("double").alias("raw"), F.lit(None).cast("double").alias("competed"), "a")]
    kept = [start]
    for step in range(1, config.steps + 1):
        flows = _flows(state.select("qid", F.col("node").alias("source"), "a"), arcs, config, gate)
        # What leaves a source is the sum of its flows, so one aggregation has both what arrives and what stays.
        moved = flows.select("qid", F.explode(F.array(F.struct(F.col("target").alias("node"), F.col("amount").alias("v")), F.struct(F.col("source").alias("node"), (-F.col("amount")).alias("v")))).alias("x")).select("qid", "x.*")
        raw = moved.unionByName(state.select("qid", "node", F.col("a").alias("v"))).groupBy("qid", "node").agg(F.greatest(F.sum("v"), F.lit(0.0)).alias("raw"))
        raw = tables.write(raw, "diffuse-raw")
        powered = raw.withColumn("w", F.when(F.col("raw") > 0, F.pow("raw", F.lit(config.gamma))).otherwise(0.0))
        totals = powered.groupBy("qid").agg(F.sum("w").alias("total"))
        competed = powered.join(totals, "qid").select("qid", "node", "raw", (F.col("w") / F.col("total")).alias("competed"))
        mixed = competed.join(start, ["qid", "node"], "full_outer")
        a = (1 - config.anchor) * F.coalesce("competed", F.lit(0.0)) + config.anchor * F.coalesce("weight", F.lit(0.0))
        done = tables.write(mixed.select("qid", F.lit(step).alias("step"), "node", "raw", "competed", a.alias("a")), "diffuse-step")
        kept.append(done)
        tables.drop_all_but(*kept)
        trace.append(done)
        state = done.where("a > 0").select("qid", "node", "a")
    out = trace[0]
    for t in trace[1:]:
        out = out.unionByName(t)
    return out


def diffusion_flows(arcs: DataFrame, trace: DataFrame, config: Dynamics = Dynamics(), gate: Gate | None = None) -> DataFrame:
    """(qid, step, source, target, edge_id, arc_direction, amount): every flow of the diffusion, from
    the states of its trace. All steps are one join, as each state is a row of the trace."""
    mass = trace.where((F.col("step") < config.steps) & (F.col("a") > 0)).select(F.struct("qid", "step").alias("_at"), "qid", F.col("node").alias("source"), "a")
    p = F.col("a") * F.col("effective") - config.flow_floor
    open_arcs = _reached(mass, arcs, gate).withColumn("p", p).where("p > 0")
    asked = open_arcs.groupBy("_at", "source").agg(F.sum("p").alias("total"))
    amount = F.least(F.col("a") * config.max_outflow, "total") * F.col("p") / F.col("total")
    sent = open_arcs.join(asked, ["_at", "source"]).withColumn("amount", amount).where("amount > 0")
    return sent.select(F.col("_at.qid").alias("qid"), (F.col("_at.step") + 1).alias("step"), "source", "target", "edge_id", "arc_direction", "amount")


def emerged(trace: DataFrame, config: Dynamics = Dynamics()) -> DataFrame:
    """(qid, step, node, a): the nodes whose attention reaches the threshold after a step."""
    return trace.where((F.col("step") > 0) & (F.col("a") >= config.threshold)).select("qid", "step", "node", "a")


def discovery_paths(arcs: DataFrame, trace: DataFrame, config: Dynamics = Dynamics(), gate: Gate | None = None) -> DataFrame:
    """(qid, node, step, path): the edges by which the diffusion first reached a node. The path is
    fixed in that step, through the largest flow (ties: the source, then the edge id, forward
    first), and continues the source's own path."""
    tables = ScratchTables()
    flows = tables.write(diffusion_flows(arcs, trace, config, gate), "paths-flows")
    ways = [trace.where("step = 0").select("qid", "node", F.lit(0).alias("step"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("edge_id"))]
    for step in range(1, config.steps + 1):
        known = reduce(DataFrame.unionByName, ways)
        sent = flows.where(F.col("step") == step).drop("step").withColumnRenamed("target", "node")
        new = sent.join(known.select("qid", "node"), ["qid", "node"], "left_anti")
        best = new.groupBy("qid", "node").agg(F.min(F.struct((-F.col("amount")).alias("v"), "source", "edge_id", "arc_direction")).alias("b"))
        ways.append(tables.write(best.select("qid", "node", F.lit(step).alias("step"), "b.source", "b.edge_id"), f"paths-{step}"))
    return _walked(reduce(DataFrame.unionByName, ways), "source", config.steps, tables)


def _walked(ways: DataFrame, parent: str, steps: int, tables: ScratchTables) -> DataFrame:
    """ways (qid, node, parent, edge_id, …; null parent and edge at a start) with path in place of parent
    and edge_id: the edges from the start to the node, at most `steps`.

    Pointer doubling: each row knows an ancestor and the edges from there, and takes over that row's
    own, so that 2 ** r edges are known after r joins and no iteration carries paths. The other tables
    of `tables` are dropped.
    """
    rest = [c for c in ways.columns if c not in ("qid", "node", parent, "edge_id")]
    none = F.array().cast("array<string>")
    jumps = tables.write(ways.select("qid", "node", *rest, F.col(parent).alias("_up"), F.when(F.col("edge_id").isNull(), none).otherwise(F.array("edge_id")).alias("path")), "paths-jumps")
    tables.drop_all_but(jumps)
    for _ in range((steps - 1).bit_length()):
        above = jumps.select("qid", F.col("node").alias("_up"), F.col("_up").alias("_next"), F.col("path").alias("_before"))
        met = jumps.join(above, ["qid", "_up"], "left")
        jumps = tables.write(met.select("qid", "node", *rest, F.col("_next").alias("_up"), F.concat(F.coalesce("_before", none), "path").alias("path")), "paths-jumps")
        tables.drop_all_but(jumps)
    return jumps.drop("_up")


def conservation(trace: DataFrame) -> DataFrame:
    """Per query and step the sums of raw and a, and whether both are 1 within 1e-10."""
    sums = trace.where("step > 0").groupBy("qid", "step").agg(F.sum("raw").alias("raw_total"), F.sum("a").alias("total"))
    return sums.withColumn("conserved", (F.abs(F.col("raw_total") - 1) < 1e-10) & (F.abs(F.col("total") - 1) < 1e-10))


def best_paths(arcs: DataFrame | Adjacency, seeds: DataFrame, steps: int = 8, gate: Gate | None = None) -> DataFrame:
    """(qid, node, score, path): the largest product of effects over paths of at most `steps` arcs from
    a seed, seeds themselves included, and the edges of the path that has it.

    Each layer keeps the best way to a node (a combining minimum over (-score, source, edge id,
    direction), so ties go to the first source and edge), and a step is one join and one
    aggregation. Of layers with equal scores the earliest counts. Layers hold each node's last edge
    only; paths are found at the end.
    """
    with _in_place(arcs) as adjacency:
        return _best(adjacency, seeds, steps, gate)


def _best(arcs: Adjacency | WrittenArcs, seeds: DataFrame, steps: int, gate: Gate | None) -> DataFrame:
    tables = ScratchTables()
    start = tables.write(normalize(seeds.select("qid", "node", F.col("weight").cast("double").alias("weight")), ["qid"]), "best-seeds")
    none = F.lit(None).cast("string")
    layers = [start.select("qid", "node", F.col("weight").alias("score"), none.alias("source"), none.alias("edge_id"))]
    for step in range(1, steps + 1):
        front = layers[-1].select("qid", F.col("node").alias("source"), F.col("score").alias("_s"))
        m = -F.col("_s") * F.col("effective")
        reached = _reached(front, arcs, gate).groupBy("qid", F.col("target").alias("node")).agg(F.min(F.struct(m.alias("m"), "source", "edge_id", "arc_direction")).alias("b"))
        layers.append(tables.write(reached.select("qid", "node", (-F.col("b.m")).alias("score"), "b.source", "b.edge_id").where("score > 0"), f"best-{step}"))
    at = lambda layer, node: F.struct(F.lit(layer).alias("layer"), F.col(node).alias("name"))
    ways = [t.select("qid", at(i, "node").alias("node"), "score", F.when(F.col("source").isNotNull(), at(i - 1, "source")).alias("source"), "edge_id") for i, t in enumerate(layers)]
    walked = _walked(reduce(DataFrame.unionByName, ways), "source", steps, tables)
    best = walked.groupBy("qid", F.col("node.name").alias("node")).agg(F.min_by(F.struct("score", "path"), F.struct((-F.col("score")).alias("m"), F.col("node.layer"))).alias("b"))
    return best.select("qid", "node", "b.score", "b.path")


def traversal_counters(arcs: DataFrame, trace: DataFrame, steps: int) -> DataFrame:
    """Per query: arcs checked over all steps, nodes with attention at the end, and sources
    expanded."""
    expanding = trace.where((F.col("a") > 0) & (F.col("step") < steps)).select("qid", "step", F.col("node").alias("source"))
    degree = arcs.groupBy(*_arc_key(arcs)).agg(F.count("*").alias("degree"))
    checked = expanding.join(degree, _arc_key(arcs), "left").groupBy("qid").agg(F.coalesce(F.sum("degree"), F.lit(0)).alias("checked_arcs"), F.countDistinct("source").alias("expanded_sources"))
    visited = trace.where((F.col("a") > 0) & (F.col("step") == steps)).groupBy("qid").agg(F.count("*").alias("visited_nodes"))
    return checked.join(visited, "qid")
