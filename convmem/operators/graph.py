"""Graph reads: visible nodes and edges, merging of evidence and parallel edges, arcs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from convmem.plans.joins import join_checked
from convmem.plans.scratch import scratch

CAUSAL = "CAUSAL"


def visible_nodes(nodes: DataFrame, episode: str | None = None, unresolved: bool = False) -> DataFrame:
    """LONG_TERM nodes, TEMPORARY ones of the caller's episode, UNRESOLVED ones on request."""
    seen = F.col("stage") == "LONG_TERM"
    if episode is not None:
        seen = seen | ((F.col("stage") == "TEMPORARY") & (F.col("episode") == episode))
    if unresolved:
        seen = seen | (F.col("stage") == "UNRESOLVED")
    return nodes.where(seen)


def merge_mentions(nodes: DataFrame, mentions: DataFrame) -> DataFrame:
    """Nodes with the evidence of their mentions appended, each item once, in order.

    nodes: id, evidence (array of strings); mentions: node_id, run_id, evidence.
    """
    more = mentions.groupBy("node_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("run_id", "evidence"))), lambda x: x["evidence"])).alias("_more"))
    joined = nodes.join(more, nodes["id"] == more["node_id"], "left")
    union = F.array_distinct(F.concat(F.coalesce("evidence", F.array().cast("array<string>")), F.coalesce("_more", F.array().cast("array<string>"))))
    return joined.withColumn("evidence", union).drop("_more", "node_id")


def visible_edges(edges: DataFrame, writes: DataFrame, episodes: DataFrame, publications: DataFrame, episode: str | None = None) -> DataFrame:
    """Edges whose own write is committed in their scope and that are of a closed legacy episode, of
    the caller's episode, or consolidated: written by a committed consolidation, or published by one.
    Applied before parallel edges are combined, so that a hidden edge never lends its strength.

    edges: scope, write_id, id, …; writes: scope, write_id, episode, kind, status; episodes: scope,
    episode, lifecycle, episode_status; publications: scope, edge_id, write_id (of the consolidation).
    Missing writes and episodes, and null states, count as not visible.
    """
    committed = writes.where("status = 'COMMITTED'").select("scope", "write_id", F.col("episode").alias("_episode"), F.col("kind").alias("_kind"))
    states = episodes.select("scope", F.col("episode").alias("_episode"), ((F.col("lifecycle") == "legacy") & (F.col("episode_status") != "OPEN")).alias("_closed"))
    own = F.coalesce("_closed", F.lit(False)) | (F.col("_kind") == "consolidation")
    if episode is not None:
        own = own | (F.col("_episode") == episode)
    allowed = committed.join(states, ["scope", "_episode"], "left").select("scope", "write_id", "_kind", F.coalesce(own, F.lit(False)).alias("_own"))
    # A few writes can hold all edges, so edges are dealt by their writes only where these are too many to send round.
    allowed = scratch(allowed, "edge-writes")
    final = allowed.where("_kind = 'consolidation'").select("scope", "write_id")
    published = join_checked(publications, final, ["scope", "write_id"], "left_semi").select("scope", F.col("edge_id").alias("id"), F.lit(True).alias("_published")).distinct()
    joined = join_checked(edges, allowed.drop("_kind"), ["scope", "write_id"], "inner").join(published, ["scope", "id"], "left")
    return joined.where(F.col("_own") | F.coalesce("_published", F.lit(False))).select(*edges.columns)


def combine_parallel(edges: DataFrame, key: list[str] | None = None) -> DataFrame:
    """One edge per (source, target, relation), unordered unless CAUSAL: the largest strength, the
    smallest id, all record ids in order, and the union of their evidence, in order, where the edges
    have any (array column evidence)."""
    key = key or []
    directed = F.col("relation") == CAUSAL
    a = F.when(directed, F.col("source")).otherwise(F.least("source", "target")).alias("source")
    b = F.when(directed, F.col("target")).otherwise(F.greatest("source", "target")).alias("target")
    cited = [F.array_sort(F.array_distinct(F.flatten(F.collect_set("evidence")))).alias("evidence")] if "evidence" in edges.columns else []
    rows = edges.select(*key, a, b, "relation", "strength", "id", *["evidence"] * len(cited))
    return rows.groupBy(*key, "source", "target", "relation").agg(F.max("strength").alias("strength"), F.min("id").alias("id"), F.array_sort(F.collect_set("id")).alias("record_ids"), *cited)


def visible_graph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    ids = nodes.select("id")
    out = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi")
    return out.join(ids.withColumnRenamed("id", "target"), "target", "left_semi")


def touching_edges(edges: DataFrame, ids: DataFrame, within: bool = False) -> DataFrame:
    """Edges with an end (within: both ends) in ids (column id)."""
    keys = ids.select("id").distinct()
    source, target = keys.select(F.col("id").alias("source"), F.lit(True).alias("_s")), keys.select(F.col("id").alias("target"), F.lit(True).alias("_t"))
    marked = edges.join(source, "source", "left").join(target, "target", "left")
    s, t = F.coalesce("_s", F.lit(False)), F.coalesce("_t", F.lit(False))
    return marked.where((s & t) if within else (s | t)).drop("_s", "_t")


def normalize(weights: DataFrame, key: list[str], weight: str = "weight") -> DataFrame:
    """Positive weights of each key divided by their sum. A key whose sum is not positive has no
    rows: callers report such keys from the plan check."""
    positive = weights.where(F.col(weight) > 0)
    totals = positive.groupBy(*key).agg(F.sum(weight).alias("_total"))
    return positive.join(totals, key).withColumn(weight, F.col(weight) / F.col("_total")).drop("_total")


def effective(strength: Column, relation_weight: Column, temperature: float) -> Column:
    return F.pow(strength, F.lit(1.0 / temperature)) * relation_weight


def arcs(edges: DataFrame, relations: dict[str, float], direction: str = "both", temperature: float = 1.0) -> DataFrame:
    """Directed arcs (source, target, edge_id, relation, arc_direction, effective).

    Relation weights are normalised to sum 1; arcs without positive effect are left out. CAUSAL
    edges run forward, in reverse or both ways by `direction`, all others both ways.
    """
    total = sum(w for w in relations.values() if w > 0)
    if total <= 0:
        raise ValueError("relation weights must have a positive sum")
    weight = F.lit(0.0)
    for name, w in relations.items():
        if w > 0:
            weight = F.when(F.col("relation") == name, F.lit(w / total)).otherwise(weight)
    e = edges.withColumn("effective", effective(F.col("strength").cast("double"), weight, temperature)).where("effective > 0")
    forward = e if direction in ("forward", "both") else e.where(F.col("relation") != CAUSAL)
    back = e if direction in ("reverse", "both") else e.where(F.col("relation") != CAUSAL)
    columns = ["edge_id", "relation", "arc_direction", "effective"]
    there = forward.select("source", "target", F.col("id").alias("edge_id"), "relation", F.lit("forward").alias("arc_direction"), "effective")
    again = back.select(F.col("target").alias("source"), F.col("source").alias("target"), F.col("id").alias("edge_id"), "relation", F.lit("reverse").alias("arc_direction"), "effective")
    return there.unionByName(again).select("source", "target", *columns)


def frontier_arcs(all_arcs: DataFrame, frontier: DataFrame, node_limit: int, arc_limit: int) -> tuple[DataFrame, DataFrame]:
    """(all arcs of the frontier's sources (qid, node), none pruned; each query's counts of sources and
    arcs and whether a limit is passed). Callers refuse queries that pass a limit as a whole."""
    read = frontier.select("qid", F.col("node").alias("source")).distinct().join(all_arcs, "source")
    counts = read.groupBy("qid").agg(F.countDistinct("source").alias("n_sources"), F.count("*").alias("n_arcs"))
    return read, counts.withColumn("over_limit", (F.col("n_sources") > node_limit) | (F.col("n_arcs") > arc_limit))


def fingerprint(rows: DataFrame, columns: list[str], key: list[str]) -> DataFrame:
    """(key, n, fingerprint): a hash of each key's rows that does not depend on their order; repeated rows
    count. Four sums over slices of the rows' SHA-256 are combined in the reading tasks, so a key of
    any size is one row a task. A row is its columns as text, parted by tabs; nulls are left out."""
    h = F.sha2(F.concat_ws("\t", *[F.col(c).cast("string") for c in columns]), 256)
    sums = [F.sum(F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("bigint")).alias(f"_s{i}") for i in range(4)]
    g = rows.groupBy(*key).agg(F.count("*").alias("n"), *sums)
    return g.select(*key, "n", F.sha2(F.concat_ws(":", "n", *[f"_s{i}" for i in range(4)]), 256).alias("fingerprint"))


def visible_events(events: DataFrame, episodes: DataFrame, episode: str | None = None) -> DataFrame:
    """Raw events of closed or consolidated episodes and of the caller's own.

    episodes: scope, episode, episode_status."""
    joined = events.join(episodes.select("scope", "episode", "episode_status"), ["scope", "episode"])
    seen = F.col("episode_status").isin("CLOSED", "CONSOLIDATED")
    return joined.where(seen | (F.col("episode") == episode) if episode is not None else seen)


def cited_backfill(cited: DataFrame, visible: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cited events that are not visible, cited ids that exist nowhere). cited: scope, event_id;
    visible and events: scope, id. The second must be empty."""
    wanted = cited.select("scope", F.col("event_id").alias("id")).distinct()
    hidden = wanted.join(visible.select("scope", "id"), ["scope", "id"], "left_anti")
    return hidden.join(events, ["scope", "id"]), hidden.join(events.select("scope", "id"), ["scope", "id"], "left_anti")
