"""Connected components by repeated contraction, entirely as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from convmem.plans.scratch import drop_scratch, write_scratch


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", label: str = "cc", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node that occurs in an edge; component is the smallest node
    reachable.

    Each round hooks every node to its smallest neighbour (a combining aggregation, so a hub
    with a third of all edges is pre-aggregated before the shuffle), follows the pointers
    twice, and contracts the edges to the new roots. Every node but the local minima vanishes,
    so the number of nodes at least halves and the rounds grow with the logarithm of the
    largest component. The smallest node of a component never hooks, so it ends as the root. Rounds are
    written to the shared folder, and all but the result deleted; nothing is collected.

    Null endpoints and self loops: a self loop yields its node as its own component; edges
    with a null end are ignored. Repeated edges have no effect. No edges: an empty result.
    """
    spark = edges.sparkSession
    clean = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    nodes, nodes_path = write_scratch(clean.select(F.explode(F.array("u", "v")).alias("node")).distinct(), f"{label}-nodes")
    mapping, mapping_path = nodes.select("node", F.col("node").alias("root")), None
    current, current_path = write_scratch(clean.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), f"{label}-edges")
    for _ in range(max_rounds):
        if current.isEmpty():
            break
        both = current.select(F.explode(F.array(F.struct(F.col("u").alias("a"), F.col("v").alias("b")), F.struct(F.col("v").alias("a"), F.col("u").alias("b")))).alias("e")).select("e.*")
        hooked = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("x"), F.least("a", "m").alias("p"))
        hooked, hooked_path = write_scratch(hooked, f"{label}-hook")
        jump = hooked.select(F.col("x").alias("p"), F.col("p").alias("pp"))
        parents = hooked.join(jump, "p", "left").select("x", F.coalesce("pp", "p").alias("p"))
        parents, parents_path = write_scratch(parents, f"{label}-parent")
        to_u, to_v = parents.select(F.col("x").alias("u"), F.col("p").alias("pu")), parents.select(F.col("x").alias("v"), F.col("p").alias("pv"))
        contracted = current.join(to_u, "u").join(to_v, "v").where("pu <> pv").select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct()
        follow = parents.select(F.col("x").alias("root"), F.col("p").alias("next"))
        mapped = mapping.join(follow, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
        following, following_path = write_scratch(contracted, f"{label}-edges")
        mapping, new_mapping_path = write_scratch(mapped, f"{label}-map")
        for path in (current_path, hooked_path, parents_path, mapping_path):
            if path:
                drop_scratch(spark, path)
        current, current_path, mapping_path = following, following_path, new_mapping_path
    else:
        raise RuntimeError(f"components did not converge in {max_rounds} rounds")
    for path in (current_path, nodes_path if mapping_path else None):
        if path:
            drop_scratch(spark, path)
    return mapping.select("node", F.col("root").alias("component"))
