"""Arcs that stay in place: the same rows as a plain join, hubs in several blocks, no exchange of arcs."""

import os
import re

import pytest
from pyspark.sql import functions as F

from convmem.plans import adjacency, dynamics


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def arcs(spark):
    """One source has nine tenths of all arcs; two arcs are repeated; one has no source."""
    n = spark.range(4000).withColumn("source", F.when(F.col("id") % 10 < 9, F.lit("hub")).otherwise(F.concat(F.lit("n"), F.col("id") % 97)))
    all_arcs = n.select("source", F.concat(F.lit("t"), F.col("id") % 1000).alias("target"), F.concat(F.lit("e"), "id").alias("edge_id"), F.lit("forward").alias("arc_direction"), ((F.col("id") % 9 + 1) / 10.0).alias("effective"))
    again = all_arcs.where("edge_id IN ('e1', 'e10')")
    return all_arcs.unionByName(again).unionByName(again.withColumn("source", F.lit(None).cast("string")))


def test_blocks_give_what_a_join_gives(spark, arcs):
    written = adjacency.write_adjacency(arcs, ["source"], block=100)
    front = spark.createDataFrame([("q1", "hub", 0.5), ("q1", "n9", 0.2), ("q2", "hub", 0.1), ("q2", "nowhere", 0.3), ("q3", None, 1.0)], "qid string, source string, a double")
    want = front.join(arcs, "source").select("qid", "source", "a", "target", "edge_id", "arc_direction", "effective")
    assert _rows(written.of(front)) == _rows(want)
    sizes = written.blocks.groupBy("source").agg(F.count("*").alias("n"), F.max(F.size("_arcs")).alias("most"))
    hub = sizes.where("source = 'hub'").first()
    assert hub["n"] > 30 and hub["most"] < 200
    tasks = written.blocks.where("source = 'hub'").groupBy(F.spark_partition_id()).count().count()
    assert tasks > 1  # a hub's blocks lie in several buckets
    written.drop()
    assert not any(os.path.exists(p.removeprefix("file://")) for p in written.paths) and not spark.catalog.tableExists(written.table)


def test_a_step_shuffles_no_arcs(spark, arcs):
    written = adjacency.write_adjacency(arcs, ["source"], block=100)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        front = spark.range(20).select(F.lit("q").alias("qid"), F.concat(F.lit("n"), "id").alias("source"), F.lit(1.0).alias("a"))
        plan = written.of(front)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan
    scan = plan.index(written.table)
    above = plan[plan.rindex("SortMergeJoin", 0, scan) : scan]
    side = above[above.rindex(":- ") if "+- " not in above else 0 :]
    # The only exchange under the join is the frontier's: one, though both sides are large.
    assert len(re.findall(r"Exchange hashpartitioning", side)) == 1
    written.drop()


def test_iterations_over_own_arcs_and_given_adjacency(spark, arcs):
    """Arcs by query, shared arcs and an adjacency that the caller keeps give one result; empty arcs give the seeds."""
    seeds = spark.createDataFrame([("q1", "hub", 1.0), ("q2", "n9", 2.0)], "qid string, node string, weight double")
    back = arcs.where("source IS NOT NULL").select(F.col("target").alias("source"), F.col("source").alias("target"), F.concat(F.lit("b"), "edge_id").alias("edge_id"), F.lit("reverse").alias("arc_direction"), "effective").dropDuplicates(["edge_id"])
    both = arcs.unionByName(back)
    own = both.join(seeds.select("qid"))
    kept = adjacency.write_adjacency(both, ["source"], block=64)
    config = dynamics.Dynamics(steps=3, flow_floor=0.0)
    found = [_rows(dynamics.best_paths(a, seeds, 5).withColumn("score", F.round("score", 9))) for a in (both, own, kept)]
    assert found[0] == found[1] == found[2] and max(len(r[3]) for r in found[0]) >= 2
    traces = [_rows(dynamics.diffuse(a, seeds, config).select("qid", "step", "node", F.round("a", 9))) for a in (both, own, kept)]
    assert traces[0] == traces[1] == traces[2]
    kept.drop()
    alone = dynamics.best_paths(both.where("1 = 0"), seeds, 2)
    assert _rows(alone) == [("q1", "hub", 1.0, []), ("q2", "n9", 1.0, [])]


@pytest.mark.parametrize("steps", [1, 2, 5, 9])
def test_paths_by_doubling_along_a_chain(spark, steps):
    chain = spark.range(12).select(F.concat(F.lit("n"), "id").alias("source"), F.concat(F.lit("n"), F.col("id") + 1).alias("target"), F.concat(F.lit("e"), "id").alias("edge_id"), F.lit("forward").alias("arc_direction"), F.lit(0.9).alias("effective"))
    seeds = spark.createDataFrame([("q", "n0", 1.0)], "qid string, node string, weight double")
    want = {f"n{i}": [f"e{j}" for j in range(i)] for i in range(steps + 1)}
    assert {r["node"]: r["path"] for r in dynamics.best_paths(chain, seeds, steps).collect()} == want
    config = dynamics.Dynamics(steps=steps, flow_floor=0.0)
    trace = dynamics.diffuse(chain, seeds, config)
    assert {r["node"]: r["path"] for r in dynamics.discovery_paths(chain, trace, config).collect()} == want


def test_few_nodes_go_to_the_arcs_and_many_have_them_dealt(spark, arcs):
    front = spark.createDataFrame([("q1", "hub", 0.5), ("q1", "n9", 0.2), ("q2", "nowhere", 0.3), ("q3", None, 1.0)], "qid string, source string, a double")
    want = _rows(front.join(arcs, "source").select("qid", "source", "a", "target", "edge_id", "arc_direction", "effective"))
    written = adjacency.WrittenArcs(arcs, ["source"], limit=4)
    met = written.of(front)
    assert written.dealt is None and _rows(met) == want
    assert "Exchange hashpartitioning" not in met._jdf.queryExecution().executedPlan().toString()
    assert _rows(written.of(front.unionByName(front))) == sorted(want * 2, key=repr) and written.dealt is not None
    assert _rows(written.of(front)) == want  # once dealt, they are read there
    written.drop()
    assert not os.path.exists(written.path.removeprefix("file://")) and not spark.catalog.tableExists(written.dealt.table)


def test_paths_from_few_seeds_deal_no_arcs(spark, arcs, monkeypatch):
    seeds = spark.createDataFrame([("q1", "hub", 1.0)], "qid string, node string, weight double")
    want = _rows(dynamics.best_paths(arcs, seeds, 2))
    monkeypatch.setattr(adjacency, "write_adjacency", lambda *_: pytest.fail("arcs were dealt"))
    assert _rows(dynamics.best_paths(arcs, seeds, 2)) == want and len(want) > 100
