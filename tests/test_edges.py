"""Visible edges: few writes hold all edges, and no task gets those of one write."""

import re

import pytest

from convmem.operators import graph


@pytest.fixture
def shuffled_joins(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_edges_are_not_dealt_by_their_writes(spark, shuffled_joins):
    edges = spark.range(4_000).selectExpr("'s' AS scope", "concat('w', id % 4) AS write_id", "concat('e', id) AS id", "'a' AS source", "'b' AS target")
    writes = spark.createDataFrame([("s", "w0", "k0", "formation", "COMMITTED"), ("s", "w1", "k1", "formation", "COMMITTED"), ("s", "w2", "k2", "formation", "FAILED"), ("s", "w3", "nowhere", None, "COMMITTED"), ("s", "c", "k1", "consolidation", "COMMITTED")], "scope string, write_id string, episode string, kind string, status string")
    episodes = spark.createDataFrame([("s", "k0", "legacy", "CLOSED"), ("s", "k1", "legacy", None), ("s", "k2", "legacy", "CLOSED")], "scope string, episode string, lifecycle string, episode_status string")
    pubs = spark.createDataFrame([("s", "e1", "c"), ("s", "e1", "c"), ("s", "e2", "c"), ("s", "e3", "w1"), ("s", "e7", "c"), ("t", "e5", "c")], "scope string, edge_id string, write_id string")
    seen = graph.visible_edges(edges, writes, episodes, pubs)
    own = {f"e{i}" for i in range(0, 4_000, 4)}
    assert sorted(r["id"] for r in seen.collect()) == sorted(own | {"e1", "e7"})
    assert {r["id"] for r in graph.visible_edges(edges, writes, episodes, pubs, "k1").collect()} == own | {f"e{i}" for i in range(1, 4_000, 4)} | {"e7"}
    plan = seen._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan)
    assert dealt and not any("write_id" in keys or "episode" in keys for keys in dealt)
