"""Bounded fusion against the whole of it: copies, limits by speaker, awkward vectors, blocks."""

from __future__ import annotations

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from convmem.operators import recall, vectors
from convmem.plans import recall as plan
from convmem.queries.recall import QUERIES, _rounded


def _world(n: int, seed: int, copies: float = 0.3, groups: bool = False):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, 6))
    v[rng.random(n) < copies] = v[0]  # a group of copies that holds a third of the rows
    rows = pd.DataFrame({"id": [f"n{i:04d}" for i in rng.permutation(n)], "vector": v.tolist()})
    if groups:
        rows["groups"] = [None if i % 5 == 0 else sorted({f"p{i % 3}", f"p{i % 2}"}) for i in range(n)]
    return rows


def _cues(seed: int, queries: int = 4, count: int = 3, allowed: bool = False):
    rng = np.random.default_rng(seed)
    rows = [(f"q|{q}", c, float(rng.choice([0.05, 0.3, 0.5, 1.0])), rng.normal(size=6).tolist()) for q in range(queries) for c in range(count)]
    out = pd.DataFrame(rows, columns=["qid", "cue", "weight", "vector"])
    if allowed:
        out["allowed"] = [None if i % 3 == 0 else ["p2"] if i % 3 == 1 else ["p1", "nobody"] for i in range(len(out))]
    return out


def _frames(spark, cues, rows):
    c = spark.createDataFrame(cues, "qid string, cue int, weight double, vector array<double>" + (", allowed array<string>" if "allowed" in cues else ""))
    return c, spark.createDataFrame(rows, "id string, vector array<double>" + (", groups array<string>" if "groups" in rows else ""))


def _whole(cues: pd.DataFrame, rows: pd.DataFrame) -> dict:
    """{(qid, id): score} by ranking everything, with equal vectors told apart by id only."""
    out: dict = {}
    unit = lambda x: np.asarray(x, float) / np.linalg.norm(x)
    for _, c in cues.iterrows():
        allowed = c.get("allowed")
        free = not isinstance(allowed, list)
        seen = [r for _, r in rows.iterrows() if free or set(allowed) & set(r["groups"] or ())]
        ranked = sorted(seen, key=lambda r: (-round(float(unit(c["vector"]) @ unit(r["vector"])), 12), r["id"]))
        for rank, r in enumerate(ranked, 1):
            out[c["qid"], r["id"]] = out.get((c["qid"], r["id"]), 0) + c["weight"] / (60 + rank)
    return out


def _first(scores: dict, qid: str, first: int) -> list[str]:
    mine = [(-round(s, 12), i) for (q, i), s in scores.items() if q == qid]
    return [i for _, i in sorted(mine)[:first]]


@pytest.mark.parametrize("limited", [False, True])
def test_first_of_fusion(spark, limited):
    rows, cues = _world(900, 1, groups=limited), _cues(2, allowed=limited)
    c, d = _frames(spark, cues, rows)
    got = plan.fuse_first(c, d, 5)
    scores = {(r["qid"], r["id"]): r["score"] for r in got.scores.collect()}
    expected = _whole(cues, rows)
    assert all(abs(expected[k] - v) < 1e-12 for k, v in scores.items())
    for qid in set(cues["qid"]):
        assert _first(scores, qid, 5) == _first(expected, qid, 5)
    # What was read of the rankings does not depend on how many vectors there are.
    depth = plan.fusion_depth(c, 5)
    assert got.listed.count() <= len(cues) * depth < len(cues) * len(rows) / 3


def test_depth_follows_from_weights(spark):
    depth = lambda *w: plan.fusion_depth(spark.createDataFrame([("q", x) for x in w], "qid string, weight double"), 12)
    assert depth(1.0) == 13 and depth(0.0, 1.0) == 13
    assert depth(0.5, 0.5) == 85 and depth(*[0.2] * 5) == 301
    assert depth(1.0, 1e-9) == 13
    # Two lights beside one heavy cue: the lights alone may be the long rankings.
    assert depth(1.0, 0.1, 0.1) == 85


def test_depth_is_enough_where_rankings_are_reversed(spark):
    """The worst case: two cues of one weight rank everything the other way round."""
    angles = np.linspace(0.0, np.pi / 2, 400)
    rows = pd.DataFrame({"id": [f"n{i:03d}" for i in range(400)], "vector": np.stack([np.cos(angles), np.sin(angles)], 1).tolist()})
    cues = pd.DataFrame([("q", 0, 0.5, [1.0, 0.0]), ("q", 1, 0.5, [0.0, 1.0])], columns=["qid", "cue", "weight", "vector"])
    c, d = _frames(spark, cues, rows)
    got = {(r["qid"], r["id"]): r["score"] for r in plan.fuse_first(c, d, 12).scores.collect()}
    assert _first(got, "q", 12) == _first(_whole(cues, rows), "q", 12)


@pytest.mark.parametrize("block", [500, 2])
def test_places_with_copies(spark, block):
    """Also where queries and vectors are dealt into blocks: copies take places by id."""
    rows, cues = _world(300, 3, 0.5), _cues(4, 5, 1)
    c, d = _frames(spark, cues, rows)
    pairs = c.select("qid").crossJoin(d.select("id").where("id < 'n0150'"))
    wanted = vectors.cosine_of(pairs, c, d)
    got = {(r["qid"], r["id"]): r["rank"] for r in vectors.cosine_places(wanted, c, d, block=block, part=70).collect()}
    unit = lambda x: np.asarray(x, float) / np.linalg.norm(x)
    for _, q in cues.iterrows():
        order = sorted((-round(float(unit(q["vector"]) @ unit(r["vector"])), 12), r["id"]) for _, r in rows.iterrows())
        for place, (_, i) in enumerate(order, 1):
            assert i >= "n0150" or got[q["qid"], i] == place


def test_vectors_without_direction(spark):
    rows = pd.DataFrame({"id": ["a", "b", "c", "d", "e"], "vector": [[1.0, 0.0], [0.0, 0.0], None, [float("nan"), 1.0], [1.0, 1.0]]})
    cues = pd.DataFrame([("q", 0, 1.0, [1.0, 0.0]), ("q", 1, 0.5, None), ("q", 2, 0.5, [0.0, 0.0]), ("r", 0, 0.0, [1.0, 0.0])], columns=["qid", "cue", "weight", "vector"])
    c, d = _frames(spark, cues, rows)
    assert {(r["qid"], r["id"]): round(r["score"] * 61 * 62) for r in plan.fuse_first(c, d, 3).scores.collect()} == {("q", "a"): 62, ("q", "e"): 61}
    assert plan.fuse_first(c, d.where("1 = 0"), 3).scores.count() == 0
    assert plan.fuse_first(c.where("1 = 0"), d, 3).scores.count() == 0


@pytest.mark.parametrize("mode", ["query", "maxCue"])
def test_affinity_of_pairs_is_that_of_all(spark, mode):
    c, d = _frames(spark, _cues(6), _world(60, 5))
    pairs = c.select("qid").distinct().crossJoin(d.select("id").where("id < 'n0030'"))
    asked = {(r["qid"], r["id"]): r["affinity"] for r in plan.affinity_of(pairs, c, d, mode).collect()}
    everything = {(r["qid"], r["id"]): r["affinity"] for r in recall.gate_affinity(plan.similarities(c, d), c, mode).collect()}
    assert asked.keys() == {k for k in everything if k[1] < "n0030"}
    assert all(abs(everything[k] - v) < 1e-11 for k, v in asked.items())


def test_whole_fusion_moves_no_pair(spark):
    """No exchange but broadcasts where queries have met vectors, so disk does not grow with the pairs."""
    found = QUERIES["rcl_6_fusion"](spark, "/root/testdata/sf0.001")
    steps = found._jdf.queryExecution().executedPlan().toString().splitlines()
    assert any("MapInArrow" in x for x in steps)
    assert not [x for x in steps if "Exchange" in x and "BroadcastExchange" not in x]
    assert not [x for x in steps if "Window" in x or "Aggregate" in x]


@pytest.mark.parametrize(("part", "held"), [(256, 10_000_000), (7, 1), (7, 4_000)])
def test_whole_fusion(spark, part, held):
    """Copies in many blocks take places by id, however queries are dealt."""
    rows, cues = _world(500, 7, 0.4), _cues(8, 9, 2)
    c, d = _frames(spark, cues, rows)
    got = {(r["qid"], r["id"]): r["score"] for r in vectors.cosine_fused(c, d, part=part, held=held).collect()}
    expected = _whole(cues, rows)
    assert got.keys() == expected.keys()
    assert all(abs(expected[k] - v) < 1e-12 for k, v in got.items())


def test_whole_fusion_of_repeated_rows(spark):
    """Cues and items that are there twice count as in SQL: each row of a cue's vectors meets each of its weights."""
    v = {"a": [1.0, 0.0], "b": [0.8, 0.6], "c": [0.0, 1.0]}
    d = spark.createDataFrame([(i, v[i]) for i in "abca"], "id string, vector array<double>")
    c = spark.createDataFrame([("q", 0, 0.5, v["a"]), ("q", 0, 0.5, v["c"]), ("q", 1, 0.2, v["c"]), ("q", -1, 0.1, v["a"]), ("z", 0, 1.0, [0.0, 0.0])], "qid string, cue int, weight double, vector array<double>")
    ranked = c.alias("x").join(c.alias("y").select("qid", "cue", "weight"), ["qid", "cue"]).select("qid", "cue", F.col("y.weight").alias("weight"), "vector")
    pairs = ranked.where("qid = 'q'").crossJoin(d.withColumnRenamed("vector", "v")).withColumn("score", F.round(vectors.dot(F.col("vector"), F.col("v")), 12))
    expected = {(r["qid"], r["id"]): r["score"] for r in recall.fuse(pairs).collect()}
    got = {(r["qid"], r["id"]): r["score"] for r in plan.fuse_all(c, d).collect()}
    assert got.keys() == expected.keys() == {("q", i) for i in "abc"}
    assert all(abs(expected[k] - x) < 1e-12 for k, x in got.items())


def test_whole_fusion_of_nothing(spark):
    rows = pd.DataFrame({"id": ["a", "b", "c", "d"], "vector": [[1.0, 0.0], [0.0, 0.0], None, [float("nan"), 1.0]]})
    cues = pd.DataFrame([("q", 0, 1.0, [1.0, 0.0]), ("q", 1, 0.5, None), ("q", 2, 0.5, [0.0, 0.0]), ("r", 0, 0.0, [0.0, 1.0])], columns=["qid", "cue", "weight", "vector"])
    c, d = _frames(spark, cues, rows)
    assert {(r["qid"], r["id"], round(r["score"] * 61)) for r in plan.fuse_all(c, d).collect()} == {("q", "a", 1), ("r", "a", 0)}
    assert plan.fuse_all(c, d.where("id <> 'a'")).count() == 0
    assert plan.fuse_all(c.where("1 = 0"), d).count() == 0


def test_shares_join_what_sums_tell_apart():
    """Copies whose similarities differ by the order of a sum are equal, also beside a rounded value's edge."""
    edge = 0.1234567890125
    sims = np.array([[0.5, edge + 2e-16, 0.7, edge - 2e-16, edge + 1e-16]])
    assert np.round(sims[0, 1], 12) != np.round(sims[0, 3], 12)
    assert np.allclose(vectors._shares(sims, np.array([1.0]), 60, 12), 1 / (60 + np.array([2, 3, 1, 4, 5])), atol=1e-15)


def test_score_is_rounded_as_sql_does(spark):
    """0.7 / 320 + 0.3 / 3840 is half of the eighth digit's unit to Spark, and scaled it lies below that."""
    score = 0.7 / 320 + 0.3 / 3840
    wanted = duckdb.sql(f"SELECT round(CAST({score!r} AS DOUBLE), 8)").fetchall()[0][0]
    assert spark.range(1).select(_rounded(F.lit(score), 8).alias("s")).first()["s"] == wanted
