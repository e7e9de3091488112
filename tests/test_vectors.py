"""Vectors in blocks: bounded batches, ties at either end, copies, several vectors of a query, rounds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from convmem.operators import vectors


def _some(spark, rng, n, name, copies=1):
    v = rng.integers(-3, 4, (n, 8)).astype(float)
    rows = [(f"{name}{i:03}", v[i // copies].tolist()) for i in range(n)]
    return spark.createDataFrame(rows, "id string, vector array<double>"), {i: np.array(x) for i, x in rows}


def _cosine(a, b):
    return float(a @ b / np.sqrt((a @ a) * (b @ b)))


def test_ties_at_either_end_and_copies(spark, monkeypatch):
    rng = np.random.default_rng(5)
    d, have = _some(spark, rng, 240, "d", copies=30)
    q, asked = _some(spark, rng, 25, "q")
    monkeypatch.setattr(vectors, "BLOCKS", 2)  # several rounds of queries
    for largest in (False, True):
        got = {}
        for r in vectors.cosine_topk(q.withColumnRenamed("id", "qid"), d, 7, block=4, part=50, digits=10, largest=largest).collect():
            got.setdefault(r["qid"], []).append((r["rank"], r["id"]))
        for name, x in asked.items():
            order = sorted(((round(_cosine(x, y), 10), i) for i, y in have.items() if y.any()), key=lambda s: s[1], reverse=largest) if x.any() else []
            order.sort(key=lambda s: -s[0])
            assert [i for _, i in sorted(got.get(name, []))] == [i for _, i in order[:7]]


def test_best_of_several_vectors_of_a_query(spark):
    rng = np.random.default_rng(6)
    d, have = _some(spark, rng, 90, "d")
    cues = [(f"q{i % 5}", rng.integers(-3, 4, 8).astype(float).tolist()) for i in range(11)] + [("q9", [0.0] * 8)]
    got = {(r["qid"], r["id"]): r["score"] for r in vectors.cosine_best(spark.createDataFrame(cues, "qid string, vector array<double>"), d, block=2, part=40).collect()}
    want = {}
    for qid, x in cues[:-1]:
        for i, y in have.items():
            if y.any():
                want[qid, i] = max(want.get((qid, i), -2.0), _cosine(np.array(x), y))
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-9 for p in want)


def test_all_similarities_leave_a_task_in_bounded_batches(spark, monkeypatch):
    """Before, a task put out all pairs of 2,000 queries and a batch of vectors at once."""
    q = spark.range(300).select(F.concat(F.lit("q"), "id").alias("qid"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("vector"))
    d = spark.range(1000).select(F.concat(F.lit("d"), "id").alias("id"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("vector"))
    sizes, plain = spark.sparkContext.accumulator(0), vectors._nearest

    def watched(*args):
        run = plain(*args)

        def task(batches):
            for batch in run(batches):
                sizes.add(int(batch.num_rows > 200_000))
                yield batch

        return task

    monkeypatch.setattr(vectors, "_nearest", watched)
    assert vectors.cosine_topk(q, d, None).count() == 300_000 and sizes.value == 0


def test_every_arc_is_gated_for_every_query(spark, monkeypatch):
    """rcl_12_gate read the arcs of the fifty nearest nodes of a query only."""
    from convmem.operators import recall

    rng = np.random.default_rng(8)
    space, have = _some(spark, rng, 60, "n")
    nodes = space.selectExpr("id", "CASE WHEN id LIKE '%3' THEN 'PERSON' ELSE 'MEMORY' END AS type").where("id NOT LIKE '%5'")
    pairs = sorted({(f"n{a:03}", f"n{b:03}") for a, b in rng.integers(0, 70, (150, 2)).tolist()})
    arcs = spark.createDataFrame([(a, b, 0.5) for a, b in pairs], "source string, target string, effective double")
    asked = {f"q{i}": rng.integers(-3, 4, 8).astype(float) for i in range(5)} | {"q7": np.zeros(8)}
    queries = spark.createDataFrame([(i, x.tolist()) for i, x in asked.items()], "qid string, vector array<double>")
    monkeypatch.setattr(recall, "ARCS", 40)
    affinity = spark.createDataFrame([(i, n, _cosine(x, y)) for i, x in asked.items() for n, y in have.items() if x.any() and y.any()], "qid string, id string, affinity double")
    plain = recall.gated_arcs(arcs.crossJoin(queries.select("qid")), affinity, nodes)
    rows = lambda d: {(r["qid"], r["source"], r["target"]): round(r["effective"], 9) for r in d.collect()}
    got = recall.gated_for_all(arcs, queries, space, nodes)
    assert rows(got) == rows(plain) and got.count() == 6 * len(pairs)
