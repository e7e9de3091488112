"""Golden cases of the operators as small tables, and invariants of the iterated ones."""

from __future__ import annotations

import itertools

import pytest
from pyspark.sql import functions as F

from convmem.operators import context, fifo, graph, intake, recall, segment
from convmem.plans import dynamics
from convmem.plans.components import connected_components


def events(spark, n, scope="s", episode="e", step=60):
    return spark.createDataFrame([(scope, episode, f"e{i}", i, i * step, f"text {i}", "u") for i in range(n)], "scope string, episode string, id string, seq bigint, t bigint, text string, speaker string")


@pytest.mark.parametrize(("capacity", "batch", "n", "out", "left"), [
    (6, 3, 10, [["e0", "e1", "e2"], ["e3", "e4", "e5"]], ["e6", "e7", "e8", "e9"]), (6, 1, 10, [["e0"], ["e1"], ["e2"], ["e3"]], ["e4", "e5", "e6", "e7", "e8", "e9"]), (12, 6, 14, [["e0", "e1", "e2", "e3", "e4", "e5"]], [f"e{i}" for i in range(6, 14)]),
])
def test_fifo(spark, capacity, batch, n, out, left):
    e = events(spark, n)
    got = fifo.eviction_payloads(e, capacity, batch).orderBy("eviction").collect()
    assert [r["evicted_ids"] for r in got] == out and all(len(r["context_ids"]) == capacity + 1 - batch for r in got)
    assert fifo.residual_context(e, capacity, batch).first()["context_ids"] == left


def test_fifo_closed_form_equals_a_loop(spark):
    e = events(spark, 37)
    for capacity, batch in itertools.product((1, 3, 7), (1, 2, 3)):
        if batch > capacity:
            continue
        held, gone = [], set()
        for i in range(37):
            held.append(i)
            if len(held) > capacity:
                gone |= set(held[:batch])
                held = held[batch:]
        got = {r["seq"] for r in fifo.eviction_schedule(e, capacity, batch).where("evicted").collect()}
        assert got == gone


def test_dedup_and_late(spark):
    rows = [("s", "a", 1, "x"), ("s", "a", 2, "x"), ("s", "a", 3, "y"), ("s", "b", 4, None), ("s", "b", 5, None)]
    got = intake.dedup(spark.createDataFrame(rows, "scope string, id string, arrival bigint, text string"), ["text"])
    assert [r["outcome"] for r in got.orderBy("arrival").collect()] == ["first", "duplicate", "conflict", "first", "duplicate"]
    late = spark.createDataFrame([("s", 1, 10), ("s", 2, 10), ("s", 3, 9), ("s", 4, 11)], "scope string, n bigint, t bigint")
    assert [r["late"] for r in intake.late_rows(late, "t", ["n"]).orderBy("n").collect()] == [False, False, True, False]
    a = spark.createDataFrame([("x" * 1025, "none"), ("", "unreadable"), ("ok", "none")], "text string, media string")
    assert [r[0] for r in a.select(intake.archive_class(F.col("text"), F.col("media"))).collect()] == ["TEXT_LIMIT", "UNREADABLE_ONLY", None]


def test_windows(spark):
    rows = [("s", f"e{i}", i, f"body{i}", "e0" if i == 3 else ("gone" if i == 4 else None)) for i in range(5)]
    e = spark.createDataFrame(rows, "scope string, id string, seq bigint, text string, reply_to string").withColumns({"speaker": F.lit("u"), "t": F.col("seq")})
    got = {r["id"]: r for r in recall.window_views(e, 1).collect()}
    assert got["e3"]["ids"] == ["e3", "e0", "e2", "e4"] and got["e4"]["ids"] == ["e4", "e3"]
    assert got["e3"]["label"].startswith("u 3：body3\n") and not got["e3"]["clipped"]
    assert {r["id"]: r["clipped"] for r in recall.window_views(e, 1, 15).collect()}["e3"]


def test_fusion_speakers_and_affinity(spark):
    lists = [("q", 1, 0.5, "a", 2.0), ("q", 1, 0.5, "b", 1.0), ("q", 2, 0.25, "b", 2.0), ("q", 2, 0.25, "c", 1.0), ("q", 3, 0.0, "c", 1.0)]
    got = {r["id"]: r["score"] for r in recall.fuse(spark.createDataFrame(lists, "qid string, cue int, weight double, id string, score double")).collect()}
    assert got == pytest.approx({"a": 0.5 / 61, "b": 0.5 / 62 + 0.25 / 61, "c": 0.25 / 62})
    cues = spark.createDataFrame([("q", 1, "what did p_01 say"), ("q", 2, "and p_010?"), ("q", 3, "夜风 said"), ("q", 4, "nobody")], "qid string, cue int, text string")
    speakers = spark.createDataFrame([("p_01",), ("p_010",), ("夜风",)], "speaker string")
    assert {(r["cue"], r["speaker"]) for r in recall.named_speakers(cues, speakers).collect()} == {(1, "p_01"), (2, "p_010"), (3, "夜风")}
    sims = spark.createDataFrame([("q", 0, "d", 0.1), ("q", 0, "t", 0.7), ("q", 1, "d", 0.8), ("q", 1, "t", 0.2), ("q", 2, "d", 0.9)], "qid string, cue int, id string, score double")
    weights = spark.createDataFrame([("q", 0, 1.0), ("q", 1, 0.5), ("q", 2, 0.0)], "qid string, cue int, weight double")
    assert {r["id"]: r["affinity"] for r in recall.gate_affinity(sims, weights, "maxCue").collect()} == {"d": 0.8, "t": 0.7}


def test_selection(spark):
    rows = [("q", "x", "a", 4.0, 50, [1.0, 0.0]), ("q", "x", "b", 3.9, 50, [1.0, 0.01]), ("q", "x", "c", 2.0, 50, [0.0, 1.0])]
    items = spark.createDataFrame(rows, "qid string, arm string, id string, score double, size int, vector array<double>")
    def chosen(i, d):
        return [r["id"] for r in recall.mmr_select(i, 2, 100, d).orderBy("position").collect()]
    assert chosen(items, 0.0) == ["a", "b"] and chosen(items, 0.35) == ["a", "c"]
    longer = items.withColumn("size", F.when(F.col("id") == "a", 150).otherwise(F.col("size")))
    assert chosen(longer, 0.0) == ["b", "c"]
    assert recall.greedy_budget(longer, 2, 100).first()["ids"] == ["b", "c"]


def test_multi_seed_grounding(spark):
    cues = spark.createDataFrame([("q", 0, 1.0), ("q", 1, 1.0)], "qid string, cue int, weight double")
    exact = spark.createDataFrame([("q", 0, "x"), ("q", 1, "y")], "qid string, cue int, id string")
    sims = spark.createDataFrame([], "qid string, cue int, id string, score double")
    plain = {r["node"]: r["weight"] for r in recall.ground_multi(cues, sims, exact, 1).collect()}
    share = {r["node"]: r["weight"] for r in recall.ground_multi(cues, sims, exact, 1, query_share=0.25).collect()}
    assert plain == pytest.approx({"x": 0.5, "y": 0.5}) and share == pytest.approx({"x": 0.25, "y": 0.75})


def test_lifecycle(spark):
    def topics(times, **limits):
        e = spark.createDataFrame([("s", i, t) for i, t in enumerate(times)], "scope string, n bigint, t bigint")
        return [r["topic"] for r in segment.lifecycle(e, **limits).orderBy("n").collect()]
    assert topics([0, 960]) == [1, 2] and topics([0, 899]) == [1, 1] and topics([0, 900]) == [1, 2]
    assert topics([0, 60, 120], span=100) == [1, 1, 2] and topics([0, 1, 2, 3], most=2) == [1, 1, 2, 2]
    e = spark.createDataFrame([("s", "e", "i", 36000)], "scope string, episode string, id string, t bigint")
    assert segment.due_topics(e, 36899).count() == 0 and segment.due_topics(e, 36900).count() == 1


def test_edges_before_combining(spark):
    rows = [("s", "w1", "0-closed", "a", "b", "SIMILARITY", 0.2), ("s", "w2", "1-open-duplicate", "b", "a", "SIMILARITY", 0.9), ("s", "w2", "2-open-causal", "a", "b", "CAUSAL", 0.7), ("s", "w3", "3-failed", "a", "b", "SIMILARITY", 1.0), ("t", "w1", "4-elsewhere", "a", "b", "SIMILARITY", 1.0)]
    edges = spark.createDataFrame(rows, "scope string, write_id string, id string, source string, target string, relation string, strength double").withColumn("evidence", F.array(F.lit("e"), F.col("id")))
    writes = spark.createDataFrame([("s", "w1", "closed", "formation", "COMMITTED"), ("s", "w2", "own", "formation", "COMMITTED"), ("s", "w3", "closed", "formation", "FAILED"), ("s", "w4", "own", "consolidation", "COMMITTED"), ("s", "w5", "own", "consolidation", "FAILED")], "scope string, write_id string, episode string, kind string, status string")
    episodes = spark.createDataFrame([("s", "closed", "legacy", "CLOSED"), ("s", "own", "episode", "OPEN")], "scope string, episode string, lifecycle string, episode_status string")

    def seen(caller, *published):
        pubs = spark.createDataFrame(list(published), "scope string, edge_id string, write_id string")
        return graph.combine_parallel(graph.visible_edges(edges, writes, episodes, pubs, caller)).collect()

    for caller, want in ((None, {("SIMILARITY", 0.2)}), ("foreign", {("SIMILARITY", 0.2)}), ("own", {("SIMILARITY", 0.9), ("CAUSAL", 0.7)})):
        assert {(r["relation"], r["strength"]) for r in seen(caller)} == want
    both = next(r for r in seen("own") if r["relation"] == "SIMILARITY")
    assert both["record_ids"] == ["0-closed", "1-open-duplicate"] and both["id"] == "0-closed" and both["evidence"] == ["0-closed", "1-open-duplicate", "e"]
    assert {r["relation"] for r in seen(None, ("s", "2-open-causal", "w4"))} == {"SIMILARITY", "CAUSAL"}
    assert {r["relation"] for r in seen(None, ("s", "2-open-causal", "w5"), ("t", "2-open-causal", "w4"))} == {"SIMILARITY"}


@pytest.fixture(scope="module")
def network(spark):
    rows = [(f"n{a}", f"n{(a * 7 + k) % 25}", ("CAUSAL", "SIMILARITY", "OPPOSITION")[(a + k) % 3], ((a * 13 + k * 5) % 9 + 1) / 10, f"x{a}-{k}") for a in range(25) for k in (1, 2, 4) if (a * 7 + k) % 25 != a]
    edges = spark.createDataFrame(rows, "source string, target string, relation string, strength double, id string")
    return graph.arcs(edges, {"CAUSAL": 0.3, "SIMILARITY": 0.4, "OPPOSITION": 0.3}, "both").cache()


def test_diffusion_equals_a_fold(spark, network):
    config = dynamics.Dynamics(steps=3, flow_floor=0.0001)
    seeds = spark.createDataFrame([("q", "n0", 2.0), ("q", "n1", 1.0), ("r", "n5", 1.0)], "qid string, node string, weight double")
    trace = dynamics.diffuse(network, seeds, config).cache()
    assert all(r["conserved"] for r in dynamics.conservation(trace).collect())
    out: dict = {}
    for r in network.collect():
        out.setdefault(r["source"], []).append((r["target"], r["effective"]))
    state = initial = {"n0": 2 / 3, "n1": 1 / 3}
    for _ in range(3):
        raw: dict = {}
        for node, a in state.items():
            open_ = [(t, a * e - config.flow_floor) for t, e in out.get(node, []) if a * e > config.flow_floor]
            total = sum(p for _, p in open_)
            sent = min(a * config.max_outflow, total)
            raw[node] = raw.get(node, 0) + a - sent
            for t, p in open_:
                raw[t] = raw.get(t, 0) + sent * p / total
        powered = {k: v**config.gamma for k, v in raw.items()}
        total = sum(powered.values())
        state = {k: (1 - config.anchor) * powered.get(k, 0) / total + config.anchor * initial.get(k, 0) for k in {*powered, *initial}}
    got = {r["node"]: r["a"] for r in trace.where("qid = 'q' AND step = 3").collect()}
    assert got == pytest.approx(state, abs=1e-12)
    paths = {r["node"]: r["path"] for r in dynamics.discovery_paths(network, trace, config).where("qid = 'q'").collect()}
    assert paths["n0"] == [] and set(paths) == {k for k, v in got.items() if v > 0}


def test_gates_and_best_paths(spark, network):
    nodes = network.select(F.col("source").alias("id")).distinct().withColumn("type", F.when(F.col("id") < "n2", "PERSON").otherwise("MEMORY"))
    affinity = nodes.select(F.lit("q").alias("qid"), "id", (F.pmod(F.xxhash64("id"), F.lit(100)) / 100).alias("affinity"))
    for power in (0.0, 1.0, 2.0, 8.0):
        gated = recall.gated_arcs(network.withColumn("qid", F.lit("q")), affinity.where("id <> 'n3'"), nodes.where("id <> 'n4'"), power).cache()
        assert gated.count() == network.count() and gated.where("context_gate < 0.02 OR context_gate > 1").count() == 0
        assert power or gated.where("effective <> base_effective").count() == 0
    seeds = spark.createDataFrame([("q", "n0", 1.0)], "qid string, node string, weight double")
    found = dynamics.best_paths(network, seeds, 2).collect()
    best = {r["node"]: r["score"] for r in found}
    ends = {(r["edge_id"], r["source"], r["target"]): r["effective"] for r in network.collect()}
    for r in found:
        at, score = "n0", 1.0
        for edge in r["path"]:
            at, e = max(((t, e) for (i, s, t), e in ends.items() if i == edge and s == at), key=lambda x: x[1])
            score *= e
        assert at == r["node"] and score == pytest.approx(r["score"])
    arcs = [(r["source"], r["target"], r["effective"]) for r in network.collect()]
    want = {"n0": 1.0}
    for s, t, e in arcs:
        if s == "n0":
            want[t] = max(want.get(t, 0), e)
            for s2, t2, e2 in arcs:
                if s2 == t:
                    want[t2] = max(want.get(t2, 0), e * e2)
    assert best == pytest.approx(want)


def test_judgments(spark):
    rows = [("q", f"{u}{s}{p}", u, s, p, ["a"]) for u in context.UTILITIES for s in ("SUPPORTED", "UNCERTAIN", "UNSUPPORTED") for p in ("INTERNAL_ONLY", "CONTEXTUAL_MENTION", "DO_NOT_USE")]
    j = spark.createDataFrame(rows, "qid string, candidate_id string, utility string, claim_support string, mention_policy string, anchors array<string>")
    out, problems = context.apply_judgments(j, j)
    assert out.where("accepted").count() == 4 and problems.count() == 0 and out.where("disclosure_authorized").count() == 0
    assert context.apply_judgments(j, j.unionByName(j.limit(1)))[1].count() >= 1
    state = spark.createDataFrame([("q", 100)], "qid string, state_length int")
    one = spark.createDataFrame([("q", 1, "m", 1000)], "qid string, position int, id string, length int")
    assert context.pack_context(state, one, 512).first()["ids"] == [] and context.pack_context(state, one, 1200).first()["ids"] == ["m"]


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, 3), (3, 9), (9, 9), (1, 50), (50, 2)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src bigint, dst bigint")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, 3: 3, 7: 3, 9: 3, 1: 1, 2: 1, 50: 1}
    assert connected_components(spark.createDataFrame([], "src bigint, dst bigint")).count() == 0


def test_gate_within_the_steps_equals_gated_arcs(spark, network):
    nodes = network.select(F.col("source").alias("id")).distinct().withColumn("type", F.when(F.col("id") < "n2", "PERSON").otherwise("MEMORY"))
    affinity = nodes.select(F.lit("q").alias("qid"), "id", (F.pmod(F.xxhash64("id"), F.lit(100)) / 100).alias("affinity"))
    seeds = spark.createDataFrame([("q", "n0", 1.0)], "qid string, node string, weight double")
    config = dynamics.Dynamics(steps=2)
    def gate(arcs):
        return recall.gated_arcs(arcs, affinity, nodes)
    all_gated = gate(network.withColumn("qid", F.lit("q"))).cache()
    for run in (lambda arcs, g: dynamics.diffuse(arcs, seeds, config, g).where("step = 2").select("node", F.col("a").alias("x")), lambda arcs, g: dynamics.best_paths(arcs, seeds, 2, g).select("node", F.col("score").alias("x"))):
        assert {r["node"]: r["x"] for r in run(network, gate).collect()} == pytest.approx({r["node"]: r["x"] for r in run(all_gated, None).collect()})
    trace = dynamics.diffuse(network, seeds, config, gate)
    flows = dynamics.diffusion_flows(network, trace, config, gate)
    sent = {r["step"]: r["s"] for r in flows.groupBy("step").agg(F.sum("amount").alias("s")).collect()}
    assert all(0 < v <= config.max_outflow + 1e-12 for v in sent.values()) and set(sent) == {1, 2}
    assert dynamics.emerged(trace, config).where(F.col("a") < config.threshold).count() == 0


MESSAGE = "scope string, episode string, id string, seq bigint, t bigint, speaker string, text string, reply_to string"


def test_recent_topics_that_share_nothing_are_candidates(spark):
    rows = [("s", f"k{i}", f"m{i}", i, 10 * i, f"u{i}", f"weather report {i}", None) for i in range(9)]
    rows += [("s", "quiet", "m9", 9, 90, "x", "zzzz", None), ("s", "silent", "m10", 10, 100, "y", "qqqq", None), ("s", "?", "m11", 11, 110, "z", "weather report 3", "m0"), ("s", "late", "m12", 12, 120, "z", "weather report", None)]
    m = spark.createDataFrame(rows, MESSAGE)
    scores = segment.topic_scores(m.where("id = 'm11'"), m).cache()
    assert {r["episode"]: r["score"] for r in scores.where("score = 0").collect()} == {"quiet": 0.0, "silent": 0.0}
    assert scores.count() == 11 and scores.where("score > 1000").collect()[0]["episode"] == "k0"
    chosen = {r["position"]: r["episode"] for r in segment.choose_candidates(scores).collect()}
    assert chosen[1] == "k0" and chosen[2] == "k3" and {chosen[7], chosen[8]} == {"silent", "quiet"} and len(chosen) == 8
    assert segment.topic_scores(m.where("id = 'm11'"), m, ttl=50).count() == 4


def test_topics_assigned_one_by_one_follow_the_scores(spark):
    from convmem.fixtures import view
    from convmem.functions import hooks

    m = view(spark, "/root/testdata/sf0.001", "f_msg").cache()
    got = segment.assign_topics(m, segment.default_route, 100_000, 200_000, 5).cache()
    placed = m.drop("episode").join(got.select("id", "episode"), "id")
    assert placed.count() == m.count() and placed.groupBy("episode").count().where("count > 5").isEmpty()
    scores = segment.topic_scores(placed, placed, 100_000, 200_000, 5).withColumn("score", F.round("score", 12))
    c = segment.choose_candidates(scores).cache()
    decided = segment.decide(hooks.route_scores(c), c)
    wrong = decided.join(got.withColumnRenamed("id", "target").withColumnRenamed("episode", "_e"), "target").where("(decision = 'CONTINUE' AND episode <> _e) OR (decision = 'NEW' AND NOT endswith(_e, target))")
    assert decided.count() > 20 and wrong.isEmpty()


def test_vectors_in_blocks_equal_one_matrix(spark):
    from convmem.operators.vectors import cosine_topk

    v = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    v = v.unionByName(spark.createDataFrame([(9999, [0.0] * 64), (9998, None)], "id bigint, vector array<float>"))
    q = v.where("id % 20 = 0").withColumnRenamed("id", "qid")
    for k in (5, None):
        one = cosine_topk(q, v, k).select("qid", "id", "rank", F.round("score", 9)).collect()
        many = cosine_topk(q, v, k, block=4, part=60).select("qid", "id", "rank", F.round("score", 9)).collect()
        assert sorted(one) == sorted(many) and len(one) == q.count() * (k or v.count() - 2)


def test_forwarded_titles_and_option_orders(spark):
    import hashlib
    import json
    import random

    from convmem.functions.text import forwarded_titles, option_orders

    texts = ["[合并转发: <?xml version='1.0'?><m><title>a &amp; b</title><x><title>c<i>no</i>tail</title></x></m>]", "[合并转发: <?xml broken]", "no xml", "<?xml version='1.0'?><t><title/></t>", None]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1).orderBy("i").select(forwarded_titles("t")).collect()]
    assert got == ["a & b ; c", "", "", "", None]
    shown = ("[近期上下文]\nP1: hi", ["- 话题 1: P1: hi", "- 话题 2: P2: ho"], "\n[当前消息] P2: x", ["延续话题: P1: hi", "延续话题: P2: ho"])
    seed = int(hashlib.sha256(json.dumps([shown[0], shown[1], shown[2], {"C1": shown[3][0], "C2": shown[3][1]}], ensure_ascii=False).encode()).hexdigest()[:8], 16)
    ranking = [0, 1]
    random.Random(seed).shuffle(ranking)
    row = spark.createDataFrame([shown], "a string, b array<string>, c string, d array<string>").select(option_orders("a", "b", "c", "d").alias("o")).first()["o"]
    assert row["ranking"] == ranking and row["boundary"] == ([1, 0] if seed % 2 else [0, 1])


def test_as_of_ties_and_closing(spark):
    from convmem.operators.formation import close_episodes, reopen_episodes
    from convmem.sources.tables import as_of

    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "z"), ("a", 3, "w"), ("b", 2, None)], "k string, rev int, v string")
    assert {r["k"]: r["v"] for r in as_of(rows, ["k"], 2).collect()} == {"a": "z", "b": None}
    e = spark.createDataFrame([("s", "l", "legacy", "OPEN"), ("s", "c", "consolidate", "OPEN"), ("s", "busy", "legacy", "OPEN"), ("s", "done", "consolidate", "CONSOLIDATED")], "scope string, episode string, lifecycle string, episode_status string")
    events = spark.createDataFrame([("s", "l", True), ("s", "busy", False), ("s", "done", False)], "scope string, episode string, processed boolean")
    nodes = spark.createDataFrame([("s", "l", "n1", "TEMPORARY"), ("s", "c", "n2", "TEMPORARY")], "scope string, episode string, id string, stage string")
    done, refused, promoted = close_episodes(e, events, nodes)
    assert {r["episode"]: r["episode_status"] for r in done.collect()} == {"l": "CLOSED", "c": "SEALED", "done": "CONSOLIDATED"}
    assert [r["episode"] for r in refused.collect()] == ["busy"] and [(r["id"], r["stage"]) for r in promoted.collect()] == [("n1", "LONG_TERM")]
    opened, closed = reopen_episodes(done)
    assert [r["episode"] for r in opened.collect()] == ["c"] and closed.count() == 2


def test_stream_state_expires(spark, tmp_path):
    from convmem.streaming import jobs

    def arrive(name, rows):
        path = tmp_path / "in"
        path.mkdir(exist_ok=True)
        (path / name).write_text("\n".join('{"scope": "s", "id": "%s", "arrival": %d, "t": %d, "text": "%s"}' % r for r in rows))

    def run():
        stream = jobs.dedup_stream(jobs.message_stream(spark, str(tmp_path / "in"), files_per_batch=1), horizon=100)
        return sorted((r["arrival"], r["outcome"]) for r in jobs.collect_now(stream, "d", str(tmp_path / "state")).collect())

    arrive("a.json", [("x", 1, 1000, "hi"), ("y", 2, 1000, "ho")])
    arrive("b.json", [("x", 3, 1050, "hi")])
    assert run() == [(1, "first"), (2, "first"), (3, "duplicate")]
    arrive("c.json", [("z", 4, 5000, "far")])
    assert (4, "first") in run()
    arrive("d.json", [("x", 5, 5001, "hi"), ("z", 6, 5001, "other")])
    assert run()[-2:] == [(5, "first"), (6, "conflict")]
