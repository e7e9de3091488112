"""Topic scores: bigrams as numbers, each step made once, views without text."""

import math
import random

from pyspark.sql import functions as F

from convmem.functions.text import bigram_codes, bigrams
from convmem.operators import segment
from convmem.queries import segment as queries

MESSAGE = "scope string, episode string, id string, seq bigint, t bigint, speaker string, text string, reply_to string"


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_codes_stand_for_bigrams(spark):
    texts = spark.createDataFrame([("ab  cab",), ("",), ("x",), (None,), ("é話 😀a😀a\u0000b ",), ("\n\n a",)], "text string")
    for r in texts.select(bigrams(F.col("text")).alias("a"), bigram_codes(F.col("text")).alias("b")).collect():
        assert r["a"] == (r["b"] and [chr(x >> 21) + chr(x & (1 << 21) - 1) for x in r["b"]])


def test_a_view_without_text_hides_no_other(spark):
    rows = [("s", "k", "m0", 0, 0, "u", "weather", None), ("s", "k", "m1", 1, 1, "u", None, None), ("s", "o", "m2", 2, 2, "u", "zz", None), ("s", "?", "m3", 3, 3, "v", "weather", "m0"), ("s", "n", "m4", 4, 4, "v", None, None)]
    m = spark.createDataFrame(rows, MESSAGE)
    got = {(r["target"], r["episode"]): r["score"] for r in segment.topic_scores(m, m).collect()}
    assert got["m3", "k"] == 1001.0 and got["m3", "o"] == 0.0 and got["m4", "?"] == 0.08 and got["m4", "k"] == 0.0


def test_shares_equal_a_recomputation(spark):
    """More targets than are weighed at a time, some without bigrams, episodes or shared bigrams."""
    rng = random.Random(3)
    rows = []
    for i in range(segment.WEIGHED + 90):
        size = rng.randrange(9)
        rows.append((i, size, [[[g << 21 for g in range(size) if rng.random() < 0.5] for _ in range(rng.randrange(1, 5))] for _ in range(rng.randrange(5))]))
    frame = spark.createDataFrame(rows, "i int, size int, s array<array<array<bigint>>>").coalesce(1)
    got = {r["i"]: r["x"] for r in frame.select("i", segment.best_shares("size", F.size("s"), "s").alias("x")).collect()}
    for i, size, s in rows:
        weight = {g << 21: math.log(1 + len(s) / (1 + sum(any(g << 21 in v for v in e) for e in s))) for g in range(size)}
        want = [max(sum(weight[g] for g in v) for v in e) / (sum(weight.values()) or 1) for e in s]
        assert len(got[i]) == len(want) and all(abs(a - b) < 1e-12 for a, b in zip(got[i], want))


def test_a_state_outlives_its_interval_only_if_nothing_follows(spark):
    """An episode that goes on in the next interval is found by its last state alone, and by the one before up to there."""
    rows = [("s", "k", "m0", 0, 10, "u", "ab", None), ("s", "k", "m1", 1, 95, "u", "cd", None), ("s", "?", "m2", 2, 104, "v", "cd", None), ("s", "k", "m3", 3, 110, "u", "ef", None), ("s", "?", "m4", 4, 190, "v", "ef", None), ("s", "!", "m5", 5, 205, "v", "ef", None)]
    m = spark.createDataFrame(rows, MESSAGE)
    got = {(r["target"], r["episode"], r["last_seq"]) for r in segment.topic_scores(m, m, ttl=100, span=1_000).collect()}
    assert {x for x in got if x[1] == "k"} == {("m1", "k", 0), ("m2", "k", 1), ("m3", "k", 1), ("m4", "k", 3), ("m5", "k", 3)}


def test_targets_meet_states_once(spark):
    m = spark.createDataFrame([("s", "k", "m0", 0, 10, "u", "ab", None)], MESSAGE)
    joins = [line for line in _plan(segment.topic_scores(m, m)).splitlines() if " Join " in line or line.startswith("Join ")]
    assert sum("_cell" in line for line in joins) == 1


def test_decisions_read_written_candidates(spark):
    for name in ("seg_10_decide", "seg_11_decision_check"):
        plan = _plan(queries.QUERIES[name](spark, "/root/testdata/sf0.001"))
        assert "Window" not in plan and "ArrowEvalPython" not in plan and "Join" in plan


def test_no_more_of_candidates_texts_is_moved_than_shown(spark):
    """A candidate's message of 500 characters is shown with 40 and quoted with 80, and no more of it leaves for its target."""
    long = "".join(chr(0x4E00 + i) for i in range(500))
    targets = spark.createDataFrame([("m9", "u", "yes", "m0")], "target string, speaker string, text string, reply_to string")
    context = spark.createDataFrame([], "target string, pos bigint, id string, speaker string, text string")
    said = "array<struct<id: string, speaker: string, text: string>>"
    candidates = spark.createDataFrame([("m9", 1, "k", ["m0"], [("m0", "v", long)], [("m0", "v", long)])], f"target string, position int, episode string, member_ids array<string>, first {said}, recent {said}")
    features = segment.router_features(targets, context, candidates)
    got = features.first()
    assert f"P1: {long[:80]}\n" in got["ranking_state"] and got["choices"][0].endswith(f"P1: {long[:40]}")
    gathered = [line for line in _plan(features).splitlines() if "collect_list(" in line and "member_ids" in line]
    assert len(gathered) == 1 and "substring" in gathered[0]
