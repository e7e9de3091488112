"""Topics as streams: several open topics, closing by row, tick, command and timer, restarts, routing."""

from __future__ import annotations

import random

import pytest

from convmem.operators import segment
from convmem.streaming import jobs, topics


def _feed(spark, job, tmp_path, steps, schema=jobs.MESSAGE):
    """Runs a job over steps of rows, each after a restart from the checkpoint; the rows it has put out
    after each step."""
    seen, out = [], []
    for i, rows in enumerate(steps):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        got = jobs.collect_now(job(jobs.message_stream(spark, str(tmp_path / "in"), schema)), "job", str(tmp_path / "state"))
        rows = [tuple(r) for r in got.collect()]
        out.append(sorted(r for r in rows if r not in seen))
        seen = rows
    return out


def test_topics_close_by_row_tick_command_and_timer(spark, tmp_path):
    row = lambda scope, i, t, topic, text="hi": (scope, i, t, 1_000 + t, "p", text, topic)
    steps = [
        [row("a", "1", 0, "x"), row("a", "2", 10, "y"), row("a", "3", 20, "x"), row("b", "4", 25, "z"), row("c", "5", 30, "q"), row("c", None, 35, "q", "close")],
        [row("a", "6", 111, "w")],  # y is due at 110, x at 120
        [row("a", None, 125, None, "tick")],
        [row("d", "7", 400, "v")],  # the others fall silent: timers at 125 (z) and 211 (w)
        [row("a", "8", 401, "x"), row("a", "9", 402, "x"), row("a", "10", 403, "x"), row("d", None, 404, None, "close")],
        [row("e", "11", 5000, "u")],
    ]
    got = _feed(spark, lambda m: topics.lifecycle_stream(m, 100, 250, 3, delay=50), tmp_path, steps)
    got = [[(*r[:3], r[3] - 1_000, r[4] - 1_000, *r[5:]) for r in step] for step in got]
    assert got[0] == [("c", "q", "5", 30, 30, 1, "close")]
    assert got[1] == [("a", "y", "2", 10, 10, 1, "ttl")]
    assert got[2] == [("a", "x", "1", 0, 20, 2, "ttl")]
    assert got[3] == [("a", "w", "6", 111, 111, 1, "ttl"), ("b", "z", "4", 25, 25, 1, "ttl")]
    assert got[4] == [("d", "v", "7", 400, 400, 1, "close")]
    assert got[5] == [("a", "x", "8", 401, 403, 3, "count")]
    state = spark.read.format("statestore").option("path", str(tmp_path / "state" / "job-state")).option("stateVarName", "open").load()
    assert {(r["key"]["scope"], r["user_map_key"]["episode"]) for r in state.collect()} == {("e", "u")}


def test_span_closes_a_busy_topic_by_timer(spark, tmp_path):
    rows = [("a", str(i), i, 1_000 + 20 * i, "p", "hi", "x") for i in range(6)]
    got = _feed(spark, lambda m: topics.lifecycle_stream(m, 100, 150, 99, delay=0), tmp_path, [rows, [("b", "z", 9, 1_160, "p", "hi", "y")]])
    assert got == [[], [("a", "x", "0", 1_000, 1_100, 6, "span")]]


def _log(seed: int, n: int) -> list[tuple]:
    rng = random.Random(seed)
    rows, t = [], 1_000
    for i in range(n):
        t += rng.choice([5, 20, 60]) if rng.random() < 0.97 else 700
        scope = rng.choice("ab")
        text = " ".join(rng.choice([f"topic{k}", f"word{k}", f"other{k}"]) for k in [rng.randrange(14)] for _ in range(3))
        rows.append((scope, i, f"m{i}", t, f"p{rng.randrange(4)}", text, f"m{i - rng.randrange(1, 9)}" if i > 9 and rng.random() < 0.2 else None))
    return rows


@pytest.fixture(scope="module")
def log(spark):
    return _log(7, 400)


def _route(found):
    best = max(s for s, _ in found)
    return (0.2 if best > 0.45 else 0.8), [s for s, _ in found]


def _strict(found):
    return (0.2 if max(s for s, _ in found) > 0.9 else 0.8), [s for s, _ in found]


def test_the_index_equals_a_recomputation(spark, log):
    """Each message's candidates, against sets built anew from the open topics' messages."""
    import math

    frame = spark.createDataFrame(log, jobs.LIVE)
    rows = segment.routed_messages(frame).orderBy("seq").collect()
    index = {s: segment.TopicIndex(600, 2_000, 7) for s in "ab"}
    kept: dict = {"a": {}, "b": {}}
    compared = 0
    for r in rows:
        m = (r["seq"], r["id"], r["t"], r["speaker"], r["reply_to"], r["grams"])
        own = kept[r["scope"]]
        for name in [k for k, v in own.items() if r["t"] - v[-1][2] >= 600 or r["t"] - v[0][2] >= 2_000 or len(v) >= 7]:
            del own[name]
        index[r["scope"]].close(r["t"])
        assert set(index[r["scope"]].topics) == set(own)
        found = index[r["scope"]].candidates(r["grams"], r["speaker"], r["reply_to"])
        table = []
        for name, log_ in own.items():
            views = log_[:1] + log_[1:][-3:]
            in_view = lambda g, views=None: any(g in v[5] for v in views)
            weights = {g: math.log(1 + len(own) / (1 + sum(in_view(g, o[:1] + o[1:][-3:]) for o in own.values()))) for g in r["grams"]}
            share = max(sum(w for g, w in weights.items() if g in v[5]) for v in views) / (sum(weights.values()) or 1)
            table.append((round(share + 0.08 * any(v[3] == r["speaker"] for v in views) + 1000 * any(x[1] == r["reply_to"] for x in log_), 12), log_[-1][0], name))
        assert len(found) == min(8, len(own))
        by_name = {n: s for s, _, n in table}
        assert all(abs(s - by_name[n]) < 1e-9 for s, n in found)
        best, late = sorted(table, reverse=True), sorted(table, key=lambda x: -x[1])[:2]
        if len(own) > 6:
            want = [x[2] for x in best[:6]]
            want += [x[2] for x in late if x[2] not in want]
            want += [x[2] for x in best if x[2] not in want]
            assert [n for _, n in found] == want[:8]
            compared += 1
        name = index[r["scope"]].place(r["scope"], m, _strict, 0.5)
        own.setdefault(name, []).append(m)
    assert compared > 30


def test_closed_topics_leave_nothing_behind(log):
    index = segment.TopicIndex(600, 2_000, 7)
    for scope, seq, ident, t, speaker, text, reply in log:
        index.place(scope, (seq, ident, t, speaker, reply, sorted(set(text.split()))), _route, 0.5)
    assert index.topics and index.close(10**9) and not (index.topics or index.lists or index.holder) and not any(index.authors.values())
    assert index.candidates(["topic1"], "p1", "m1") == []


def test_routing_stream_equals_the_batch(spark, log, tmp_path):
    frame = spark.createDataFrame(log, jobs.LIVE)
    batch = {tuple(r) for r in segment.assign_topics(frame, _route, 600, 2_000, 7).collect()}
    cuts = [0, 90, 91, 260, 400]
    steps = [log[a:b] for a, b in zip(cuts, cuts[1:])]
    got = _feed(spark, lambda m: topics.routing_stream(m, _route, 600, 2_000, 7), tmp_path, [*steps, [("z", 999, "end", log[-1][3] + 9_000, "p", "hi", None)]], jobs.LIVE)
    assert {r for step in got for r in step} == batch | {("z", 999, "end", "topic-z-end")} and len({r[3] for r in batch}) > 20
    state = spark.read.format("statestore").option("path", str(tmp_path / "state" / "job-state")).option("stateVarName", "open").load()
    assert {r["key"]["scope"] for r in state.collect()} == {"z"}


def test_stored_ids_expire_and_outlive_a_restart(spark, tmp_path):
    import time

    from convmem.streaming import dedup

    def run(rows):
        """Feeds rows and stops the query once all have come out: state with a lifetime keeps a query busy."""
        spark.createDataFrame(rows, jobs.MESSAGE).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        stream = dedup.first_text_stream(jobs.message_stream(spark, str(tmp_path / "in")), lifetime=30, parts=1)
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="1 second").start()
        wanted, end, got = {r[2] for r in rows}, time.time() + 60, {}
        while not wanted <= got.keys() and time.time() < end:
            time.sleep(1)
            if (tmp_path / "out" / "_spark_metadata").exists():
                got = {r["arrival"]: r["outcome"] for r in spark.read.schema(dedup.OUTCOME).parquet(str(tmp_path / "out")).collect()}
        query.stop()
        return {i: got.get(i) for i in wanted}

    row = lambda i, arrival, text, scope="s": (scope, i, arrival, 1_000, "p", text, None)
    assert run([row("x", 1, "hi"), row("y", 2, None), row("x", 3, "ho")]) == {1: "first", 2: "first", 3: "conflict"}
    stored = time.time()
    assert run([row("x", 5, "hi"), row("y", 6, None), row("x", 7, "hi", "t")]) == {5: "duplicate", 6: "duplicate", 7: "first"}
    assert {(r["scope"], r["id"]) for r in dedup.stored_ids(spark, str(tmp_path / "state")).collect()} >= {("s", "y"), ("t", "x")}
    time.sleep(max(0, stored + 32 - time.time()))
    assert run([row("x", 8, "other")]) == {8: "first"}
