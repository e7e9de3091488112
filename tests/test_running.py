"""Running folds: windows and ranges agree with brute force, and a hot key is cut into many tasks."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from convmem.plans import running as plan
from convmem.plans.running import Running, running

SCHEMA = "scope string, kind int, n bigint, t bigint, text string, part string"


def rows_of(seed: int, n: int, hot: float) -> list[tuple]:
    rng = random.Random(seed)
    out = []
    for i in range(n):
        scope = "hot" if rng.random() < hot else rng.choice(["a", "b", None, f"s{rng.randrange(40)}"])
        out.append((scope, rng.choice([1, None]) if scope != "hot" else 1, i, None if rng.random() < 0.1 else rng.randrange(-50, 1000), "x" * (i % 5), "own"))
    rng.shuffle(out)
    return out


def brute(rows: list[tuple]) -> dict:
    out = {}
    groups: dict = {}
    for r in sorted(rows, key=lambda r: r[2]):
        groups.setdefault(r[:2], []).append(r)
    for own in groups.values():
        for i, r in enumerate(own):
            t = [x[3] for x in own[:i]]
            known = [x for x in t if x is not None]
            after = known + ([r[3]] if r[3] is not None else [])
            out[r[2]] = (sum(known), sum(after), len(known), max(known, default=None), max(after, default=None), t[-1] if t else None)
    return out


NAMES = ("s", "si", "c", "m", "mi", "p")


def folds():
    return {
        "s": Running("sum", F.col("t")), "si": Running("sum", F.col("t"), inclusive=True), "c": Running("count", F.col("t")),
        "m": Running("max", F.col("t")), "mi": Running("max", F.col("t"), inclusive=True), "p": Running("previous", F.col("t")),
    }


@pytest.mark.parametrize("key_rows", [10**6, 300])
@pytest.mark.parametrize("hot", [0.9, 0.0])
def test_folds_equal_brute_force(spark, key_rows, hot):
    rows = rows_of(1, 4_000, hot)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = running(df, ["scope", "kind"], ["n"], key_rows, **folds())
    assert got.columns == [*df.columns, *NAMES]
    assert {r["n"]: tuple(r[c] for c in NAMES) for r in got.collect()} == brute(rows)


def test_a_hot_key_is_cut_into_many_tasks(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(plan, "scratch", lambda df, label, write=plan.scratch: kept.append(write(df, label)) or kept[-1])
    df = spark.createDataFrame(rows_of(2, 20_000, 0.9), SCHEMA)
    running(df, ["scope"], ["n"], 1_000, s=folds()["s"]).count()
    local, carry = kept
    sizes = [r["count"] for r in local.groupBy(local.columns[-3]).count().collect()]
    assert len(sizes) >= 20 and max(sizes) <= 4_000 and carry.count() <= len(sizes)


def test_empty_table_and_small_batches(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert running(empty, ["scope"], ["n"], 0, **folds()).count() == 0
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = rows_of(3, 500, 0.7)
        got = running(spark.createDataFrame(rows, SCHEMA), ["scope", "kind"], ["n"], 50, **folds())
        assert {r["n"]: tuple(r[c] for c in NAMES) for r in got.collect()} == brute(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_operators_on_a_hot_scope(spark, monkeypatch):
    """Every operator that folds a scope gives the same rows where 90 % of them are in one scope."""
    from convmem.operators import fifo, intake, recall, segment

    rng = random.Random(4)
    rows, t = [], 0
    for i in range(3_000):
        t += rng.choice([0, 1, 30, 100])
        scope = "hot" if rng.random() < 0.9 else f"s{rng.randrange(5)}"
        rows.append((scope, f"e{rng.randrange(3)}" if scope != "hot" else "one", f"m{i}", i, t, rng.randrange(4_000), f"w{i % 7}", "x" * (i % 9) if i % 50 else None, f"m{i - 1}" if i % 4 == 0 and i else None))
    m = spark.createDataFrame(rows, "scope string, episode string, id string, seq bigint, t bigint, k int, speaker string, text string, reply_to string").withColumn("n", F.col("seq")).repartition(4).cache()
    stamped = m.withColumn("at", F.timestamp_seconds("k"))
    made = {
        "sequence": lambda: intake.sequence_errors(m, "k", "seq"),
        "late": lambda: intake.late_rows(m, "k", ["seq"]),
        "late, archived": lambda: intake.late_rows(stamped, "at", ["seq"], F.col("seq") % 3 == 0),
        "quota": lambda: intake.over_quota(m, 500, 2_000),
        "evictions": lambda: fifo.eviction_schedule(m),
        "windows": lambda: recall.window_views(m),
        "lifecycle": lambda: segment.lifecycle(m, 100, 400, 6),
        "gaps": lambda: segment.lifecycle_by_gap(m, 100),
    }
    plain = {name: sorted(map(repr, make().collect())) for name, make in made.items()}
    monkeypatch.setattr(plan, "KEY_ROWS", 400)
    written = []
    monkeypatch.setattr(plan, "scratch", lambda df, label, write=plan.scratch: written.append((label, write(df, label))) or written[-1][1])
    for name, make in made.items():
        assert sorted(map(repr, make().collect())) == plain[name] and plain[name], name
    locals_ = [df for label, df in written if label == "running"]
    assert len(locals_) >= len(made)
    for df in locals_[:4]:
        part = next(c for c in df.columns if c.lstrip("_") == "part")
        assert max(r["count"] for r in df.groupBy(part).count().collect()) < 1_500
