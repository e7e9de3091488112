"""Lexical search against brute force, in one block of queries and in many."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest

from convmem.operators import lexical


def _tokens(text):
    w = re.findall("[a-z0-9_]+|[㐀-鿿]", (text or "").lower())
    return Counter(w + [a + b for a, b in zip(w, w[1:])])


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)] + ["same"] * 20 + ["天", "地"]
    made = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 40))) for _ in range(500)]
    return [*enumerate(made), (500, None), (501, ""), (502, "!!!"), (503, "Same SAME same"), (504, made[0]), (505, made[0])]


@pytest.mark.parametrize("k", [None, 3])
@pytest.mark.parametrize("entries", [10**6, 150])
def test_search_equals_brute_force(spark, texts, k, entries):
    queries = [(f"q{i}", t) for i, t in texts[::15]] + [("none", None), ("other", "absent tokens"), ("twin", texts[0][1])]
    want = []
    for q, qt in queries:
        a, rows = _tokens(qt), []
        for i, t in texts:
            b = _tokens(t)
            dot = sum(n * b[w] for w, n in a.items())
            if dot and (s := dot / (math.sqrt(sum(n * n for n in a.values())) * math.sqrt(sum(n * n for n in b.values())))) >= 0.2:
                rows.append((-round(s, 9), i))
        want += [(q, i, -s, r + 1) for r, (s, i) in enumerate(sorted(rows)[:k])]
    made = lexical.search(spark.createDataFrame(queries, "qid string, text string"), spark.createDataFrame(texts, "id int, text string").repartition(5), "qid", "id", 0.2, k, entries)
    got = [(r["qid"], r["id"], round(r["score"], 9), r["rank"]) for r in made.collect()]
    assert not sorted(set(want) - set(got))[:5] and not sorted(set(got) - set(want))[:5]
    assert sorted(got) == sorted(want) and len(want) > 50


def test_search_of_nothing(spark, texts):
    some = spark.createDataFrame(texts[:5], "id int, text string")
    asked = spark.createDataFrame([("q", "same w1")], "qid string, text string")
    assert lexical.search(asked.limit(0), some, "qid", "id").count() == 0
    assert lexical.search(asked, some.limit(0), "qid", "id", k=3).count() == 0
    assert lexical.search(spark.createDataFrame([("q", "?")], "qid string, text string"), some, "qid", "id").count() == 0


def test_few_pairs_leave_the_tasks():
    """With k, what leaves a task follows its queries, not the pairs that reach min_score."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(1)
    best, whole = lexical._Best(50, 0.01, 2, pa.int64()), []
    best.most = 1_000
    for i in range(40):
        scores = np.round(rng.random((100, 50)), 3)
        whole.append(scores)
        best.add(scores, pa.array(range(100 * i, 100 * i + 100)))
        if best.size > best.most:
            best.shrink()
    best.shrink()
    query, ids, score = best.take()
    assert len(query) < 1_000 and best.floor.min() > 0.99
    whole = np.concatenate(whole)
    for q in range(50):
        top = np.sort(whole[:, q])[-2]
        assert set(ids.to_numpy()[query == q]) == set(np.flatnonzero(whole[:, q] >= top))


def test_rerank_tells_texts_apart(spark):
    pairs = spark.createDataFrame([("a b", "a b"), ("a b", "b a"), ("a b", "a b"), ("x", "y"), ("", "a")], "query string, text string")
    got = {(r["query"], r["text"]): round(r["score"], 6) for r in lexical.cosine(pairs).collect()}
    assert got == {("a b", "a b"): 1.0, ("a b", "b a"): round(2 / 3, 6), ("x", "y"): 0.0, ("", "a"): 0.0}
