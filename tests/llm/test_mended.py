"""Contracts at their edges: languages of odd texts, remembered words, one prediction a text."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest

SF = "/root/testdata/sf0.001"
#: Texts without a letter, and with few.
ODD = [(1, "½ ½ ²"), (2, "Ⅷ Ⅸ"), (3, "12 _ 3!"), (4, "\U0001f600"), (5, None), (6, ""), (7, "a"), (8, "é!"), (9, "\U0001d400"), (10, "und " * 300_000), (11, "日本")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").cache()


def test_language_of_texts_with_few_letters_or_none(spark, docs):
    from convmem.llm.language_id import identify

    odd = spark.createDataFrame(ODD, "doc_id bigint, text string").selectExpr("doc_id + 100000 AS doc_id", "text", "CAST(null AS string) AS lang")
    rows = docs.unionByName(odd)
    rows = rows.withColumns({"held_out": rows["doc_id"], "score": rows["text"], "_p": rows["text"], "lang_pred": rows["text"]})
    got = {r["doc_id"] - 100_000: (r["lang_pred"], r["score"]) for r in identify(rows).where("doc_id > 100000").collect()}
    assert {i for i, (lang, _) in got.items() if lang == "und"} == {1, 2, 3, 4, 5, 6}
    assert all(0 <= s <= 1 for _, s in got.values()) and all(got[i][1] == 0 for i in (1, 2, 3, 4, 5, 6)) and got[10][0] == "de"
    assert identify(rows.limit(0)).count() == 0


def test_language_filter_against_exact_sets(docs):
    """What the bit-sliced filter counts, against sets of n-grams learned by the stated rule."""
    from convmem.llm.language_id import fit, grams

    rows = [(r["lang"], r["text"]) for r in docs.collect()]
    model = fit(docs, "text", "lang")
    distinct = {(lang, text) for lang, text in rows if lang and text is not None}
    sizes = Counter(lang for lang, _ in distinct)
    n = Counter((g, lang) for lang, text in distinct for g in np.unique(grams(text)).tolist())
    rate = {k: v / sizes[k[1]] for k, v in n.items()}
    top: dict = {}
    for (g, _), r in rate.items():
        top[g] = max(top.get(g, 0), r)
    held = {lang: {g for (g, x), r in rate.items() if x == lang and r >= 0.002 and r >= 0.5 * top[g]} for lang in model.languages}
    for _, text in rows:
        own = grams(text or "")
        exact = np.array([sum(g in held[lang] for g in own.tolist()) for lang in model.languages], float)
        found, total = model.hits(text or "")
        assert total == len(own) and (found >= exact).all()
        true = (found - total * model.false_positive) / (1 - model.false_positive)
        assert np.abs(true - exact).max() <= 0.03 * total + 5
        best = np.sort(exact)
        if text and total and best[-1] - best[-2] > 0.1 * total:
            assert model.predict(text)[0] == model.languages[int(np.argmax(exact))]
    alike = [model.predict(t) for t in ("zz", "zz")]
    assert alike[0] == alike[1]


def test_language_ties_go_to_the_first_name(spark):
    from convmem.llm.language_id import fit

    rows = [(lang, f"same words for both {i}") for lang in ("b", "a") for i in range(50)]
    assert fit(spark.createDataFrame(rows, "lang string, text string"), "text", "lang").predict("same words")[0] == "a"


def test_bpe_remembers_short_words_only():
    import public_tokenizers as P

    from convmem.llm import bpe

    own = bpe.Encoder(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    rng = np.random.default_rng(5)
    long = ["".join(map(chr, rng.integers(0x4E00, 0x9FFF, 20_000))) for _ in range(6)]
    first = own.encode([*long, "short words stay", *long])
    assert sum(map(len, own.known_ids)) < 100 and len(own.known_ids) == 3
    assert first[:6] == first[7:] == own.encode(long)
    many = [" ".join(f"w{i:x}" for i in range(k, k + 40_000)) for k in range(0, 400_000, 40_000)]
    for text in many:
        own.encode([text])
    assert len(own.known_ids) <= bpe._CACHE + 40_000


def test_bpe_slices_cover_a_batch():
    import pyarrow as pa

    from convmem.llm.bpe import _slices

    texts = ["a" * n for n in (0, 3, 1 << 21, 5, 1 << 19, 1 << 19, 1, 0)] + ["x"] * 1500
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["t"])
    parts = [s.column("t").to_pylist() for s in _slices(batch, "t")]
    assert sum(parts, []) == texts and all(len(p) <= 512 and (len(p) == 1 or sum(map(len, p)) <= 1 << 20) for p in parts)


def test_pipeline_predicts_each_text_once(spark):
    import contextlib
    import io

    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        corpus_pipeline.by_language(spark, docs, SF).explain()
    assert out.getvalue().count("MapInArrow") == 1 and "ArrowEvalPython" not in out.getvalue()
