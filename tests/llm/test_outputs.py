"""Token files, importance resampling and fill-in-middle against brute force, with awkward rows."""

from __future__ import annotations

import hashlib
import math
import re
import tempfile
import zlib

import numpy as np
import pytest

from tests.llm.test_llm import AWKWARD, SCHEMA, SF, key

MORE = [
    (9020, "<P> a mark"), (9021, "cut <S> here"), (9022, "< P> is none, <p> neither"), (-5, "a negative id " * 30), (9023, "w" * 300 + " x " + "y" * 65 + "-z"),
    (9024, "ASCII Ärger ÄRGER ärger É \xa0 "), (9025, "lone words " * 40_000), (9026, "   \t\n"), (9027, "ab" * 140_000), (9028, "word\n"),
] + [(7, "the hot id " * k) for k in range(1, 60)]


@pytest.fixture(scope="module")
def docs(spark):
    odd = spark.createDataFrame(AWKWARD + MORE, SCHEMA)
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(odd)
    return rows.withColumns({"_id": rows["doc_id"] * 0, "ids": rows["text"], "_place": rows["doc_id"] * 0, "start": rows["text"], "rank": rows["text"], "_h1": rows["text"]}).cache()


@pytest.fixture(scope="module")
def texts(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("n,most", [(0, 10), (1, 10), (5, 0), (700, 3), (700, 10**6), (70_000, 40), (1_000, 2**61)])
def test_elias_fano_gives_every_slice_back(n, most):
    from convmem.llm.token_files import EliasFano

    rng = np.random.default_rng(n)
    values = np.sort(rng.integers(-most // 3, most + 1, n)).astype(np.int64)
    data = b"head" + EliasFano.encode(values)
    reads = []

    def read(offset, size):
        reads.append(size)
        return data[offset : offset + size]

    own = EliasFano(read, 4)
    assert own.end == len(data)
    for low, high in [(0, n), *((int(a), int(b)) for a, b in np.sort(rng.integers(0, n + 1, (40, 2)), axis=1))]:
        assert np.array_equal(own.values(low, high), values[low:high])
    if n == 70_000:
        assert len(data) * 8 < n * (2 + 2 + 0.5)  # about two bits and the lower ones a value, no 64-bit table
        reads.clear()
        own.values(40_000, 40_001)
        assert sum(reads) < 400  # a look-up reads a sample and a slice


def _ids(texts, end=2):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    return [(i, [*library.encode(t or "", add_special_tokens=False).ids, end]) for i, t in texts]


def test_token_files_round_trip(spark, docs, texts, empty):
    import public_tokenizers as P

    from convmem.llm.token_files import read_token_ids, token_id_table, write_token_ids

    path = P.path("word_bpe_49k.json")
    want = sorted(((i, np.array(x, "<u4").tobytes()) for i, x in _ids(texts)), key=key)
    for settings in ({}, {"parts": 1}, {"parts": 37, "id_bytes": 4}):
        rows = sorted(((r["start"], r["doc_id"], r["n_tokens"], bytes(r["ids"])) for r in token_id_table(docs, path, **settings).collect()))
        assert sorted(((r[1], r[3]) for r in rows), key=key) == want
        assert [r[0] for r in rows] == np.append(0, np.cumsum([r[2] for r in rows])[:-1]).tolist()
        assert [r[1] for r in rows] == sorted((r[1] for r in rows), key=lambda i: (i is not None, i))
        assert all(4 * r[2] == len(r[3]) for r in rows)
    where = tempfile.mkdtemp(prefix="spark-ids-")
    write_token_ids(empty, path, where)
    assert read_token_ids(spark, where).count() == 0


def test_token_files_split_into_shards_and_slices(spark, texts):
    import json
    import os

    from convmem.llm.token_files import TokenIds, read_token_ids

    spark.dataSource.register(TokenIds)
    rows = [(i, np.arange(n, dtype="<u2").tobytes()) for i, n in enumerate([0, 5, 90, 1, 40, 0, 0, 300, 2] * 30)]
    where = tempfile.mkdtemp(prefix="spark-ids-")
    frame = spark.createDataFrame(rows, "doc_id bigint, ids binary").repartitionByRange(3, "doc_id").sortWithinPartitions("doc_id")
    frame.write.format("token_ids").option("path", where).option("width", 2).option("shard_ids", 500).mode("append").save()
    with open(f"{where}/manifest.json") as f:
        shards = json.load(f)["shards"]
    assert len(shards) > 20 and all(s["ids"] <= 500 or s["docs"] == 1 for s in shards) and sum(os.path.getsize(f"{where}/{s['name']}.ids") for s in shards) == sum(len(r[1]) for r in rows)
    back = read_token_ids(spark, where, read_ids=100)
    assert back.rdd.getNumPartitions() > len(shards)
    assert sorted((r["doc_id"], np.frombuffer(r["ids"], "<u4").astype("<u2").tobytes()) for r in back.collect()) == rows
    with pytest.raises(Exception, match="ascending"):
        frame.orderBy(frame["doc_id"].desc()).write.format("token_ids").option("path", tempfile.mkdtemp(prefix="spark-ids-")).option("width", 2).mode("append").save()


def test_checksums_of_windows():
    from convmem.llm.resampling import shifted, window_buckets, words

    texts = ["one two  three", "", "x", "ä" * 90 + " b " + "c" * 700 + " d e"]
    crc, spaced, length, owner = words(texts)
    bucket, of = window_buckets(crc, spaced, length, owner, 10_007)
    for k, t in enumerate(texts):
        w = t.split()
        assert sorted(bucket[of == k].tolist()) == sorted(zlib.crc32(" ".join(w[i : i + n]).encode()) % 10_007 for n in (1, 2, 3) for i in range(len(w) - n + 1))
    a, b = b"left part", b"r" * 5_000
    assert int(shifted(np.array([zlib.crc32(a)], np.uint32), np.array([len(b)]))[0]) ^ zlib.crc32(b) == zlib.crc32(a + b)


def _resampled(texts, target, percent=5, least=20):
    def buckets(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower().decode())
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]

    own = [(i, *buckets(t)) for i, t in texts]
    s = np.bincount([b for *_, x in own for b in x], minlength=10_000)
    t = np.bincount([b for x in target for b in buckets(x)[1]], minlength=10_000)
    gain = [math.floor(1000 * math.log((b + 1) * (s.sum() + 10_000) / ((a + 1) * (t.sum() + 10_000)))) for a, b in zip(s.tolist(), t.tolist())]
    rows = []
    for i, n, x in own:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(gain[b] for b in x)
        rows.append([i, len(x), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    able = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0]))
    drawn = able[: percent * len(able) // 100]
    return [tuple(r[:4]) for r in rows], [tuple(r[:4]) for r in drawn]


def test_resampling_equals_brute_force(spark, docs, texts, empty):
    from convmem.llm.resampling import resample

    target = spark.read.parquet(f"{SF}/benchmark.parquet")
    want = [r["text"] for r in target.collect()]
    for percent in (5, 100):
        rows, drawn = _resampled(texts, want, percent)
        got = [tuple(r) for r in resample(docs, target, percent=percent).collect()]
        assert sorted((r[:4] for r in got), key=key) == sorted(rows, key=key)
        ranked = sorted((r for r in got if r[4] is not None), key=lambda r: r[4])
        assert [r[4] for r in ranked] == list(range(1, len(drawn) + 1)) and len(drawn) > 5
        assert [r[:4] for r in ranked] == drawn
    assert resample(empty, target).count() == 0
    assert {r["weight"] for r in resample(empty.sparkSession.createDataFrame([(1, None), (1, "")], SCHEMA), empty).collect()} == {0}


def test_fill_in_middle_and_back(docs, texts, empty):
    from pyspark.sql import functions as F

    from convmem.llm.fill_in_middle import fill_in_middle, restored

    want = []
    for i, t in texts:
        t = t or ""
        h = hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
        h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
        u = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", t)
        a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
        p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
        if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
            want.append((i, len(u), "plain", None, None, t, t))
        elif h[3] % 100 < 80:
            want.append((i, len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}", t))
        else:
            want.append((i, len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}", t))
    made = fill_in_middle(docs)
    got = [tuple(r) for r in made.withColumn("again", restored(F.col("output"), F.col("form"))).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert {r[2] for r in got} == {"plain", "spm", "psm"}
    assert fill_in_middle(empty).count() == 0
