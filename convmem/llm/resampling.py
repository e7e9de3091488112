"""Importance resampling towards a target distribution of hashed n-grams."""

from __future__ import annotations

import gc
import math
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from convmem.llm.batches import released
from convmem.plans.scratch import ScratchTables

BUCKETS = 10_000
#: Words of a feature at most.
ORDER = 3
#: A word: everything but ASCII characters that are no digit or letter; and what lies between words.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_BETWEEN = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
#: Characters of a text that are pre-tokenised at once, and those of a group of texts whose features are made at once.
_PART, _GROUP = 1 << 17, 1 << 19
#: Lengths up to which one table look-up a byte moves a checksum on.
_DIRECT = 64


@lru_cache(maxsize=1)
def splitter():
    """An untrained pre-tokenizer that keeps the pattern's matches, with their places."""
    from tokenizers import Regex, pre_tokenizers

    return pre_tokenizers.Split(Regex(WORD), behavior="removed", invert=True)


@lru_cache(maxsize=1)
def _shift_tables() -> tuple[np.ndarray, np.ndarray]:
    """What becomes of each byte of a CRC-32 when 0, 1, 2, … zero bytes follow; and 1, 2, 4, … ones."""
    byte = np.arange(256, dtype=np.uint32)
    step = np.array([zlib.crc32(bytes([b])) for b in range(256)], np.uint32)
    step ^= step[0]  # the checksum's register alone, without its start and end values
    direct = [np.stack([byte << np.uint32(8 * j) for j in range(4)])]
    for _ in range(_DIRECT):
        direct.append(step[direct[-1] & 255] ^ (direct[-1] >> np.uint32(8)))
    doubled = [direct[1]]
    for _ in range(31):
        doubled.append(_apply(doubled[-1], doubled[-1]))
    return np.stack(direct), np.stack(doubled)


def _apply(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return table[0][crc & 255] ^ table[1][(crc >> np.uint32(8)) & 255] ^ table[2][(crc >> np.uint32(16)) & 255] ^ table[3][crc >> np.uint32(24)]


def shifted(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The part of crc in the CRC-32 of a text that goes on for `length` bytes: the checksum of two
    texts in a row is shifted(first's, second's length) ^ second's."""
    direct, doubled = _shift_tables()
    near = np.minimum(length, _DIRECT)
    flat, base = direct.reshape(-1), near.astype(np.int64) * 1024
    out = flat[base + (crc & 255)] ^ flat[base + 256 + ((crc >> np.uint32(8)) & 255)] ^ flat[base + 512 + ((crc >> np.uint32(16)) & 255)] ^ flat[base + 768 + (crc >> np.uint32(24))]
    rest = length - near
    for bit in range(32) if rest.any() else ():
        on = (rest >> bit) & 1 == 1
        out[on] = _apply(doubled[bit], out[on])
    return out


def _parts(text: str) -> Iterator[str]:
    """The text in parts that end between words."""
    low = 0
    while len(text) - low > _PART:
        cut = _BETWEEN.search(text, low + _PART)
        if cut is None:
            break
        yield text[low : cut.end()]
        low = cut.end()
    yield text[low:]


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(CRC-32 of each word, of each word with a blank before it, words' lengths in bytes, their
    texts' numbers) of ASCII-lowered texts. Each distinct word is hashed once."""
    names: list[str] = []
    places: list[tuple[int, int]] = []
    sizes = []
    gc.disable()  # nothing here is cyclic, and collections walk all the words' tuples
    try:
        for text in texts:
            before = len(names)
            for part in _parts(text):
                if found := splitter().pre_tokenize_str(part):
                    own, at = zip(*found, strict=True)
                    names += own
                    places += at
            sizes.append(len(names) - before)
    finally:
        gc.enable()
    numbered = {w: i for i, w in enumerate(dict.fromkeys(names))}
    number = np.fromiter(map(numbered.__getitem__, names), np.int64, len(names))
    distinct = [w.encode() for w in numbered]
    pairs = np.fromiter(chain.from_iterable(places), np.int64, 2 * len(places))
    # Places count characters; what the distinct words' other bytes add is looked up.
    more = np.array([len(w) - n for w, n in zip(distinct, map(len, numbered), strict=True)], np.int64)
    length = pairs[1::2] - pairs[::2] + more[number]
    crc = np.array([zlib.crc32(w) for w in distinct], np.uint32)
    spaced = np.array([zlib.crc32(w, zlib.crc32(b" ")) for w in distinct], np.uint32)
    return crc[number], spaced[number], length, np.repeat(np.arange(len(texts)), sizes)


def window_buckets(crc: np.ndarray, spaced: np.ndarray, length: np.ndarray, text: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text's number) of every run of 1 to ORDER words within a text, in order of the texts. A window grows by one
    word to the right; its checksum goes on over a blank and that word."""
    found, owner = [crc % np.uint32(buckets)], [text]
    window = crc
    for k in range(1, ORDER):
        if len(crc) <= k:
            break
        window = shifted(window[:-1], length[k:] + 1) ^ spaced[k:]
        inside = text[k:] == text[:-k]
        found.append(window[inside] % np.uint32(buckets))
        owner.append(text[k:][inside])
    place = np.argsort(np.concatenate(owner), kind="stable")
    return np.concatenate(found)[place], np.concatenate(owner)[place]


def _features(buckets: int):
    kind = np.dtype("<u2") if buckets <= 1 << 16 else np.dtype("<u4")

    def group(ids: list, texts: list[str], types: pa.DataType) -> pa.RecordBatch:
        crc, spaced, length, text = words(texts)
        bucket, owner = window_buckets(crc, spaced, length, text, buckets)
        counts = np.bincount(owner, minlength=len(texts))
        ends = np.cumsum(counts)
        data = bucket.astype(kind)
        own = [data[end - n : end].tobytes() for end, n in zip(ends, counts, strict=True)]
        sizes = np.bincount(text, minlength=len(texts))
        return pa.RecordBatch.from_arrays([pa.array(ids, types), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array(own, pa.binary())], names=["_id", "_words", "_n", "_buckets"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, size = [], [], 0
            for i, text in zip(batch.column("_id"), batch.column("_text"), strict=True):
                # Bytes lower ASCII letters only.
                texts.append(text.as_buffer().to_pybytes().lower().decode() if text.is_valid else "")
                ids.append(i.as_py())
                size += len(texts[-1])
                if size >= _GROUP:
                    yield group(ids, texts, batch.column("_id").type)
                    ids, texts, size = [], [], 0
            if ids:
                yield group(ids, texts, batch.column("_id").type)

    return run, kind


def _histogram(buckets: int, kind: np.dtype):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for own in batch.column("_buckets"):
                total += np.bincount(np.frombuffer(own.as_buffer(), kind), minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["_bucket", "_count"])

    return run


def bucket_counts(features: DataFrame, buckets: int, kind: np.dtype) -> np.ndarray:
    """How many features each bucket holds: a histogram a task, summed by Spark; `buckets` rows at most
    reach the driver."""
    summed = features.select("_buckets").mapInArrow(_histogram(buckets, kind), "_bucket bigint, _count bigint").groupBy("_bucket").agg(F.sum("_count").alias("_count"))
    out = np.zeros(buckets, np.int64)
    for bucket, count in summed.collect():
        out[bucket] = count
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln) of how much likelier a bucket is in the target, each count raised by one."""
    s, t, n = float(corpus.sum()), float(target.sum()), len(corpus)
    return np.array([math.floor(1000 * math.log((float(b) + 1) * (s + n) / ((float(a) + 1) * (t + n)))) for a, b in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def _weights(gain: np.ndarray, kind: np.dtype):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [int(gain[np.frombuffer(x.as_buffer(), kind)].sum()) for x in batch.column("_buckets")]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_words"), batch.column("_n"), pa.array(own, pa.int64())], names=["_id", "_words", "_n", "_weight"])

    return run


def _noise(seed: int, id_col: Column) -> Column:
    """Gumbel noise in thousandths from the SHA-256 of `seed:id`, rounded down."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("bigint")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("bigint")


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, buckets: int = BUCKETS, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_features, weight, score, rank.

    Words are the pre-tokenizer's matches in the ASCII-lowered text; features are all runs of 1 to 3 words,
    put into `buckets` by their CRC-32. A text's weight is the sum of its features' gains: how much
    likelier their buckets are in `target` (a table with text_col) than in docs. The score adds Gumbel noise drawn
    from the id, so that the highest scores are a sample without replacement. Of the N texts with
    `least_words` words or more the floor(percent * N / 100) highest get ranks 1, 2, …; ties: the smaller id.

    Each text is pre-tokenised once; the buckets of its features are written (two bytes a feature) and read
    for the counts and for the weights. Ranks come from rows dealt by ranges of the score: a row's place
    in its range plus the sizes of the ranges before, so no task sorts the whole table.

    Null, empty and wordless texts: no features, weight 0, never drawn (unless least_words is 0). Null id: noise as
    for an empty id, drawn last among ties. Rows that repeat an id are texts of their own. Empty target: all
    t are 0. Empty table: no rows. Further columns are ignored.
    """
    spark = docs.sparkSession
    run, kind = _features(buckets)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    id_type = texts.schema["_id"].dataType.simpleString()
    made = f"_id {id_type}, _words bigint, _n bigint, _buckets binary"
    tables = ScratchTables()
    own = tables.write(texts.mapInArrow(released(run), made), "resample-features")
    wanted = target.select(F.lit(None).cast(id_type).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, made)
    gain = gains(bucket_counts(own, buckets, kind), bucket_counts(wanted, buckets, kind))
    weighed = own.mapInArrow(_weights(gain, kind), f"_id {id_type}, _words bigint, _n bigint, _weight bigint")
    scored = weighed.withColumns({"_score": F.col("_weight") + _noise(seed, F.col("_id")), "_in": F.col("_words") >= least_words})

    order = [F.desc("_in"), F.desc("_score"), F.asc_nulls_last("_id")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    scored = tables.write(scored, "resample-scores")
    ranged = tables.write(scored.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "resample-ranges")
    tables.drop_all_but(ranged)
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_size"), F.count(F.when(F.col("_in"), 1)).alias("_drawable")).collect()  # one row a range
    before, total = {}, 0
    for part, size, _ in sorted(sizes):
        before[part], total = total, total + size
    drawn = percent * sum(r["_drawable"] for r in sizes) // 100
    # Only ranges that begin before the last drawn row can hold drawn rows.
    starts = [(part, at) for part, at in before.items() if at < drawn]
    start = spark.createDataFrame(starts, "_part int, _before bigint")
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) + F.col("_before")
    head = ranged.join(F.broadcast(start), "_part").withColumn("_place", place.cast("bigint"))
    rest = ranged.join(F.broadcast(start.select("_part")), "_part", "left_anti").withColumn("_place", F.lit(None).cast("bigint"))
    rank = F.when(F.col("_place") <= drawn, F.col("_place"))
    both = head.select("_id", "_n", "_weight", "_score", "_place").unionByName(rest.select("_id", "_n", "_weight", "_score", "_place"))
    return both.select(F.col("_id").alias(id_col), F.col("_n").alias("n_features"), F.col("_weight").alias("weight"), F.col("_score").alias("score"), rank.alias("rank"))
