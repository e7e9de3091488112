"""Substring deduplication: repeated runs of consecutive sentences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from convmem.llm.batches import released
from convmem.llm.shingles import _SPACES, mix, word_hashes
from convmem.plans.joins import own_names
from convmem.plans.scratch import ScratchTables

_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".!?"]] = True
_R = np.uint64(0xD1342543DE82EF95)
_R_INVERSE = np.uint64(pow(int(_R), -1, 2**64))
#: A sentence of more words than this is cut at marks: the word with the least hash in each window
#: of as many words. A part has at most so many words.
LONGEST = 10
#: The least sentences and words of a run. A passage of 51 words has common marks from its tenth word
#: at the latest to its 42nd at the earliest, so 22 words and a part beyond them always fit.
LEAST_SENTENCES, LEAST_WORDS = 2, 22


def sentences(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of all words, first word of each sentence, byte offset of each word and of the end).

    A sentence ends with a word whose last character is one of . ! ? or before a line feed.
    Sentences of more than LONGEST words are cut at marks that depend on the words of one window
    alone, so that little is lost where a passage begins or ends within one; their parts count as
    sentences.
    """
    words = word_hashes(text)
    b = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    edges = np.flatnonzero(np.diff(~_SPACES[b], prepend=False, append=False))
    starts, ends = edges[0::2], edges[1::2]
    lines = np.cumsum(b == 10)
    last = _ENDS[b[ends - 1]]
    last[:-1] |= lines[starts[1:]] > lines[ends[:-1] - 1]
    last[-1:] = True
    first = np.append(0, np.flatnonzero(last)[:-1] + 1)
    return words, np.union1d(first, _marks(words, first)), np.append(starts, len(b))


def _marks(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The marks within the sentences of more than LONGEST words that start at first."""
    length = np.diff(np.append(first, len(words)))
    long = np.flatnonzero(length > LONGEST)
    n = length[long] - LONGEST + 1  # windows of each
    windows = np.repeat(first[long] - np.cumsum(n) + n, n) + np.arange(n.sum())
    out = [windows[:0]]
    for low in range(0, len(windows), 65_536):
        at = windows[low : low + 65_536]
        out.append(np.unique(at + words[at[:, None] + np.arange(LONGEST)].argmin(axis=1)))
    return np.concatenate(out)


def runs(text: str | None, least_sentences: int, least_words: int) -> tuple[np.ndarray, ...]:
    """(hash, second hash, number of the first sentence, first byte, end byte) of the shortest run from
    each sentence that has enough sentences and words; runs that the text's end cuts short are left
    out."""
    none = np.empty(0, np.int64)
    if not text:
        return none, none, none, none, none
    words, first, at = sentences(text) if text.strip(" \t\n\v\f\r") else (none, none, none)
    if len(first) < least_sentences or len(words) < least_words:
        return none, none, none, none, none
    bounds = np.append(first, len(words))
    end = np.maximum(np.arange(len(first)) + least_sentences, np.searchsorted(bounds, first + least_words))
    full = np.flatnonzero(end < len(bounds))
    low, high = first[full], bounds[end[full]]
    powers = np.full(len(words) + 1, _R)
    powers[0] = 1
    powers = np.cumprod(powers, dtype=np.uint64)
    back = np.full(len(words) + 1, _R_INVERSE)
    back[0] = 1
    back = np.cumprod(back, dtype=np.uint64)
    out = []
    for w in (words, mix(words ^ np.uint64(0xA5A5A5A5A5A5A5A5))):
        sums = np.append(np.zeros(1, np.uint64), np.cumsum(w * powers[:-1], dtype=np.uint64))
        out.append(mix((sums[high] - sums[low]) * back[low] + (high - low).astype(np.uint64)).view(np.int64))
    return out[0], out[1], full, at[low].astype(np.int64), at[high].astype(np.int64)


def _spans(least_sentences: int, least_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                found = [runs(x.as_py(), least_sentences, least_words) for x in part.column("_text")]
                rows = np.repeat(np.arange(part.num_rows), [len(f[0]) for f in found])
                cols = [part.column(c).take(pa.array(rows)) for c in ("_id", "_row")]
                h, g, at = (np.concatenate([f[i] for f in found]) for i in range(3))
                cols += [pa.array(h), pa.array((g >> 32).astype(np.int32)), pa.array(at.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(cols, names=["_id", "_row", "_h", "_g", "_at"])

    return run


def _cut(text_col: str, cuts_col: str, clean_col: str, removed_col: str, least_sentences: int, least_words: int):
    """Cuts the runs that begin at the given sentences out of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, removed = [], []
            for text, cuts in zip(batch.column(text_col), batch.column(cuts_col), strict=True):
                text, cuts = text.as_py(), cuts.as_py()
                if not cuts:
                    out.append(text)
                    removed.append([])
                    continue
                _, _, at, first, end = runs(text, least_sentences, least_words)
                own = np.searchsorted(at, np.sort(np.array(cuts, np.int64)))
                merged: list[list[int]] = []
                for low, high in zip(first[own].tolist(), end[own].tolist(), strict=True):
                    if merged and low <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], high)
                    else:
                        merged.append([low, high])
                b = text.encode("utf-8", "surrogatepass")
                kept, last = [], 0
                for low, high in merged:
                    kept.append(b[last:low])
                    last = high
                out.append(b"".join([*kept, b[last:]]).decode("utf-8", "surrogatepass").rstrip())
                removed.append([{"start": low, "end": high} for low, high in merged])
            spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            names = [n for n in batch.schema.names if n not in (text_col, cuts_col)]
            cols = [batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(out, pa.string()), pa.array(removed, spans)], names=[*names, clean_col, removed_col])

    return run


def span_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_sentences: int = LEAST_SENTENCES, least_words: int = LEAST_WORDS) -> DataFrame:
    """The rows of docs with their text cleaned, and a column `removed`: the byte ranges
    [start, end) that were cut from the text.

    From each sentence (or part of a long one, see sentences) the shortest run with at least
    `least_sentences` of them and `least_words` words is hashed to 96 bits, so a repeated passage of 51
    words has a repeated run whatever its punctuation and wherever it starts. Of all runs with
    the same words (letter case and white space aside) in all documents the first, by (id, text,
    position), stays; the sentences of every other are removed.

    The runs are hashed once and written: (document, sentence number, hash). A combining aggregation
    finds the first place of each hash that occurs twice, so a run that a third of all documents
    share is pre-aggregated where it is read; the join of the runs with these places is shuffled
    at every size, and AQE splits its hot keys. What leaves it are sentence numbers, gathered per
    document and cut from the texts.

    A document is named by its id and a hash of its text: rows that repeat both are one document,
    and neither loses its spans to the other. Null text stays null, empty or wordless text stays;
    texts of fewer sentences or words than a run needs stay. Null ids sort first. Empty table: no
    rows. Other columns pass through, but for one named `removed`, which is replaced.
    """
    columns = [c for c in docs.columns if c != "removed"]
    docs = docs.select(*columns)
    id_own, row_col, text_own, cuts_col, clean_col, removed_col = own_names(columns, "id", "row", "text", "cuts", "clean", "removed")
    whose = [F.coalesce(F.col(id_col).cast("bigint"), F.lit(-(2**63))), F.xxhash64(text_col)]  # null ids sort first, and are told apart by their texts
    tables = ScratchTables()
    keyed = docs.select(whose[0].alias("_id"), whose[1].alias("_row"), F.col(text_col).alias("_text"))
    spans = tables.write(keyed.mapInArrow(released(_spans(least_sentences, least_words)), "_id bigint, _row bigint, _h bigint, _g int, _at int"), "span-runs")
    place = F.struct("_id", "_row", "_at")
    first = spans.groupBy("_h", "_g").agg(F.min(place).alias("_first"), F.count("*").alias("_n")).where("_n > 1").select("_h", "_g", "_first")
    # Written, so that the join deals both sides anew and AQE can split a hot run.
    first = tables.write(first, "span-first")
    later = spans.join(first, ["_h", "_g"]).where(place != F.col("_first"))
    cuts = tables.write(later.groupBy("_id", "_row").agg(F.collect_set("_at").alias("_cuts")), "span-cuts")
    tables.drop_all_but(cuts)

    cuts = cuts.select(F.col("_id").alias(id_own), F.col("_row").alias(row_col), F.col("_cuts").alias(cuts_col))
    tagged = docs.withColumns({id_own: whose[0], row_col: whose[1]})
    whole = tagged.join(cuts, [id_own, row_col], "left").drop(id_own, row_col).withColumn(text_own, F.col(text_col)).drop(text_col)
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema.fields if f.name != text_col)
    clean = whole.mapInArrow(released(_cut(text_own, cuts_col, clean_col, removed_col, least_sentences, least_words)), f"{fields}{clean_col} string, {removed_col} array<struct<start: bigint, end: bigint>>")
    return clean.select(*[F.col(clean_col).alias(c) if c == text_col else F.col(f"`{c}`") for c in columns], F.col(removed_col).alias("removed"))
