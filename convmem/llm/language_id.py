"""Language identification by a bit-sliced Bloom filter of character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, Window, functions as F

from convmem.llm.batches import released
from convmem.plans.scratch import scratch

ORDERS = (3, 4)
#: The filter has 2 ** SLOTS_LOG2 words, one bit per language, and two hashes of a gram.
SLOTS_LOG2 = 19
_LETTER = regex.compile(r"\p{L}")
#: For each character of the basic plane its lower-case letter, or a blank.
_FOLD = np.array([ord(c.lower()) if c.isalpha() and len(c.lower()) == 1 else ord(c) if c.isalpha() else 32 for c in map(chr, range(0x10000))], np.uint64)


def grams(text: str) -> np.ndarray:
    """The text's character 3- and 4-grams as integers of 16 bits a character: letters in lower
    case, everything between words as one blank. Characters beyond the basic plane share one."""
    x = _FOLD[np.minimum(np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), np.uint32), 0xFFFF)]
    x = x[np.append(True, (x[1:] != 32) | (x[:-1] != 32))]
    if len(x) < 3:
        return np.empty(0, np.uint64)
    three = x[:-2] | (x[1:-1] << np.uint64(16)) | (x[2:] << np.uint64(32))
    return np.concatenate([three, three[:-1] | (x[3:] << np.uint64(48))])


@dataclass(frozen=True)
class LanguageFilter:
    """languages, the filter's words, and each language's false-positive rate."""

    languages: tuple[str, ...]
    words: np.ndarray
    false_positive: np.ndarray

    @staticmethod
    def slots(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = keys * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return (h >> np.uint64(64 - SLOTS_LOG2)).view(np.int64), ((h >> np.uint64(20)) & np.uint64(2**SLOTS_LOG2 - 1)).view(np.int64)

    @classmethod
    def build(cls, languages: tuple[str, ...], keys: np.ndarray, masks: np.ndarray) -> LanguageFilter:
        kind = np.uint8 if len(languages) <= 8 else np.uint16 if len(languages) <= 16 else np.uint64
        words = np.zeros(2**SLOTS_LOG2, kind)
        for at in cls.slots(keys):
            np.bitwise_or.at(words, at, masks.astype(kind))
        filled = np.array([((words >> kind(i)) & kind(1)).mean() for i in range(len(languages))])
        return cls(languages, words, filled**2)

    def hits(self, text: str) -> tuple[np.ndarray, int]:
        """(for each language how many of the text's grams its filter has, the number of grams)."""
        keys = grams(text)
        first, second = self.slots(keys)
        mask = self.words[first] & self.words[second]
        if self.words.dtype.itemsize <= 2:
            times = np.bincount(mask)
            held = np.arange(len(times))
            return np.array([times[(held >> i) & 1 == 1].sum() for i in range(len(self.languages))], float), len(keys)
        return np.array([((mask >> np.uint64(i)) & np.uint64(1)).sum() for i in range(len(self.languages))], float), len(keys)

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language whose filter holds the most of the text's grams, false positives taken
        off, and its share among all languages."""
        if not text or not self.languages or not _LETTER.search(text):
            return "und", 0.0
        found, total = np.zeros(len(self.languages)), 0
        for low in range(0, len(text), 1 << 20):
            more, n = self.hits(text[low : low + (1 << 20)])
            found, total = found + more, total + n
        true = np.maximum(0, (found - total * self.false_positive) / np.maximum(1e-9, 1 - self.false_positive))
        best = int(np.argmax(true))
        return self.languages[best], float(true[best] / true.sum()) if true.sum() > 0 else 1 / len(self.languages)


def _document_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch and language, in how many documents each gram occurs."""
    for batch in batches:
        langs = batch.column("_lang").to_pylist()
        by: dict[str, list[np.ndarray]] = {}
        for lang, text in zip(langs, batch.column("_text").to_pylist(), strict=True):
            by.setdefault(lang, []).append(np.unique(grams(text or "")))
        for lang, found in by.items():
            h, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(h)), pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["_lang", "_h", "_n"])


def fit(labelled: DataFrame, text_col: str, lang_col: str, documents_per_language: int = 4000, grams_per_language: int = 60_000, share: float = 0.5) -> LanguageFilter:
    """Learns which languages contain which n-grams.

    The distinct texts of each language are sampled by their hashes down to about
    `documents_per_language` (the documented bound of the sample), so that copies count once and
    a text with many copies is no likelier to be in it. A gram belongs to every language in which the
    share of sampled texts that have it is at least `share` of its largest share, and at least 1 in
    500. Of each language the `grams_per_language` commonest are kept (ties: the lower hash), so
    the model's size is fixed (up to 64 languages).
    """
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("_lang"), F.col(text_col).alias("_text"))
    hashed = rows.withColumn("_key", F.xxhash64("_text", F.lit("sample")))
    sizes = {r[0]: r[1] for r in hashed.groupBy("_lang").agg(F.approx_count_distinct("_key")).collect()}
    languages = tuple(sorted(sizes))
    if len(languages) > 64:
        raise ValueError("the filter has one bit for each of at most 64 languages")
    if not languages:
        return LanguageFilter((), np.zeros(2**SLOTS_LOG2, np.uint64), np.zeros(0))
    bound = F.create_map(*[F.lit(x) for k in languages for x in (k, int(1_000_000 * min(1.0, documents_per_language / max(1, sizes[k]))))])
    sample = hashed.where(F.pmod("_key", F.lit(1_000_000)) < F.element_at(bound, F.col("_lang")))
    sample = scratch(sample.groupBy("_lang", "_key").agg(F.first("_text").alias("_text")), "language-sample")
    read = {r[0]: r[1] for r in sample.groupBy("_lang").count().collect()}
    counts = sample.mapInArrow(_document_grams, "_lang string, _h bigint, _n bigint").groupBy("_lang", "_h").agg(F.sum("_n").alias("_n"))
    number = F.create_map(*[F.lit(x) for i, k in enumerate(languages) for x in (k, i)])
    total = F.create_map(*[F.lit(x) for k in languages for x in (k, float(max(1, read.get(k, 0))))])
    rated = counts.select("_h", F.element_at(number, F.col("_lang")).alias("_i"), (F.col("_n") / F.element_at(total, F.col("_lang"))).alias("_rate"))
    own = rated.groupBy("_h").agg(F.max("_rate").alias("_top"), F.collect_list(F.struct("_i", "_rate")).alias("_all"))  # a row for each language at most
    own = own.where("_top >= 0.002").select("_h", "_top", F.explode("_all").alias("_x")).where((F.col("_x._rate") >= share * F.col("_top")) & (F.col("_x._rate") >= 0.002))
    ranked = own.select("_h", "_x._i", F.row_number().over(Window.partitionBy("_x._i").orderBy(F.desc("_x._rate"), "_h")).alias("_at"))
    bit = F.element_at(F.array(*[F.lit(1 << i if i < 63 else -(1 << 63)).cast("bigint") for i in range(len(languages))]), F.col("_i") + 1)
    table = ranked.where(F.col("_at") <= grams_per_language).groupBy("_h").agg(F.bit_or(bit).alias("_mask")).toPandas()
    return LanguageFilter.build(languages, table["_h"].to_numpy(np.int64).view(np.uint64), table["_mask"].to_numpy(np.int64).view(np.uint64))


def predictions(model: LanguageFilter, text: Column) -> Column:
    """A struct column (lang_pred, score); the model of fixed size travels with the task."""
    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([model.predict(t) for t in texts], columns=["lang_pred", "score"])

    return predict(text)


def with_language(docs: DataFrame, model: LanguageFilter, text_col: str, lang_col: str) -> DataFrame:
    """The rows whose language can be told; a null language is filled in. Each text is judged once, in the
    task that drops or keeps its row. All columns are kept."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([model.predict(t)[0] for t in batch.column(text_col).to_pylist()], pa.string())
            filled = [pc.coalesce(c.cast(pa.string()), found) if n == lang_col else c for n, c in zip(names, batch.columns, strict=True)]
            yield pa.RecordBatch.from_arrays(filled, names=names).filter(pc.not_equal(found, "und"))

    return docs.mapInArrow(released(run), docs.schema)


def held_out(id_col: str) -> Column:
    """Rows whose CRC-32 of the id as text is a multiple of five are never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per input row: id, held_out, lang_pred, score.

    Learns from rows that are not held out and have a language and a text. Null text, or a text
    without a letter: `und` with score 0; so is everything if nothing can be learned. Null id:
    not held out. Ties: the first language in order of code points. Rows are judged one by one,
    so repeated rows agree. Empty table: no rows. Further columns are ignored.
    """
    model = fit(docs.where(~held_out(id_col)), text_col, lang_col)
    p = docs.select(F.col(id_col), held_out(id_col).alias("held_out"), predictions(model, F.col(text_col)).alias("_p"))
    return p.select(id_col, "held_out", "_p.lang_pred", "_p.score")
