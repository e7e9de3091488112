"""Lexical similarity over word and character tokens."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import add

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window, functions as F

from convmem.functions.text import TOKEN, tokens
from convmem.plans.scratch import scratch

#: Entries of the inverted lists that travel at once (some 50 MB), and cells of a block of scores.
LIST_ENTRIES, _CELLS = 1_000_000, 1 << 21
_WORDS = re.compile(TOKEN)


def token_counts(texts: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(id, token, n) of each text; texts without a token have no rows."""
    return texts.select(F.col(id_col), F.explode(tokens(F.col(text_col))).alias("token")).groupBy(id_col, "token").agg(F.count("*").alias("n"))


def _norms(counts: DataFrame, id_col: str) -> DataFrame:
    return counts.groupBy(id_col).agg(F.sqrt(F.sum(F.col("n") * F.col("n")).cast("double")).alias("norm"))


@dataclass(frozen=True)
class QueryLists:
    """Inverted lists of a block of queries: for each token the queries that have it, with their counts, and the
    largest weight (count by length) among them. length: of each query."""

    names: pa.Array
    vocabulary: dict[str, int]
    start: np.ndarray
    owner: np.ndarray
    count: np.ndarray
    length: np.ndarray
    largest: np.ndarray

    @classmethod
    def of(cls, entries: pa.Table) -> QueryLists:
        """entries: qid, token, n, norm."""
        entries = entries.combine_chunks().sort_by("token")
        named, coded = entries.column("qid").combine_chunks().dictionary_encode(), entries.column("token").combine_chunks().dictionary_encode()
        count, norm, owner = entries.column("n").to_numpy(), entries.column("norm").to_numpy(), named.indices.to_numpy().astype(np.int64)
        length = np.zeros(len(named.dictionary))
        length[owner] = norm
        token = coded.indices.to_numpy()
        largest = np.zeros(len(coded.dictionary))
        np.maximum.at(largest, token, count / norm)
        start = np.searchsorted(token, np.arange(len(largest) + 1))
        return cls(named.dictionary, {t: i for i, t in enumerate(coded.dictionary.to_pylist())}, start, owner, count, length, largest)

    def weigh(self, text: str) -> tuple[np.ndarray, np.ndarray, float]:
        """(the text's tokens that a query has, their counts in the text, the text's length)."""
        single = _WORDS.findall(text)
        counts = Counter(single)
        counts.update(map(add, single, single[1:]))
        held = [(self.vocabulary[t], n) for t, n in counts.items() if t in self.vocabulary]
        return np.array([t for t, _ in held], np.int64), np.array([n for _, n in held], np.int64), math.sqrt(sum(n * n for n in counts.values()))

    def scores(self, own: list[tuple[np.ndarray, np.ndarray, float]]) -> np.ndarray:
        """The cosine of some texts (rows) with all queries (columns); products of counts are summed exactly."""
        sizes = [len(t) for t, *_ in own]
        token, count = np.concatenate([t for t, *_ in own]), np.concatenate([n for _, n, _ in own])
        text = np.repeat(np.arange(len(own)), sizes)
        size = self.start[token + 1] - self.start[token]
        at = np.repeat(self.start[token] - np.cumsum(size) + size, size) + np.arange(size.sum())
        cells = np.repeat(text, size) * len(self.names) + self.owner[at]
        dots = np.bincount(cells, np.repeat(count, size) * self.count[at], len(own) * len(self.names)).reshape(len(own), -1)
        return dots / (self.length * np.array([length for *_, length in own])[:, None])


class _Best:
    """Pairs found by a task so far: with k only those that can still be among a query's k best."""

    def __init__(self, queries: int, min_score: float, k: int | None, types: pa.DataType):
        self.floor, self.k, self.types = np.full(queries, min_score), k, types
        self.held: list[tuple[np.ndarray, pa.Array, np.ndarray]] = []
        self.size, self.most = 0, 4 * (k or 0) * queries + 100_000

    def add(self, scores: np.ndarray, ids: pa.Array) -> None:
        text, query = np.nonzero(scores >= self.floor)
        self.held.append((query, ids.take(pa.array(text)), scores[text, query]))
        self.size += len(query)

    def take(self) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        query, score = (np.concatenate([h[i] for h in self.held] or [np.empty(0, kind)]) for i, kind in ((0, np.int64), (2, np.float64)))
        ids = pa.concat_arrays([h[1] for h in self.held]) if self.held else pa.array([], self.types)
        self.held, self.size = [], 0
        return query, ids, score

    def shrink(self) -> None:
        """Raises each query's floor to its k-th score (ties stay; ids settle them later)."""
        query, ids, score = self.take()
        order = np.lexsort((-score, query))
        query, score, ids = query[order], score[order], ids.take(pa.array(order))
        first = np.searchsorted(query, np.arange(len(self.floor)))
        last = np.searchsorted(query, np.arange(len(self.floor)), "right")
        full = np.flatnonzero(last - first >= self.k)
        self.floor[full] = np.maximum(self.floor[full], score[first[full] + self.k - 1] - 1e-9)
        kept = score >= self.floor[query]
        self.held, self.size = [(query[kept], ids.filter(pa.array(kept)), score[kept])], int(kept.sum())


def _search(shared: Broadcast, qid: str, tid: str, min_score: float, k: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists: QueryLists = shared.value
        best: _Best | None = None

        def found() -> Iterator[pa.RecordBatch]:
            query, ids, score = best.take()
            for low in range(0, len(query), 50_000):
                part = slice(low, low + 50_000)
                yield pa.RecordBatch.from_arrays([lists.names.take(pa.array(query[part])), ids[part], pa.array(score[part])], names=[qid, tid, "score"])

        for batch in batches:
            best = best or _Best(len(lists.names), min_score, k, batch.column(tid).type)
            step = max(1, _CELLS // len(lists.names))
            for low in range(0, batch.num_rows, step):
                ids, texts = batch.column(tid).slice(low, step), batch.column("_text").slice(low, step).to_pylist()
                own = [lists.weigh(t) for t in texts]
                floor = best.floor.min() - 1e-9
                # What a text can reach at most with any query; below every floor it meets none.
                able = [i for i, (t, n, length) in enumerate(own) if len(t) and float(lists.largest[t] @ n) / length >= floor]
                if able:
                    best.add(lists.scores([own[i] for i in able]), ids.take(pa.array(able)))
                if k is None:
                    yield from found()
                elif best.size > best.most:
                    best.shrink()
        if best is not None and k is not None:
            best.shrink()
            yield from found()

    return run


def search(queries: DataFrame, texts: DataFrame, qid: str, tid: str, min_score: float = 0.05, k: int | None = None, entries: int = LIST_ENTRIES) -> DataFrame:
    """(qid, tid, score, rank): cosine of token counts of each query with all texts that share a
    token, at least min_score; ties by ascending id.

    The queries' inverted lists travel with the tasks, as many queries at a time as have about `entries`
    entries (counted before). A task sums the products of a text's tokens with their lists, so neither tokens
    nor pairs are shuffled: with k, only pairs that can still be among a query's k best in that task leave it, about
    k rows a query and task, without it the pairs that reach min_score. A text whose bound (the largest weight of
    each of its tokens in any query) is below all queries' floors is passed over.
    """
    spark = queries.sparkSession
    q = token_counts(queries, qid)
    q = scratch(q.withColumn("norm", F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy(qid)).cast("double"))), "lexical-queries")
    types = {qid: queries.schema[qid].dataType.simpleString(), tid: texts.schema[tid].dataType.simpleString()}
    schema = ", ".join([*[f"`{n}` {t}" for n, t in types.items()], "score double"])
    lowered = texts.select(tid, F.coalesce(F.lower("text"), F.lit("")).alias("_text"))
    blocks = -(-q.count() // entries)
    found = spark.createDataFrame([], schema)
    for b in range(blocks):
        own = QueryLists.of(q.where(F.pmod(F.xxhash64(qid), F.lit(blocks)) == b).select(F.col(qid).alias("qid"), "token", "n", "norm").toArrow())  # bounded
        if len(own.names):
            part = lowered.mapInArrow(_search(spark.sparkContext.broadcast(own), qid, tid, min_score, k), schema)
            found = part if b == 0 else found.unionByName(part)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy(qid).orderBy(F.desc(F.round("score", 12)), tid)))
    return ranked.where(F.col("rank") <= k) if k else ranked


def _name(text: str) -> Column:
    """A text's short name: its SHA-256, by which no two texts are taken for one."""
    return F.sha2(F.col(text), 256)


def cosine(pairs: DataFrame) -> DataFrame:
    """(query, text, score): the lexical cosine of each distinct pair, 0 where either has no token."""
    distinct = pairs.select("query", "text").distinct().withColumns({"_qid": _name("query"), "_tid": _name("text")})
    q = token_counts(distinct.select("_qid", F.col("query").alias("text")).distinct(), "_qid")
    t = token_counts(distinct.select("_tid", "text").distinct(), "_tid")
    met = distinct.select("_qid", "_tid").join(q, "_qid").join(t.withColumnRenamed("n", "m"), ["_tid", "token"])
    dots = met.groupBy("_qid", "_tid").agg(F.sum(F.col("n") * F.col("m")).alias("dot"))
    scored = dots.join(_norms(q, "_qid").withColumnRenamed("norm", "_qn"), "_qid").join(_norms(t, "_tid").withColumnRenamed("norm", "_tn"), "_tid")
    scored = scored.select("_qid", "_tid", (F.col("dot") / (F.col("_qn") * F.col("_tn"))).alias("score"))
    return distinct.join(scored, ["_qid", "_tid"], "left").select("query", "text", F.coalesce("score", F.lit(0.0)).alias("score"))


def cached_rerank(checks: DataFrame, scorer=cosine) -> tuple[DataFrame, DataFrame]:
    """(checks with score, report): each distinct (query, text) is scored once, whatever arms ask
    for it; the report has logical and physical checks. Scores that are not finite raise."""
    distinct = checks.select("query", "text").distinct()
    scored = scorer(distinct)
    bad = F.col("score").isNull() | F.isnan("score") | (F.abs("score") == float("inf"))
    scored = scored.withColumn("score", F.when(bad, F.raise_error(F.lit("a rerank score is not finite")).cast("double")).otherwise(F.col("score")))
    report = checks.groupBy().agg(F.count("*").alias("logical_checks"), F.countDistinct("query", "text").alias("physical_checks"))
    return checks.join(scored, ["query", "text"]), report
