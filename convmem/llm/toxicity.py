"""Toxicity by a learned lexicon, found in misspelled form by Levenshtein automata over its trie."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from convmem.llm.language_id import held_out
from convmem.plans.joins import join_checked
from convmem.plans.scratch import scratch

_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
#: Words that report what others say, and marks that quote; fixed values.
REPORTING = frozenset("said says say wrote writes called calls quoted quote term word slur reported insult insulted dit écrit sagte schrieb dijo escribió".split())
QUOTES = "\"“”„«»‘"
CLOSING = frozenset("\"“”«»’'")
WINDOW = 6
#: Prefixes that stand for a family of words.
PREFIX_LENGTHS = (4, 5, 6)
#: What a word one or two edits from a term says where no labelled text had one so near.
UNSEEN = {1: 0.6, 2: 0.3}


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


class Lexicon:
    """A trie of terms. A term that ends in * matches every word that begins so.

    find(word) runs the word through the product of the trie and the Levenshtein automaton:
    a state is the set of (trie node, edits so far) that the letters read can have led to. States
    are built when first needed and remembered, so frequent beginnings cost a look-up a letter,
    and a word that no term can begin like ends at once.
    """

    def __init__(self, terms: list[str]):
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[str | None] = [None]
        self.open: list[bool] = [False]
        self.exact: list[bool] = [False]
        for term in terms:
            node = 0
            for c in term.rstrip("*"):
                nxt = self.children[node].get(c)
                if nxt is None:
                    nxt = len(self.children)
                    self.children.append({})
                    self.ends.append(None)
                    self.open.append(False)
                    self.exact.append(False)
                    self.children[node][c] = nxt
                node = nxt
            self.ends[node] = self.ends[node] or term.rstrip("*")
            self.open[node] |= term.endswith("*")
            self.exact[node] |= not term.endswith("*")
        self.forget()

    def forget(self) -> None:
        """Drops the remembered states; they are built again when needed."""
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.start = {k: self._state(self._closed({(0, 0)}, k), k) for k in (0, 1, 2)}

    def _closed(self, pairs: set[tuple[int, int]], k: int) -> frozenset:
        """Adds what skipping letters of terms reaches, and keeps the fewest edits of each node."""
        best: dict[int, int] = {}
        todo = list(pairs)
        while todo:
            node, edits = todo.pop()
            if edits > k or best.get(node, k + 1) <= edits:
                continue
            best[node] = edits
            todo += [(c, edits + 1) for c in self.children[node].values()]
        return frozenset(best.items())

    def _state(self, pairs: frozenset, k: int) -> int:
        key = frozenset([*pairs, (-1, k)])
        at = self.states.get(key)
        if at is None:
            at = self.states[key] = len(self.sets)
            self.sets.append(pairs)
            self.moves.append({})
        return at

    def _step(self, state: int, c: str, k: int) -> int:
        """The state after c, -1 if no term is left."""
        nxt: set[tuple[int, int]] = set()
        for node, edits in self.sets[state]:
            if (child := self.children[node].get(c)) is not None:
                nxt.add((child, edits))
            if edits < k:
                nxt.add((node, edits + 1))
                nxt.update((child, edits + 1) for child in self.children[node].values())
        closed = self._closed(nxt, k)
        return self._state(closed, k) if closed else -1

    def find(self, word: str) -> tuple[str, int] | None:
        """(term, distance) of the word itself, else of the shortest open prefix (distance 3), else of
        the nearest term; null if none is near enough: no edit for words of under 5 letters, 1 for
        under 9, else 2. Ties: the first term in order of code points."""
        node, family = 0, None
        for i, c in enumerate(word):
            node = self.children[node].get(c, -1)
            if node < 0:
                break
            if self.open[node] and family is None and i + 1 < len(word):
                family = self.ends[node] + "*", 3
        if node > 0 and self.ends[node] is not None and self.exact[node]:
            return self.ends[node], 0
        if family:
            return family
        k = 0 if len(word) < 5 else 1 if len(word) < 9 else 2
        if not k or len(word) > 40:
            return None
        state = self.start[k]
        for c in word:
            nxt = self.moves[state].get(c)
            if nxt is None:
                nxt = self.moves[state][c] = self._step(state, c, k)
            if nxt < 0:
                return None
            state = nxt
        ends = [(edits, self.ends[node]) for node, edits in self.sets[state] if self.exact[node]]
        if len(self.sets) > 200_000:
            self.forget()
        return (min(ends)[1], min(ends)[0]) if ends else None


@dataclass
class Matcher:
    """Matches of the lexicon in texts, with what their surroundings say."""

    terms: list[str]
    lexicon: Lexicon | None = None
    known: dict[str, tuple[str, int] | None] = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return {"terms": self.terms, "lexicon": None, "known": {}}

    def occurrences(self, text: str | None) -> list[tuple[str, int, bool, str]]:
        """(term, distance, quoting, neighbours) of each occurrence. quoting: the window around it has
        a reporting word, or it stands in quotation marks."""
        if self.lexicon is None:
            self.lexicon = Lexicon(self.terms)
        if not text or not self.terms:
            return []
        if len(self.known) > 200_000:
            self.known.clear()
        known, found = self.known, {}
        lower = text.lower()
        words = _WORD.findall(lower)
        for word in set(words):
            hit = known.get(word, 0)
            if hit == 0:
                hit = known[word] = self.lexicon.find(word)
            if hit:
                found[word] = hit
        if not found:
            return []
        out = []
        for i, m in enumerate(_WORD.finditer(lower)):
            if hit := found.get(m[0]):
                around = words[max(0, i - WINDOW) : i + WINDOW + 1]
                quoted = m.start() > 0 and lower[m.start() - 1] in QUOTES and lower[m.end() : m.end() + 1] in CLOSING
                out.append((*hit, quoted or not REPORTING.isdisjoint(around), " ".join(words[max(0, i - 1) : i + 2])))
        return out

    def matches(self, text: str | None) -> list[tuple[str, int, bool]]:
        """(term, distance, quoting) of each distinct match; quoting if every occurrence is."""
        out: dict[tuple[str, int], bool] = {}
        for term, distance, quoting, _ in self.occurrences(text):
            out[term, distance] = out.get((term, distance), True) and quoting
        return [(t, d, q) for (t, d), q in out.items()]


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word or prefix*, documents, toxic documents) of each batch."""
    for batch in batches:
        n: dict[str, list[int]] = {}
        for text, toxic in zip(batch.column("_text").to_pylist(), batch.column("_toxic").to_pylist(), strict=True):
            words = set(words_of(text))
            for word in words | {w[:k] + "*" for w in words for k in PREFIX_LENGTHS if len(w) > k}:
                c = n.setdefault(word, [0, 0])
                c[0] += 1
                c[1] += toxic
        some = [(w, a, b) for w, (a, b) in n.items() if b]
        rest = [(w, a, b) for w, (a, b) in n.items() if not b]
        cols = list(zip(*(some + rest), strict=True)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], names=["_w", "_n", "_t"])


def _surrounding_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct (word or prefix*, hash of the word with its neighbours) of each batch."""
    for batch in batches:
        rows = set()
        for text in batch.column("_text").to_pylist():
            words = words_of(text)
            for i, w in enumerate(words):
                c = zlib.crc32(" ".join(words[max(0, i - 1) : i + 2]).encode())
                rows.add((w, c))
                rows.update((w[:k] + "*", c) for k in PREFIX_LENGTHS if len(w) > k)
        cols = list(zip(*rows, strict=True)) or [[], []]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64())], names=["_w", "_c"])


def _wilson(t: float, n: float, z: float = 2.58) -> float:
    p, z2 = t / n, z * z
    return (p + z2 / (2 * n) - z * ((p * (1 - p) + z2 / (4 * n)) / n) ** 0.5) / (1 + z2 / n)


def _lower_bound(t: Column, n: Column, z: float = 2.58) -> Column:
    """The lower end of the Wilson interval of t / n."""
    p, z2 = t / n, z * z
    return (p + z2 / (2 * n) - z * F.sqrt((p * (1 - p) + z2 / (4 * n)) / n)) / (1 + z2 / n)


@dataclass
class ToxicityModel:
    """Terms, the share of toxic surroundings of each match, and of documents without any. seen: the
    matches that labelled texts had at all."""

    matcher: Matcher
    excess: dict[tuple[str, int], float]
    base: float
    quoting: float
    seen: frozenset[tuple[str, int]] = frozenset()

    def score(self, text: str | None) -> float:
        """1 - (1 - base) * product of (1 - excess): matches count as independent reasons, weaker
        where the context quotes."""
        rest = 1 - self.base
        for term, distance, quoting in self.matcher.matches(text):
            weight = self.excess.get((term, distance))
            if weight is None:
                weight = 0.0 if (term, distance) in self.seen else UNSEEN.get(distance, 0.0)
            rest *= 1 - weight * (self.quoting if quoting else 1.0)
        return min(1.0, max(0.0, 1 - rest))


def _match_rows(matcher: Matcher):
    """Distinct occurrences (term, distance, quoting, hash of the neighbours, toxic); a document without
    any has one row with an empty term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = set()
            for text, toxic in zip(batch.column("_text").to_pylist(), batch.column("_toxic").to_pylist(), strict=True):
                found = matcher.occurrences(text)
                rows.update((t, d, q, zlib.crc32(around.encode()), toxic) for t, d, q, around in found)
                if not found:
                    rows.add(("", 0, False, zlib.crc32((text or "").encode()), toxic))
            cols = list(zip(*sorted(rows), strict=True)) or [[]] * 5
            types = [pa.string(), pa.int32(), pa.bool_(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["_w", "_d", "_q", "_c", "_t"])

    return run


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> ToxicityModel:
    """Learns from labelled rows of docs.

    1. In how many toxic and other documents each word and each beginning of 4 to 6 letters
       occurs: combined in the tasks, summed by a shuffle. Candidates are those of which surely
       (Wilson bound at 99 %) more than half the documents are toxic, and that stand in enough
       distinct surroundings in toxic documents to be sure if there were no others: what fails
       this cannot be sure in step 2, so copies bring no terms. Of beginnings, a longer one adds
       nothing to a shorter one and is dropped. All others are kept: the lexicon on the driver
       and in each task grows with the sure terms, and with nothing else.
    2. For each match (term, distance) of the candidates, in how many distinct surroundings (the
       words next to it) it occurs in toxic and in other documents. Copies of one document
       share their surroundings, so a rare word of a text that was copied often is no evidence.
       Terms that are not sure by this count are dropped; what a misspelling, a family of words
       or a quotation is worth is learned in the same way.
    """
    known = labels.where("toxic IN (0, 1)").select(F.col(id_col).alias("_id"), F.col("toxic").cast("bigint").alias("_toxic"))
    rows = join_checked(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), known, "_id", "inner").select("_text", "_toxic")
    words = rows.mapInArrow(_word_rows, "_w string, _n bigint, _t bigint").groupBy("_w").agg(F.sum("_n").alias("_n"), F.sum("_t").alias("_t"))
    sure = words.where("_t > 0").where(_lower_bound(F.col("_t"), F.col("_n")) > 0.5).select("_w")
    sure = scratch(sure, "toxic-words")
    around = join_checked(rows.where("_toxic = 1").mapInArrow(_surrounding_rows, "_w string, _c bigint"), sure, "_w", "left_semi").distinct()
    varied = around.groupBy("_w").agg(F.count("*").alias("_n")).where(_lower_bound(F.col("_n"), F.col("_n")) > 0.5).select("_w")
    varied = scratch(varied, "toxic-terms")
    prefixes = scratch(varied.where(F.col("_w").endswith("*")).select(F.col("_w").alias("_p")), "toxic-prefixes")
    for k in PREFIX_LENGTHS[:-1]:
        longer = F.col("_w").endswith("*") & (F.length("_w") > k + 1)
        varied = varied.withColumn("_p", F.when(longer, F.concat(F.substring("_w", 1, k), F.lit("*")))).join(prefixes, "_p", "left_anti").select("_w")
    terms = sorted(r["_w"] for r in varied.collect())
    seen = rows.mapInArrow(_match_rows(Matcher(terms)), "_w string, _d int, _q boolean, _c bigint, _t bigint").distinct()
    stats = seen.groupBy("_w", "_d", "_q").agg(F.count("*").alias("_n"), F.sum("_t").alias("_t")).toPandas()  # a few rows a term
    clean = stats[stats["_w"] == ""]
    base = float((clean["_t"].sum() + 0.5) / (clean["_n"].sum() + 10)) if len(stats) else 0.0
    hits = stats[stats["_w"] != ""]
    excess: dict[tuple[str, int], float] = {}
    share: dict[tuple[str, int], float] = {}
    for (term, distance), g in hits.groupby(["_w", "_d"]):
        plain = g[~g["_q"]] if (~g["_q"]).any() else g
        n, t = float(plain["_n"].sum()), float(plain["_t"].sum())
        share[term, int(distance)] = t / n
        if _wilson(t, n) > 0.5:
            excess[term, int(distance)] = (t + 1) / (n + 2)
    quoted = hits[hits["_q"] & (hits["_d"] == 0)]
    expected = sum(share[w, 0] * n for w, n in zip(quoted["_w"], quoted["_n"], strict=True))
    quoting = float((quoted["_t"].sum() + 2.5) / (expected + 5)) if len(hits) else 0.5
    kept = {t.rstrip("*") for t, _ in excess}
    return ToxicityModel(Matcher([t for t in terms if t.rstrip("*") in kept]), excess, min(base, 0.49), min(1.0, quoting), frozenset(share))


def scores(model: ToxicityModel, text: Column) -> Column:
    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return texts.map(model.score).astype("float64")

    return score(text)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, held_out, score, predicted.

    Learned from labelled rows that are not held out; only the text enters a score. Null, empty or
    matchless text has the share of toxic documents among labelled ones without a match. Without
    labels every score is 0. Null id: not held out, not learned from. An id labelled twice counts
    twice; repeated rows score alike. Ties at 0.5 are toxic. Empty table: no rows. Further columns
    are ignored.
    """
    model = fit(docs.where(~held_out(id_col)), labels, id_col, text_col)
    judged = docs.select(F.col(id_col), held_out(id_col).alias("held_out"), scores(model, F.coalesce(F.col(text_col), F.lit(""))).alias("score"))
    return judged.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
