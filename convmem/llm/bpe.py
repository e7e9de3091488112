"""Byte-level BPE encoding and decoding over overlapping chunks."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window, functions as F

from convmem.plans.scratch import scratch

#: Characters of a chunk, and of the overlap in which neighbouring chunks must resynchronise.
CHUNK, OVERLAP = 65_536, 1_024
_DIGESTS = ["n_tokens", "ids_sha256", "decoded_sha256"]
#: Words that a process remembers, the longest of them in characters, and the characters that are
#: encoded at once: together they bound its memory.
_CACHE, _SHORT, _AT_ONCE = 150_000, 48, 1 << 20
#: Slots of the table of mergeable pairs (a power of two), and the id of a pair without one.
_SLOTS, _NONE = 21, 1 << 40
#: Bytes from which a piece is merged with a heap.
_LONG = 400
#: White space as the rank files' pattern means it (Unicode White_Space).
_SPACE = "\\t\\n\\v\\f\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def pattern(text: str) -> regex.Pattern:
    """The pre-token pattern, with its white-space classes spelled out."""
    return regex.compile(text.replace(r"[^\s", f"[^{_SPACE}").replace(r"\s", f"[{_SPACE}]").replace(r"\S", f"[^{_SPACE}]"))


class Encoder:
    """Merges of the pieces of many texts at a time; words met before are remembered."""

    def __init__(self, ranks_path: str, pattern_text: str):
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.tokens[i] = token
        self.decimal = [str(i) for i in range(len(self.tokens))]
        self.bytes = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        pairs = [(ranks[t[:i]] << 32 | ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self.slots = np.full(1 << _SLOTS, -1, np.int64)
        self.ids = np.full(1 << _SLOTS, _NONE, np.int64)
        keys, merged = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
        at = self._slot(keys)
        while len(keys):  # each free slot takes the first key that asks for it; the others step on
            _, first = np.unique(at, return_index=True)
            first = first[self.slots[at[first]] == -1]
            self.slots[at[first]], self.ids[at[first]] = keys[first], merged[first]
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, merged, at = keys[rest], merged[rest], (at[rest] + 1) & ((1 << _SLOTS) - 1)
        self.pattern = pattern(pattern_text)
        # A lone blank between characters that are no white space always begins a piece.
        self.cut = regex.compile(r"(?<=[^\s\x1c-\x1f]) (?=[^\s\x1c-\x1f])")
        self.forget()

    def forget(self) -> None:
        self.known_ids: dict[str, str] = {}
        self.known_bytes: dict[str, bytes] = {}

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _SLOTS)).astype(np.int64)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The id that each pair of ids merges to, or _NONE."""
        keys = left << 32 | right
        at = self._slot(keys)
        out = np.full(len(keys), _NONE, np.int64)
        todo = np.arange(len(keys))
        while len(todo):
            held = self.slots[at[todo]]
            hit = held == keys[todo]
            out[todo[hit]] = self.ids[at[todo[hit]]]
            todo = todo[~hit & (held != -1)]
            at[todo] = (at[todo] + 1) & ((1 << _SLOTS) - 1)
        return out

    def merge(self, pieces: list[bytes]) -> tuple[list[int], np.ndarray]:
        """(the ids of all pieces in a row, how many each piece has). In each step every unfinished
        piece joins its leftmost pair of the lowest rank; pieces without a pair left drop out."""
        size = np.array([len(p) for p in pieces])
        place = np.cumsum(size) - size
        result, sizes = np.full(int(size.sum()), -1, np.int64), np.zeros(len(pieces), np.int64)
        for i in np.flatnonzero(size > _LONG):
            own = self._merge_long(pieces[i])
            result[place[i] : place[i] + len(own)], sizes[i] = own, len(own)
        short = np.flatnonzero(size <= _LONG)
        ids = self.bytes[np.frombuffer(b"".join([pieces[i] for i in short]), np.uint8)]
        size, name = size[short], short
        while len(name):
            first = np.cumsum(size) - size
            last = first + size - 1
            rank = np.full(len(ids), _NONE, np.int64)
            rank[:-1] = self._rank(ids[:-1], ids[1:])
            rank[last] = _NONE
            while True:
                best = np.minimum.reduceat(rank, first)
                over = best == _NONE
                if over.any():
                    break
                # The leftmost place of the best rank in each piece.
                hits = np.flatnonzero(rank == np.repeat(best, size))
                owner = np.searchsorted(first, hits, "right") - 1
                _, lead = np.unique(owner, return_index=True)
                at = hits[lead]
                ids[at] = best
                keep = np.ones(len(ids), bool)
                keep[at + 1] = False
                ends = at + 1 == last  # the merged pair was the piece's last
                ids, rank = ids[keep], rank[keep]
                size = size - 1
                first = np.cumsum(size) - size
                last = first + size - 1
                at = at - np.arange(len(at))
                inner = at[~ends]
                rank[inner] = self._rank(ids[inner], ids[inner + 1])
                rank[at[ends]] = _NONE
                before = at[at > first]
                rank[before - 1] = self._rank(ids[before - 1], ids[before])
            sizes[name[over]] = size[over]
            out = np.repeat(over, size)
            result[np.repeat(place[name[over]] - (np.cumsum(size[over]) - size[over]), size[over]) + np.arange(out.sum())] = ids[out]
            ids, size, name = ids[~out], size[~over], name[~over]
        return result[result >= 0].tolist(), sizes

    def _merge_long(self, piece: bytes) -> list[int]:
        """As merge, for one long piece, with a heap of pairs and links between neighbours."""
        token: list[bytes | None] = [piece[i : i + 1] for i in range(len(piece))]
        n, ranks = len(token), self.ranks
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, token[i], token[i + 1]) for i in range(n - 1) if (r := ranks.get(token[i] + token[i + 1])) is not None]
        heapify(heap)
        while heap:
            _, i, a, b = heappop(heap)
            j = after[i]
            if token[i] != a or j >= n or token[j] != b:
                continue
            token[i], token[j], after[i] = a + b, None, after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (r := ranks.get(token[x] + token[y])) is not None:
                    heappush(heap, (r, x, token[x], token[y]))
        return [ranks[t] for t in token if t is not None]

    @staticmethod
    def _odd(word: str) -> bool:
        """Whether a word may only be cut off by its context (white space at its edges)."""
        return word[-1].isspace() or word[0] == "\0" or (word[0] == " " and word[1].isspace())

    def _words(self, text: str) -> list[str]:
        """Keys of the text's words, each with the blank before it, which begins a piece if it stands
        alone between other characters. Odd words are told apart by a leading NUL."""
        first, *rest = text.split(" ")
        words = ([first] if first else []) + [" " + w for w in rest]
        if "\0" in text or any(map(self._odd, set(words).difference(self.known_ids))):
            first, *rest = self.cut.split(text)
            words = ([first] if first else []) + [" " + w for w in rest]
            return ["\0" + w if self._odd(w) else w for w in words]
        return words

    def _learn(self, words: list[str]) -> None:
        """Pre-tokenises words and merges all their new pieces in one go."""
        pieces: list[bytes] = []
        ends: list[int] = []
        for word in words:
            text = word[1:] if word[0] == "\0" else word
            pieces += [p.encode("utf-8", "surrogatepass") for p in self.pattern.findall(text)]
            ends.append(len(pieces))
        ids, sizes = self.merge(pieces)
        at = np.append(0, np.cumsum(sizes))[np.append(0, ends)].tolist()
        decimal, tokens = [self.decimal[i] for i in ids], [self.tokens[i] for i in ids]
        for word, low, high in zip(words, at, at[1:], strict=False):
            self.known_ids[word] = ",".join(decimal[low:high])
            self.known_bytes[word] = b"".join(tokens[low:high])

    def encode(self, texts: list[str]) -> list[tuple[str, int, bytes]]:
        """For each text (decimal ids joined by commas, their number, the bytes they decode to)."""
        if len(self.known_ids) > _CACHE:
            self.forget()
        split = [self._words(t) if t else [] for t in texts]
        new = set().union(*split).difference(self.known_ids)
        if new:
            self._learn(list(new))
        ids, decoded = self.known_ids.__getitem__, self.known_bytes.__getitem__
        out = []
        for words in split:
            joined = ",".join(map(ids, words))
            out.append((joined, joined.count(",") + bool(joined), b"".join(map(decoded, words))))
        for word in new:
            if len(word) > _SHORT:
                del self.known_ids[word], self.known_bytes[word]
        return out


@lru_cache(maxsize=2)
def encoder(ranks_path: str, pattern_text: str) -> Encoder:
    return Encoder(ranks_path, pattern_text)


def _digests(ids: str, n: int, decoded: bytes) -> tuple[int, str, str]:
    return n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded).hexdigest()


def _slices(batch: pa.RecordBatch, column: str, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most `rows` rows and, but for a single longer text, _AT_ONCE characters."""
    size = np.cumsum(pc.utf8_length(batch.column(column)).to_numpy())
    low = 0
    while low < batch.num_rows:
        most = np.searchsorted(size, (size[low - 1] if low else 0) + _AT_ONCE, "right")
        high = min(low + rows, max(low + 1, int(most)))
        yield batch.slice(low, high - low)
        low = high


def _whole(path: str, pattern_text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern_text)
        for batch in batches:
            for part in _slices(batch, "_text"):
                out = list(zip(*(_digests(*e) for e in own.encode(part.column("_text").to_pylist())), strict=True))
                yield pa.RecordBatch.from_arrays([part.column("_copies"), part.column("_id"), pa.array(out[0], pa.int64()), pa.array(out[1]), pa.array(out[2])], names=["_copies", "_id", *_DIGESTS])

    return run


def _boundaries(path: str, pattern_text: str, step: int):
    """Adds a chunk's pre-token boundaries in the overlap at its head and in that at its tail,
    relative to the overlap's first character. A chunk has one character beyond its tail, and
    boundaries at its very end are left out, so that none depends on what follows the chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern_text)
        for batch in batches:
            heads, tails = [], []
            for text in batch.column("_chunk"):
                text = text.as_py()
                ends = [e for m in own.pattern.finditer(text) if (e := m.end()) < len(text)]
                heads.append([e for e in ends if e < OVERLAP])
                tails.append([e - step for e in ends if e >= step])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(heads, pa.list_(pa.int32())), pa.array(tails, pa.list_(pa.int32()))], names=[*batch.schema.names, "_head", "_tail"])

    return run


def _pieces(path: str, pattern_text: str):
    """Encodes what lies between a chunk's two stitches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern_text)
        for batch in batches:
            cols = list(zip(*own.encode(batch.column("_part").to_pylist()), strict=True)) or [[], [], []]
            names = [n for n in batch.schema.names if n != "_part"]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary())], names=[*names, "_ids", "_n", "_bytes"])

    return run


def encode_documents(docs: DataFrame, ranks_path: str, pattern_text: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """One row per input row: id, n_tokens, ids_sha256, decoded_sha256.

    The ids are those of byte-level BPE by the ranks, each match of the pattern merged on its
    own; the second digest is of the bytes that the ids decode to.

    Texts of at most `chunk` characters are encoded where they are read. Longer ones are cut into
    chunks that overlap by OVERLAP characters, pre-tokenised in parallel tasks. A chunk is
    stitched to the next at the first boundary that both have in the overlap: matching goes on
    in the same way from any common boundary. The parts between stitches are encoded in
    parallel, and digests are taken over a document's parts in order. A document of which two
    chunks have no common boundary (as a run of letters longer than the overlap) is encoded whole.

    Null text counts as empty: 0 ids. Null ids are kept. Rows that repeat id and text are
    encoded once and returned as often as they occur. Empty table: no rows. Further columns are
    ignored.
    """
    docs = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    id_type = docs.schema["_id"].dataType.simpleString()
    digests = f"_copies bigint, _id {id_type}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    whole = _whole(ranks_path, pattern_text)
    short = docs.where(F.char_length("_text") <= chunk).select(F.lit(1).cast("bigint").alias("_copies"), "_id", "_text").mapInArrow(whole, digests)

    # Of a chunk, the last OVERLAP + 1 characters are the head of the next and one more.
    step = chunk - OVERLAP
    key = ["_id", "_sha", "_copies"]
    long = docs.where(F.char_length("_text") > chunk).groupBy("_id", F.sha2("_text", 256).alias("_sha"), "_text").agg(F.count("*").alias("_copies"))
    numbers = F.sequence(F.lit(0), F.ceil((F.char_length("_text") - OVERLAP) / step).cast("int") - 1)
    chunks = long.select(*key, "_text", F.explode(numbers).alias("_no")).select(*key, "_no", F.substring("_text", F.col("_no") * step + 1, F.lit(chunk + 1)).alias("_chunk"))
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = f"_id {id_type}, _sha string, _copies bigint, _no int"
    ends = chunks.repartition(tasks, "_sha", "_no").mapInArrow(_boundaries(ranks_path, pattern_text, step), columns + ", _chunk string, _head array<int>, _tail array<int>")
    order = Window.partitionBy("_id", "_sha").orderBy("_no")
    start = F.when(F.lag("_no").over(order).isNull(), 0).otherwise(F.array_min(F.array_intersect(F.lag("_tail").over(order), "_head")))
    end = F.when(F.lead("_no").over(order).isNull(), F.char_length("_chunk")).otherwise(F.array_min(F.array_intersect("_tail", F.lead("_head").over(order))) + step)
    stitched = ends.select(*key, "_no", "_chunk", start.alias("_from"), end.alias("_to"))
    torn = F.col("_from").isNull() | F.col("_to").isNull()
    parts = stitched.select(*key, "_no", torn.alias("_torn"), F.when(torn, F.lit("")).otherwise(F.substring("_chunk", F.col("_from") + 1, F.col("_to") - F.col("_from"))).alias("_part"))
    encoded = parts.mapInArrow(_pieces(ranks_path, pattern_text), columns + ", _torn boolean, _ids string, _n bigint, _bytes binary")

    together = encoded.groupBy(*key).agg(F.max("_torn").alias("_torn"), F.sum("_n").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("_no", "_ids", "_bytes"))).alias("_parts"))
    ids = F.array_join(F.filter(F.transform("_parts", lambda p: p["_ids"]), lambda s: s != ""), ",")
    decoded = F.aggregate("_parts", F.lit(b""), lambda a, p: F.concat(a, p["_bytes"]))
    digested = together.select(*key, "_torn", "n_tokens", F.when(~F.col("_torn"), F.sha2(ids, 256)).alias("ids_sha256"), F.when(~F.col("_torn"), F.sha2(decoded, 256)).alias("decoded_sha256"))
    digested = scratch(digested, "bpe-long")  # a row per long document, so that parts are encoded once
    joined = digested.where("NOT _torn").select("_copies", "_id", *_DIGESTS)
    again = long.join(digested.where("_torn").select("_sha").distinct(), "_sha", "left_semi").select("_copies", "_id", "_text").mapInArrow(whole, digests)
    out = short.unionByName(joined).unionByName(again)
    return out.select(F.col("_id").alias(id_col), *_DIGESTS, F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))).alias("_copy")).drop("_copy")
