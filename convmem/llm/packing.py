"""Packing of token sequences by hierarchical residual best-fit rounds."""

from __future__ import annotations

import gc
import json
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from convmem.llm.batches import released
from convmem.plans.scratch import scratch

#: Items that one task packs in a merge round.
TASK_ITEMS = 200_000
#: A bin with at most this many free tokens is emitted.
NEARLY_FULL = 8
#: Words, and pieces, of a generation that a task remembers, and the longest of them in characters:
#: two generations of short strings bound the bytes.
_REMEMBERED, _SHORT = 90_000, 32
#: Latin text: what the pattern below covers. Its letters keep to this range in lower case, have no
#: decomposition to undo, and are letters or numbers in every version of Unicode.
_OTHER = re.compile("[^\x00-\u012f\u0131-\u017f]")
_L, _N, _S = "a-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u017f", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+")
#: The byte-level alphabet: printable bytes stand for themselves, the others for what follows Latin-1.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_ALPHABET = dict(zip([b for b in range(256) if b not in _PLAIN], range(256, 512)))
#: The tokenizer settings that make _PIECES the tokenizer's own pieces; fixed values.
_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class Remembered(dict):
    """Values of make(key); older keys that are not asked for again are forgotten."""

    def __init__(self, make: Callable[[str], bytes], most: int = _REMEMBERED):
        super().__init__()
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, key: str) -> bytes:
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= _SHORT:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


class TextEncoder:
    """Token ids of whole texts, as the library gives them without special tokens added.

    A file whose normalizer and pre-tokenizer are those that _PIECES stands for takes the short way:
    pieces never span white space, so a text's ids are those of its blank-separated words in a
    row. A new Latin word is cut into pieces by one pattern, any other is normalised and cut by the
    library; new pieces go to the library's BPE model. Texts that hold an added token of the file,
    and all texts under any other file, are encoded by the library as a whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            settings = json.load(f)
        normalizer, splitter = settings.get("normalizer") or {}, settings.get("pre_tokenizer") or {}
        steps = splitter.get("pretokenizers") or [{}]
        self.short = (
            [n["type"] for n in normalizer.get("normalizers", [])] == _NORMALIZERS and steps[0].get("pattern") == {"Regex": _PATTERN}
            and [(x["type"], x.get("invert"), x.get("use_regex")) for x in steps] == [("Split", True, None), ("ByteLevel", None, False)] and settings["model"]["type"] == "BPE"
        )
        if self.short:
            self.normalize, self.split, self.model = tokenizer.normalizer.normalize_str, tokenizer.pre_tokenizer.pre_tokenize_str, tokenizer.model
        self.words, self.pieces = Remembered(self._word), Remembered(self._piece)

    def _piece(self, piece: str) -> bytes:
        letters = piece if piece.isascii() and piece.isprintable() else piece.encode("utf-8").decode("latin-1").translate(_ALPHABET)
        ids = [t.id for t in self.model.tokenize(letters)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _word(self, word: str) -> bytes:
        if word.isascii() and word.isalpha():
            low = word.lower()
            return self._piece(low) if low == word else self.pieces[low]
        if _OTHER.search(word):
            return b"".join([np.array([t.id for t in self.model.tokenize(own)], "<u4").tobytes() for own, _ in self.split(self.normalize(word))])
        return b"".join(map(self.pieces.__getitem__, _PIECES.findall(word.lower())))

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers; null is empty. Arrow splits the texts and
        numbers their words, so that each distinct word of a batch is looked up once."""
        texts = pc.fill_null(texts, "")
        whole = pa.array(np.full(len(texts), not self.short))
        for content in self.added:
            whole = pc.or_(whole, pc.match_substring(texts, content))
        split = pc.ascii_split_whitespace(pc.if_else(whole, "", texts))
        words = split.flatten().dictionary_encode()
        gc.disable()  # nothing here is cyclic, and collections walk all that is remembered
        try:
            found = list(map(self.words.__getitem__, words.dictionary.to_pylist()))
        finally:
            gc.enable()
        # Positions within a batch fit 32 bits, as batches are bounded by bytes.
        size = np.fromiter(map(len, found), np.int32, len(found)) // 4
        pool, start = np.frombuffer(b"".join(found), "<u4"), np.cumsum(size, dtype=np.int32) - size
        at = words.indices.to_numpy()
        ends = np.append(np.int32(0), np.cumsum(size[at], dtype=np.int32))
        place = np.repeat(start[at] - ends[:-1], size[at])
        place += np.arange(ends[-1], dtype=np.int32)
        ids = pool[place]
        bounds = ends[split.offsets.to_numpy() - split.offsets[0].as_py()]
        out = [ids[low:high].tobytes() for low, high in zip(bounds, bounds[1:])]
        for i in np.flatnonzero(whole.to_numpy(zero_copy_only=False)):
            out[i] = np.array(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, "<u4").tobytes()
        return out


def _pieces(path: str, length: int, end_id: int):
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = TextEncoder(path)
        for batch in batches:
            for low in range(0, batch.num_rows, 1_000):
                part = batch.slice(low, 1_000)
                out: list[tuple] = []
                for i, ids in zip(part.column("_id").to_pylist(), encoder.encode(part.column("_text")), strict=True):
                    ids += end
                    for piece, at in enumerate(range(0, len(ids), 4 * length)):
                        own = ids[at : at + 4 * length]
                        out.append((i, piece, at // 4, len(own) // 4, zlib.crc32(own)))
                cols = list(zip(*out, strict=True))
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["_id", "piece", "start", "length", "ids_crc32"])

    return run


def best_fit(sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item by best-fit decreasing: largest first, each into the open bin
    with the least room that suffices. A bit set of the rooms in use makes a step O(1)."""
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(length + 1)]
    rooms, n = 0, 0
    for item in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[item])
        above = rooms >> size
        if above:
            room = size + (above & -above).bit_length() - 1
            own = open_bins[room].pop()
            if not open_bins[room]:
                rooms ^= 1 << room
        else:
            room, own = length, n
            n += 1
        bins[item], offsets[item] = own, length - room
        if left := room - size:
            open_bins[left].append(own)
            rooms |= 1 << left
    return bins, offsets


def _pack(length: int, round_no: int, size: str):
    """Packs a partition's items; bins are named by round, partition and number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if not sum(b.num_rows for b in got):
            return
        table = pa.Table.from_batches(got)
        bins, offsets = best_fit(table.column(size).to_numpy(), length)
        name = (round_no << 56) + (TaskContext.get().partitionId() << 32)
        table = table.append_column("_bin", pa.array(bins + name)).append_column("_offset", pa.array(offsets))
        yield from table.to_batches(max_chunksize=50_000)

    return run


def pack_documents(docs: DataFrame, tokenizer_path: str, length: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    A document's tokens are its text's ids followed by end_id; documents longer than `length`
    are cut into pieces of it, shorter ones are never cut.

    Partitions pack their pieces best-fit; bins with at most NEARLY_FULL free tokens are
    emitted. Underfull bins become items of the next round, dealt to tasks of TASK_ITEMS items,
    until one task holds the rest or a whole round saves no bin. Every round's placement is
    a written table, so what a lost executor had placed stays as it was; only (bin, fill) rows
    move between rounds, and placements are composed by joins on the bin.

    Null or empty text: the end token alone. Rows that repeat an id are separate documents.
    Ties in size: the earlier row first. Empty table: no rows. Further columns are ignored.
    """
    texts = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).alias("_text"))
    item = "_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
    items = scratch(texts.mapInArrow(released(_pieces(tokenizer_path, length, end_id)), item), "pack-items")
    placed = scratch(items.mapInArrow(released(_pack(length, 1, "length")), item + ", _bin bigint, _offset bigint"), "pack-round1")
    fills = placed.groupBy("_bin").agg(F.sum("length").alias("_fill"))
    rounds: list[DataFrame] = []
    while True:
        rest = scratch(fills.where(F.col("_fill") < length - NEARLY_FULL).select(F.col("_bin").alias("_child"), "_fill"), "pack-rest")
        n = rest.count()
        if n < 2:
            break
        tasks = -(-n // TASK_ITEMS)
        merged = rest.repartition(tasks).mapInArrow(released(_pack(length, len(rounds) + 2, "_fill")), "_child bigint, _fill bigint, _bin bigint, _offset bigint")
        merged = scratch(merged, "pack-merge")
        rounds.append(merged.select("_child", "_bin", "_offset"))
        fills = merged.groupBy("_bin").agg(F.sum("_fill").alias("_fill"))
        if tasks == 1 or fills.count() == n:
            break
    # A child's place within the last round, composed from the last round back to the second.
    moved: DataFrame | None = None
    for step in reversed(rounds):
        if moved is not None:
            up = moved.select(F.col("_child").alias("_bin"), F.col("_bin").alias("_top"), F.col("_offset").alias("_more"))
            step = step.join(up, "_bin", "left").select("_child", F.coalesce("_top", "_bin").alias("_bin"), (F.col("_offset") + F.coalesce("_more", F.lit(0))).alias("_offset"))
        moved = step
    if moved is not None:
        up = moved.select(F.col("_child").alias("_bin"), F.col("_bin").alias("_top"), F.col("_offset").alias("_more"))
        placed = placed.join(up, "_bin", "left").withColumn("_offset", F.col("_offset") + F.coalesce("_more", F.lit(0))).withColumn("_bin", F.coalesce("_top", "_bin"))
    return placed.select(F.col("_id").alias(id_col), "piece", "start", "length", "ids_crc32", F.col("_bin").alias("sequence_id"), F.col("_offset").alias("offset"))
