"""Token-id files: a concatenated id array a shard, with its documents' boundaries in Elias-Fano code.

A shard is one `.ids` file (little-endian ids of 2 or 4 bytes) and one `.ef` file that holds two
non-decreasing sequences, the documents' ends in the id array and their doc_ids. A manifest names the
shards in ascending order of doc_id. Spark writes and reads them as the data source `token_ids`.
"""

from __future__ import annotations

import json
import posixpath
import struct
import uuid
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from convmem.llm.batches import released
from convmem.llm.packing import TextEncoder
from convmem.plans.scratch import shared_dir

#: Ids and documents of a shard at most (but never less than one document), and ids that a reading task takes.
SHARD_IDS, SHARD_DOCS, READ_IDS = 64 << 20, 4 << 20, 8 << 20
#: Ids that a task hands on at once.
_BATCH_IDS = 1 << 19
#: Every _EVERY-th element's place in the upper bits is kept.
_EVERY = 256
_HEAD = struct.Struct("<QQqQ")
MANIFEST = "manifest.json"

Read = Callable[[int, int], bytes]


class EliasFano:
    """A non-decreasing sequence of n integers in about n * (2 + log2(range / n)) bits.

    Each value's lower bits stand in a packed array; its upper bits are a one in a bit vector, after as
    many zeros as they count. The i-th one lies at upper + i, so select(i) gives the value back; 32-bit
    samples of every 256th one's place bound what a look-up reads. Bytes come through read(offset,
    size), so a file's slices serve as well as memory.
    """

    def __init__(self, read: Read, start: int = 0):
        self.read = read
        self.n, self.bits, self.base, self.upper_bytes = _HEAD.unpack(read(start, _HEAD.size))
        self.samples_at = start + _HEAD.size
        self.lower_at = self.samples_at + 4 * -(-self.n // _EVERY)
        self.upper_at = self.lower_at + -(-self.n * self.bits // 8)
        self.end = self.upper_at + self.upper_bytes

    @staticmethod
    def encode(values: np.ndarray) -> bytes:
        """values: int64, non-decreasing, less than 2 ** 63 apart."""
        n = len(values)
        base = int(values[0]) if n else 0
        own = (values - base).astype(np.uint64)
        bits = max(0, (int(own[-1]) // n).bit_length() - 1) if n else 0
        lower = np.zeros(-(-n * bits // 8), np.uint8)
        step = 1 << 16  # a multiple of eight, so that slices end between bytes
        for low in range(0, n if bits else 0, step):
            part = (own[low : low + step, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
            packed = np.packbits(part.astype(np.uint8).ravel(), bitorder="little")
            lower[low * bits // 8 :][: len(packed)] = packed
        place = (own >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        upper = np.zeros(int(place[-1]) // 8 + 1 if n else 0, np.uint8)
        np.bitwise_or.at(upper, place >> 3, np.left_shift(1, place & 7).astype(np.uint8))
        return _HEAD.pack(n, bits, base, len(upper)) + place[::_EVERY].astype("<u4").tobytes() + lower.tobytes() + upper.tobytes()

    def select(self, low: int, high: int) -> np.ndarray:
        """Places of the ones low … high - 1 in the upper bits."""
        first, last = low // _EVERY, -(-high // _EVERY)
        samples = np.frombuffer(self.read(self.samples_at + 4 * first, 4 * (min(last + 1, -(-self.n // _EVERY)) - first)), "<u4").astype(np.int64)
        begin = int(samples[0]) // 8
        end = int(samples[last - first]) // 8 + 1 if last - first < len(samples) else self.upper_bytes
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(self.read(self.upper_at + begin, end - begin), np.uint8), bitorder="little")) + 8 * begin
        ones = ones[ones >= samples[0]]
        return ones[low - first * _EVERY : high - first * _EVERY]

    def values(self, low: int, high: int) -> np.ndarray:
        """The elements low … high - 1, as int64."""
        if low >= high:
            return np.empty(0, np.int64)
        out = self.select(low, high) - np.arange(low, high)
        if self.bits:
            begin, end = low * self.bits // 8, -(-high * self.bits // 8)
            bits = np.unpackbits(np.frombuffer(self.read(self.lower_at + begin, end - begin), np.uint8), bitorder="little")
            own = bits[low * self.bits - 8 * begin :][: (high - low) * self.bits].reshape(high - low, self.bits)
            out = (out << self.bits) | (own.astype(np.int64) << np.arange(self.bits)).sum(axis=1)
        return out + self.base


@dataclass
class Shard:
    """nulls: its first documents have no id. first and last: the least and the largest other id."""

    name: str
    part: int
    number: int
    docs: int
    ids: int
    nulls: int
    first: int | None
    last: int | None


@dataclass
class Committed(WriterCommitMessage):
    shards: list[dict]


@dataclass
class DocumentRange(InputPartition):
    """Documents low … high - 1 of a shard whose first id is the `start`-th of all."""

    shard: Shard
    start: int
    low: int
    high: int


def _folder(options: dict) -> tuple[fs.FileSystem, str]:
    if "path" not in options:
        raise ValueError("token_ids needs a path")
    return fs.FileSystem.from_uri(options["path"]) if "://" in options["path"] or options["path"].startswith("file:") else (fs.LocalFileSystem(), options["path"])


class _Open:
    """A shard that a task is writing."""

    def __init__(self, store: fs.FileSystem, folder: str, part: int, number: int):
        self.store, self.part, self.number = store, part, number
        self.name = f"part-{part:05}-{number:04}-{uuid.uuid4().hex}"
        self.path = posixpath.join(folder, self.name)
        self.out = store.open_output_stream(self.path + ".ids")
        self.sizes: list[np.ndarray] = []
        self.keys: list[np.ndarray] = []
        self.docs = self.ids = self.nulls = 0
        self.last: int | None = None

    def add(self, keys: np.ndarray, nulls: int, sizes: np.ndarray, data: bytes) -> None:
        if (np.diff(keys, prepend=self.last if self.last is not None else keys[:1]) < 0).any() or (nulls and self.last is not None):
            raise ValueError("token files must be written in ascending order of doc_id")
        self.last = int(keys[-1]) if len(keys) else self.last
        self.out.write(data)
        self.sizes.append(sizes)
        self.keys.append(keys)
        self.docs, self.ids, self.nulls = self.docs + len(sizes), self.ids + int(sizes.sum()), self.nulls + nulls

    def close(self) -> Shard:
        self.out.close()
        keys = np.concatenate(self.keys)
        ends = EliasFano.encode(np.cumsum(np.concatenate(self.sizes), dtype=np.int64))
        with self.store.open_output_stream(self.path + ".ef") as f:
            f.write(ends + EliasFano.encode(keys))
        return Shard(self.name, self.part, self.number, self.docs, self.ids, self.nulls, int(keys[0]) if len(keys) else None, int(keys[-1]) if len(keys) else None)


class TokenIdWriter(DataSourceArrowWriter):
    """Rows (doc_id, ids) that come in ascending order within and across partitions, ids as little-endian
    integers of `width` bytes. Each attempt of a task
    writes files of its own; those of committed attempts are named by the manifest, the only file
    that readers start from."""

    def __init__(self, options: dict, overwrite: bool):
        self.options, self.overwrite = options, overwrite
        self.width = int(options.get("width", 4))
        self.most_ids, self.most_docs = int(options.get("shard_ids", SHARD_IDS)), int(options.get("shard_docs", SHARD_DOCS))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Committed:
        store, folder = _folder(self.options)
        store.create_dir(folder, recursive=True)
        part, done, own = TaskContext.get().partitionId(), [], None
        for batch in iterator:
            keys, ids = batch.column("doc_id"), batch.column("ids")
            sizes = np.array([x.as_buffer().size // self.width for x in ids], np.int64)
            low = 0
            while low < batch.num_rows:
                own = own or _Open(store, folder, part, len(done))
                room = np.searchsorted(np.cumsum(sizes[low:]), self.most_ids - own.ids, "right")
                high = min(batch.num_rows, low + max(int(room), own.docs == 0), low + self.most_docs - own.docs)
                if high > low:
                    part_keys = keys.slice(low, high - low)
                    data = b"".join([x.as_buffer().to_pybytes() for x in ids.slice(low, high - low)])
                    own.add(part_keys.drop_null().to_numpy(zero_copy_only=False).astype(np.int64), part_keys.null_count, sizes[low:high], data)
                if high < batch.num_rows:
                    done.append(own.close())
                    own = None
                low = high
        if own is not None:
            done.append(own.close())
        return Committed([asdict(s) for s in done])

    def commit(self, messages: list[Committed | None]) -> None:
        store, folder = _folder(self.options)
        store.create_dir(folder, recursive=True)
        path = posixpath.join(folder, MANIFEST)
        if store.get_file_info(path).type != fs.FileType.NotFound and not self.overwrite:
            raise ValueError(f"{folder} holds token files already")
        shards = sorted((s for m in messages if m is not None for s in m.shards), key=lambda s: (s["part"], s["number"]))
        last = None
        for s in shards:
            if last is not None and (s["nulls"] or (s["first"] is not None and s["first"] < last)):
                raise ValueError("token files must be written in ascending order of doc_id")
            last = s["last"] if s["last"] is not None else last
        with store.open_output_stream(path) as f:
            f.write(json.dumps({"width": self.width, "shards": shards}).encode())

    def abort(self, messages: list[Committed | None]) -> None:
        store, folder = _folder(self.options)
        for m in messages:
            for s in m.shards if m is not None else ():
                for end in (".ids", ".ef"):
                    if store.get_file_info(name := posixpath.join(folder, s["name"] + end)).type != fs.FileType.NotFound:
                        store.delete_file(name)


class TokenIdReader(DataSourceReader):
    """(doc_id, start, n_tokens, ids): a partition is a range of a shard's documents, of about `read_ids` ids; it reads its
    boundaries by select, and its slice of the id array."""

    def __init__(self, options: dict):
        self.options = options
        self.read_ids = int(options.get("read_ids", READ_IDS))

    def partitions(self) -> list[DocumentRange]:
        store, folder = _folder(self.options)
        with store.open_input_file(posixpath.join(folder, MANIFEST)) as f:
            shards = [Shard(**s) for s in json.loads(f.read())["shards"]]
        out, start = [], 0
        for s in shards:
            pieces = min(s.docs, -(-s.ids // self.read_ids)) or 1
            out += [DocumentRange(s, start, s.docs * i // pieces, s.docs * (i + 1) // pieces) for i in range(pieces)]
            start += s.ids
        return out or [DocumentRange(Shard("", 0, 0, 0, 0, 0, None, None), 0, 0, 0)]

    def read(self, partition: DocumentRange) -> Iterator[pa.RecordBatch]:
        if partition.low == partition.high:
            return
        store, folder = _folder(self.options)
        own = partition.shard
        path = posixpath.join(folder, own.name)
        with store.open_input_file(path + ".ef") as f, store.open_input_file(path + ".ids") as data:
            slices: Read = lambda offset, size: f.read_at(size, offset)
            ends = EliasFano(slices)
            keys = EliasFano(slices, ends.end)
            low, high = partition.low, partition.high
            bounds = np.concatenate([ends.values(low - 1, low) if low else np.zeros(1, np.int64), ends.values(low, high)])
            named = keys.values(max(0, low - own.nulls), max(0, high - own.nulls))
            ids = pa.concat_arrays([pa.nulls(high - low - len(named), pa.int64()), pa.array(named)])
            width = data.size() // own.ids if own.ids else 4
            at = 0
            while at < high - low:
                to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + _BATCH_IDS, "right")) - 1)
                raw = np.frombuffer(data.read_at(width * int(bounds[to] - bounds[at]), width * int(bounds[at])), f"<u{width}").astype("<u4").tobytes()
                cuts = 4 * (bounds[at : to + 1] - bounds[at])
                texts = pa.Array.from_buffers(pa.large_binary(), to - at, [None, pa.py_buffer(cuts.tobytes()), pa.py_buffer(raw)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([ids.slice(at, to - at), pa.array(bounds[at:to] + partition.start), pa.array(np.diff(bounds[at : to + 1])), texts], names=["doc_id", "start", "n_tokens", "ids"])
                at = to


class TokenIds(DataSource):
    """`token_ids`: options path, width (bytes of an id), shard_ids, shard_docs, read_ids."""

    @classmethod
    def name(cls) -> str:
        return "token_ids"

    def schema(self) -> str:
        return "doc_id bigint, start bigint, n_tokens bigint, ids binary"

    def writer(self, schema: StructType, overwrite: bool) -> TokenIdWriter:
        return TokenIdWriter(dict(self.options), overwrite)

    def reader(self, schema: StructType) -> TokenIdReader:
        return TokenIdReader(dict(self.options))


@lru_cache(maxsize=1)
def _encoder(path: str) -> TextEncoder:
    """One for all tasks of a process; what it remembers is bounded."""
    return TextEncoder(path)


def _narrow(ids: bytes, width: int) -> bytes:
    own = np.frombuffer(ids, "<u4")
    if width == 2 and len(own) and int(own.max()) > 0xFFFF:
        raise ValueError("ids beyond 65,535 need 4 bytes")
    return own.astype(f"<u{width}").tobytes()


def _encode(path: str, end_id: int, bounds: np.ndarray, width: int):
    """Adds each text's ids and the range of doc_ids that it falls into. Rows of an id that fills
    several ranges are dealt to all of them in turn."""
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, turn = _encoder(path), 0
        for batch in batches:
            for low in range(0, batch.num_rows, 1_000):
                part = batch.slice(low, 1_000)
                null = part.column("doc_id").is_null().to_numpy(zero_copy_only=False)
                keys = part.column("doc_id").fill_null(0).to_numpy()
                first, last = np.searchsorted(bounds, keys, "left"), np.searchsorted(bounds, keys, "right")
                place = np.where(null, 0, first + (turn + np.arange(len(keys))) % (last - first + 1))
                turn += len(keys)
                ids = pa.array([_narrow(x + end, width) for x in encoder.encode(part.column("_text"))], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids, pa.array(place, pa.int32())], names=["doc_id", "ids", "_place"])

    return run


def write_token_ids(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = 2, id_bytes: int = 2, parts: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the ids of all texts, each followed by end_id, as token files under path, in ascending
    order of the id (null ids first; rows that share an id in any order).

    Ids are cut into `parts` ranges by their quantiles, read from the id column alone; texts are encoded where they are
    read, and their ids (not the texts) are dealt to the ranges, sorted and streamed to the shards. A task
    begins a new shard when one is full, so neither files nor what a task holds grow with a range.
    An id that fills several ranges is dealt to all of them.

    Null and empty texts: end_id alone. Empty table: a manifest without shards. Further columns are ignored.
    Ids of the column must be integers; token ids beyond id_bytes are an error.
    """
    spark = docs.sparkSession
    spark.dataSource.register(TokenIds)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("_text"))
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / parts for i in range(1, parts)]
    cuts = rows.agg(F.percentile_approx("doc_id", shares, 100 * parts)).first()[0] if shares else []
    run = released(_encode(tokenizer_path, end_id, np.array(cuts or [], np.int64), id_bytes))
    dealt = rows.mapInArrow(run, "doc_id bigint, ids binary, _place int").repartitionById(parts, F.col("_place"))
    ordered = dealt.sortWithinPartitions(F.asc_nulls_first("doc_id")).select("doc_id", "ids")
    ordered.write.format("token_ids").option("path", path).option("width", id_bytes).mode("append").save()


def read_token_ids(spark: SparkSession, path: str, read_ids: int = READ_IDS) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of token files: start counts the ids of all documents before, and
    ids are little-endian unsigned 32-bit integers. No order of rows is promised."""
    spark.dataSource.register(TokenIds)
    return spark.read.format("token_ids").option("path", path).option("read_ids", read_ids).load()


def token_id_table(docs: DataFrame, tokenizer_path: str, path: str | None = None, **settings) -> DataFrame:
    """Writes docs as token files (under the shared folder where no path is given) and reads them back."""
    path = path or f"{shared_dir(docs.sparkSession)}/convmem-token-ids-{uuid.uuid4().hex}"
    write_token_ids(docs, tokenizer_path, path, **settings)
    return read_token_ids(docs.sparkSession, path)
