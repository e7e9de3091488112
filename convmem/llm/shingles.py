"""Word shingles of a text as 64-bit hashes, in vectorised form; small helpers used in tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

_SPACES = np.zeros(256, bool)
_SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RNG = np.random.default_rng(20240501)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ODD = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, np.uint64)


def _power(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        size = max(n, 256)
        steps = np.full(size, np.uint64(0xD6E8FEB86659FD93))
        steps[0] = 1
        _powers = np.cumprod(steps, dtype=np.uint64)
    return _powers[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str, lower: bool = True) -> np.ndarray:
    """A hash for each word (run of characters other than space, tab, LF, VT, FF, CR), in order."""
    b = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    if lower:
        b = _LOWER[b]
    inside = ~_SPACES[b]
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edges[0::2], edges[1::2]
    if not len(starts):
        return np.empty(0, np.uint64)
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    at = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    values = _BYTE[b[inside]] * _power(int(lengths.max()))[at]
    return mix(np.add.reduceat(values, first) + lengths.astype(np.uint64) * _STEP)


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of k consecutive lower-cased words; with fewer words the whole
    sequence is one shingle; without words the set is empty."""
    words = word_hashes(text) if text else np.empty(0, np.uint64)
    if not len(words):
        return words
    width = min(k, len(words))
    n = len(words) - width + 1
    total = np.zeros(n, np.uint64)
    for i in range(width):
        total += words[i : i + n] * _ODD[i]  # the number of words shows in the multipliers used
    return np.unique(mix(total))


def sorted_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The runs of equal key of a sorted stream of batches, each run whole."""
    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if rest is not None and rest.num_rows:
            table = pa.concat_tables([rest, table]).combine_chunks()
        keys = table.column(key).to_numpy()
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        start = 0
        for cut in cuts:
            yield table.slice(start, cut - start)
            start = int(cut)
        rest = table.slice(start)
    if rest is not None and rest.num_rows:
        yield rest


def map_texts(fields: list[tuple[str, pa.DataType]], row: Callable[[str | None], tuple], keep: list[str]) -> Callable:
    """A mapInArrow function that keeps some columns and adds row(text)'s values as fields."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                out = list(zip(*(row(x.as_py()) for x in part.column("_text")), strict=True))
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in keep] + [pa.array(v, t) for v, (_, t) in zip(out, fields, strict=True)],
                    names=[*keep, *(n for n, _ in fields)],
                )

    return run
