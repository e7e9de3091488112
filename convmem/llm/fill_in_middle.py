"""Fill-in-middle transformation of whole texts with pyarrow.compute, and the way back in Spark."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from convmem.llm.batches import released

#: Marks before the prefix, the suffix and the middle; fixed values.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: A unit: white space and the word after it, or white space without a word.
UNIT = r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+)"
#: A byte that UTF-8 never has marks where units end.
_END = b"\xff"


def units(texts: pa.Array) -> pa.ListArray:
    """Each text's units as a list of bytes; joined, they are the text."""
    marked = pc.replace_substring_regex(texts.cast(pa.binary()), UNIT, b"\\1" + _END)
    split = pc.split_pattern(marked, _END)  # what follows the last end is empty
    size = pc.list_value_length(split).to_numpy() - 1
    kept = pc.list_flatten(split).filter(pa.array(_ordinals(size + 1) < np.repeat(size, size + 1)))
    return pa.ListArray.from_arrays(_offsets(size), kept)


def _offsets(sizes: np.ndarray) -> pa.Array:
    return pa.array(np.append(0, np.cumsum(sizes)), pa.int32())


def _ordinals(sizes: np.ndarray) -> np.ndarray:
    """0, 1, 2, … for each list of the given sizes in a row."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _transform(spm_of_100: int, fim_of_100: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("_text")
            h = [batch.column(f"_h{i}").to_numpy() for i in (1, 2, 3, 4)]
            own = units(text)
            n = pc.list_value_length(own).to_numpy().astype(np.int64)
            low, high = np.minimum(h[0] % (n + 1), h[1] % (n + 1)), np.maximum(h[0] % (n + 1), h[1] % (n + 1))
            # Every unit's role follows from its ordinal within its text.
            flat, parent, at = pc.list_flatten(own), pc.list_parent_indices(own).to_numpy(), _ordinals(n)
            role = (at >= low[parent]).astype(np.int8) + (at >= high[parent])
            prefix, middle, suffix = (
                pc.binary_join(pa.ListArray.from_arrays(_offsets(np.bincount(parent[role == r], minlength=len(n))), flat.filter(pa.array(role == r))), b"") for r in range(3)
            )
            marked = np.zeros(len(n), bool)
            for mark in (PREFIX, SUFFIX, MIDDLE):
                marked |= pc.match_substring(text, mark).to_numpy(zero_copy_only=False)
            plain = (n == 0) | marked | (h[2] % 100 >= fim_of_100)
            spm = ~plain & (h[3] % 100 < spm_of_100)
            p, s, m = (pa.scalar(x.encode(), pa.binary()) for x in (PREFIX, SUFFIX, MIDDLE))
            psm_text = pc.binary_join_element_wise(p, prefix, s, suffix, m, middle, b"")
            spm_text = pc.binary_join_element_wise(s, suffix, p, prefix, m, middle, b"")
            plain, spm = pa.array(plain), pa.array(spm)
            output = pc.if_else(plain, text.cast(pa.binary()), pc.if_else(spm, spm_text, psm_text)).cast(pa.string())
            form = pc.if_else(plain, "plain", pc.if_else(spm, "spm", "psm"))
            chars = [pc.if_else(plain, pa.scalar(None, pa.int64()), pc.utf8_length(x.cast(pa.string())).cast(pa.int64())) for x in (prefix, middle)]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(n), form, *chars, output], names=["_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return run


def fill_in_middle(docs: DataFrame, seed: int = 42, fim_of_100: int = 50, spm_of_100: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n (units), form (plain, psm or spm), prefix_chars, middle_chars
    (code points; null where plain) and output, the training text.

    Cuts and form follow from the SHA-256 of `seed:id`, so that a document is always treated alike:
    the first two groups of eight hex digits choose how many units lie before the middle and before the
    suffix, the third whether the text is transformed (`fim_of_100` in 100), the fourth whether the suffix
    comes first (`spm_of_100` in 100). A text that holds one of the marks stays plain.

    Null text counts as empty: 0 units, plain. Null id: hashed as an empty id. Repeated rows agree. Empty
    table: no rows. Further columns are ignored. A task holds one batch, bounded in bytes, but never less
    than one whole text.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    hashes = [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("bigint").alias(f"_h{i + 1}") for i in range(4)]
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), *hashes)
    out = rows.mapInArrow(released(_transform(spm_of_100, fim_of_100)), f"_id {rows.schema['_id'].dataType.simpleString()}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")
    return out.select(F.col("_id").alias(id_col), "n", "form", "prefix_chars", "middle_chars", "output")


def restored(output: Column, form: Column) -> Column:
    """The text that a transformed one was made from. As a transformed text holds each mark once,
    parts are what lies between them."""
    between = lambda text, mark, part: F.split_part(text, F.lit(mark), F.lit(part))
    after_suffix, after_prefix = between(output, SUFFIX, 2), between(output, PREFIX, 2)
    psm = F.concat(F.substr(between(output, SUFFIX, 1), F.lit(len(PREFIX) + 1)), between(after_suffix, MIDDLE, 2), between(after_suffix, MIDDLE, 1))
    spm = F.concat(between(after_prefix, MIDDLE, 1), between(after_prefix, MIDDLE, 2), F.substr(between(output, PREFIX, 1), F.lit(len(SUFFIX) + 1)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
