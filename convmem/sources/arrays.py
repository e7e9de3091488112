"""JSON arrays of objects read in splits: one file of any size is read by many tasks.

Where a split begins, nobody knows whether the text stands inside a string, or how deep. So each split
is read as pieces between closing braces, and a first pass sums up what it would do from either
state, outside a string or inside: one row a split. Running sums over a file's splits then say in
which state each one really begins, and a second pass cuts whole elements out. Only the ends of
splits meet, as rows of text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from convmem.plans.joins import BROADCAST_ROWS
from convmem.plans.scratch import scratch


def _opened(text: Column) -> Column:
    """Opening braces outside strings, in a text without escapes that begins outside."""
    return F.regexp_count(F.regexp_replace(text, '"[^"]*("|$)', ""), F.lit("[{]"))


def _pieces(spark: SparkSession, path: str, files: list[str]) -> DataFrame:
    """Texts between closing braces with their quotes, and the braces they open from either state."""
    read = spark.read.option("lineSep", "}").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))
    bare = F.regexp_replace("value", r"(?s)\\.", "")
    return read.where(F.col("file").isin(files)).select("file", "start", "at", "value", F.regexp_count(bare, F.lit('"')).alias("quotes"), _opened(bare).alias("out"), _opened(F.regexp_replace(bare, '^[^"]*("|$)', "")).alias("in"))


def _runs(batch: pd.DataFrame) -> Iterator[tuple[tuple[str, int], pd.DataFrame]]:
    """The stretches of a batch that are of one split; a task reads its splits one after another."""
    keys = list(zip(batch["file"], batch["start"].tolist()))
    cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield keys[a], batch.iloc[a:b]


def _effects(run: pd.DataFrame, first: bool, quotes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(whether each piece begins behind an odd number of the split's quotes, whether a brace closed
    before it, its depth changes as rows for begun outside and begun inside, quotes so far)."""
    n = run["quotes"].to_numpy(np.int64)
    odd = ((quotes + np.cumsum(n) - n) & 1).astype(bool)
    lead = np.ones(len(n), np.int64)
    if first:
        lead[0] = 0  # nothing closes before a file's first piece
    outside, inside = run["out"].to_numpy(np.int64) - lead, run["in"].to_numpy(np.int64)
    return odd, lead.astype(bool), np.stack([np.where(odd, inside, outside), np.where(odd, outside, inside)]), quotes + int(n.sum())


def _summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row a split: its quotes and the depth it adds from either state."""
    row = lambda: pd.DataFrame([[*key, quotes, *depth.tolist()]], columns=["file", "start", "quotes", "outside", "inside"])
    key, quotes, depth = None, 0, np.zeros(2, np.int64)
    for batch in batches:
        for new, run in _runs(batch):
            fresh = new != key
            if fresh:
                if key is not None:
                    yield row()
                key, quotes, depth = new, 0, np.zeros(2, np.int64)
            _, _, changes, quotes = _effects(run, fresh and new[1] == 0, quotes)
            depth = depth + changes.sum(axis=1)
    if key is not None:
        yield row()


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(file, start, part, text): the elements that lie in a split (part 1), what comes before its first
    end of an element (0; the whole split if it has none), and what comes after its last (2)."""
    key, quotes, depth, parts, ended = None, 0, 0, [], False

    def rest() -> list[tuple]:
        return [(*key, 2 if ended or key[1] == 0 else 0, "}".join(parts))]

    for batch in batches:
        rows: list[tuple] = []
        for new, run in _runs(batch):
            fresh = new != key
            if fresh:
                if key is not None:
                    rows += rest()
                key, quotes, depth, ended = new, 0, int(run["depth"].iloc[0]), False
                parts = [] if new[1] == 0 else [""]  # a later split begins behind a brace
            inside = bool(run["within"].iloc[0])
            odd, lead, changes, quotes = _effects(run, fresh and new[1] == 0, quotes)
            change = changes[int(inside)]
            before = depth + np.cumsum(change) - change
            depth += int(change.sum())
            ends = np.flatnonzero(lead & (odd == inside) & (before == 1))
            values, at = run["value"].tolist(), 0
            for end in ends.tolist():
                whole = ended or new[1] == 0
                rows.append((*key, 1 if whole else 0, "}".join(parts + values[at:end]) + "}"))
                parts, at, ended = [], end, True
            parts += values[at:]
        if rows:
            yield pd.DataFrame(rows, columns=["file", "start", "part", "text"])
    if key is not None:
        yield pd.DataFrame(rest(), columns=["file", "start", "part", "text"])


def array_elements(spark: SparkSession, path: str, files: list[str], limit: int = BROADCAST_ROWS) -> DataFrame:
    """(text): the objects of the JSON arrays in these files of path, one a row.

    Text that belongs to no object (the end of a broken file, other values) is a row of its own, which
    no object can be parsed from. The states of at most `limit` splits travel to the tasks; where there are more, texts are
    dealt by split.
    """
    pieces = _pieces(spark, path, files)
    sums = scratch(pieces.drop("value").mapInPandas(_summed, "file string, start bigint, quotes bigint, outside bigint, inside bigint"), "array-splits")
    earlier = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    placed = sums.withColumn("within", F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2 == 1)
    states = placed.select("file", "start", "within", F.coalesce(F.sum(F.when(F.col("within"), F.col("inside")).otherwise(F.col("outside"))).over(earlier), F.lit(0)).alias("depth"))
    if sums.limit(limit + 1).count() <= limit:
        known = pieces.join(F.broadcast(states), ["file", "start"])  # keeps the order in which tasks read
    else:
        known = pieces.join(states, ["file", "start"]).repartition("file", "start").sortWithinPartitions("file", "start", "at")
    cut = scratch(known.mapInPandas(_cut, "file string, start bigint, part int, text string"), "array-elements")
    ends = cut.where("part <> 1").withColumn("_n", F.sum((F.col("part") == 2).cast("int")).over(Window.partitionBy("file").orderBy("start", "part")))
    met = ends.groupBy("file", "_n").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "part", "text"))), lambda x: x["text"]), "").alias("text"))
    text = F.regexp_replace("text", r"^[\s,\[]+", "")
    return cut.where("part = 1").select("text").unionByName(met.select("text")).select(text.alias("text")).where(~F.col("text").rlike(r"^[\s,\[\]]*$"))
