"""Running sums, counts, maxima and previous values within keys, also where one key holds most rows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from convmem.plans.joins import join_checked, own_names
from convmem.plans.scratch import scratch

#: Rows of a key up to which one task takes it whole.
KEY_ROWS = 1_000_000
_NONE = np.iinfo(np.int64).min


@dataclass(frozen=True)
class Running:
    """A fold over the rows of a key up to each row: how is sum, count, max or previous, or total (the sum over
    all the key's rows); value is an integer column (counted rows: the value is not null; null adds nothing).
    inclusive: the row itself counts."""

    how: str
    value: Column
    inclusive: bool = False


def _windowed(df: DataFrame, key: list[str], order: list[str], folds: dict[str, Running]) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*order)
    frames = {True: w.rowsBetween(Window.unboundedPreceding, 0), False: w.rowsBetween(Window.unboundedPreceding, -1)}

    def over(f: Running) -> Column:
        if f.how == "previous":
            return F.lag(f.value).over(w)
        if f.how == "total":
            return F.coalesce(F.sum(f.value).over(Window.partitionBy(*key)), F.lit(0))
        return {"sum": lambda: F.coalesce(F.sum(f.value).over(frames[f.inclusive]), F.lit(0)), "count": lambda: F.count(f.value).over(frames[f.inclusive]), "max": lambda: F.max(f.value).over(frames[f.inclusive])}[f.how]()

    return df.withColumns({name: over(f).cast("bigint") for name, f in folds.items()})


def _changes(columns: list[pa.Array]) -> np.ndarray:
    """Whether each row but the first has another key than the one before it; null equals null."""
    out = np.zeros(len(columns[0]) - 1, bool)
    for c in columns:
        a, b = c.slice(1), c.slice(0, len(c) - 1)
        other = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
        out |= other | (a.is_null().to_numpy(zero_copy_only=False) != b.is_null().to_numpy(zero_copy_only=False))
    return out


def _local(key: list[str], folds: list[tuple[str, str, bool]], part: str, head: str, place: str, total: dict[str, str]):
    """Folds each partition's sorted rows as they stream by, as if every key began in it; only the running key's
    values are held. Adds the partition, the row's place there, whether it is the partition's first row (2), or another of
    that row's key (1), and the fold with the row itself (what a later partition of the key goes on from)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None
        carry: dict[str, int] = {}
        first, rows = True, 0
        number = TaskContext.get().partitionId()
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            columns = [batch.column(k) for k in key]
            new = np.append(last is not None and tuple(c[0].as_py() for c in columns) != last, _changes(columns))
            segment = np.cumsum(new)
            starts = np.flatnonzero(new)
            if new[0]:
                carry = {}
            # Values of the key that goes on from the last batch: rows before the first change.
            goes_on = segment == segment[0]
            made = {}
            for name, how, inclusive in folds:
                raw = batch.column(name)
                null = raw.is_null().to_numpy(zero_copy_only=False)
                value = pc.fill_null(raw, 0).to_numpy().astype(np.int64)
                if how in ("sum", "count"):
                    value = (~null).astype(np.int64) if how == "count" else value
                    run_sum = np.cumsum(value)
                    base = np.where(starts > 0, run_sum[starts - 1], 0)
                    before = np.zeros(n, np.int64)
                    if len(starts):
                        at = np.searchsorted(starts, np.arange(n), "right") - 1
                        before = np.where(at >= 0, base[at], 0)
                    own = run_sum - before + np.where(goes_on, carry.get(name, 0), 0)
                    shown, is_null = own if inclusive else own - value, np.zeros(n, bool)
                else:
                    value = np.where(null, _NONE, value)
                    own = value if how == "previous" else pd.Series(value).groupby(segment).cummax().to_numpy()
                    if how == "max":
                        own = np.where(goes_on, np.maximum(own, carry.get(name, _NONE)), own)
                    earlier = np.append(_NONE if new[0] else carry.get(name, _NONE), own[:-1])
                    earlier[starts] = _NONE
                    shown = own if inclusive else earlier
                    is_null = shown == _NONE
                made[name] = pa.array(shown, pa.int64(), mask=is_null)
                made[total[name]] = pa.array(own, pa.int64())
                carry[name] = int(own[-1])
            is_head = (goes_on & first & (not new[0])).astype(np.int32)
            if not rows:
                is_head[0] = 2
            first = first and not new.any()
            last = tuple(c[n - 1].as_py() for c in columns)
            kept = {c: batch.column(c) for c in batch.schema.names if c not in made}
            out = {**kept}
            for name, *_ in folds:
                out |= {name: made[name], total[name]: made[total[name]]}
            out |= {part: pa.array(np.full(n, number, np.int32)), head: pa.array(is_head), place: pa.array(np.arange(rows, rows + n))}
            rows += n
            yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    return run


def _ranged(df: DataFrame, key: list[str], order: list[str], folds: dict[str, Running], key_rows: int) -> DataFrame:
    part, head, place, *totals = own_names([*df.columns, *folds], "part", "head", "place", *[f"total{i}" for i in range(len(folds))])
    total = dict(zip(folds, totals, strict=True))
    valued = df.withColumns({name: f.value.cast("bigint") for name, f in folds.items()})
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // key_rows))
    ranged = valued.repartitionByRange(parts, *key, *order).sortWithinPartitions(*key, *order)
    shape = [f"`{f.name}` {f.dataType.simpleString()}" for f in valued.schema if f.name not in folds]
    shape += [f"`{c}` bigint" for n in folds for c in (n, total[n])] + [f"`{part}` int", f"`{head}` int", f"`{place}` bigint"]
    run = _local(key, [(n, f.how, f.inclusive) for n, f in folds.items()], part, head, place, total)
    local = scratch(ranged.mapInArrow(run, ", ".join(shape)), "running")
    # A key that goes on from one partition to the next is the first of the later one. The folds of such keys in each
    # of their partitions are two rows a partition at most, and a partition's first key takes those before it.
    first_keys = local.where(F.col(head) > 0).select(*key).distinct()
    same = [local[k].eqNullSafe(first_keys[k]) for k in key]
    ends = local.join(F.broadcast(first_keys), same, "left_semi").groupBy(*key, part).agg(
        F.max(head).alias(head), *[F.max_by(total[n], place).alias(total[n]) for n in folds],
    )
    before = Window.partitionBy(*key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    fold = {"sum": F.sum, "count": F.sum, "max": F.max, "previous": F.last}
    carry = ends.select(part, head, *[fold[f.how](total[n]).over(before).alias(total[n]) for n, f in folds.items()])
    carry = scratch(carry.where(F.col(head) > 0).drop(head), "running-carry")
    joined = local.drop(place, *totals).join(F.broadcast(carry), part, "left")

    def whole(n: str, f: Running) -> Column:
        carried = F.when(F.col(head) > 0, F.col(total[n]))
        if f.how in ("sum", "count"):
            return F.col(n) + F.coalesce(carried, F.lit(0))
        carried = F.when(carried != _NONE, carried)
        return F.greatest(F.col(n), carried) if f.how == "max" else F.when(F.col(head) == 2, carried).otherwise(F.col(n))

    return joined.select(*df.columns, *[whole(n, f).alias(n) for n, f in folds.items()])


def running(df: DataFrame, key: list[str], order: list[str], key_rows: int | None = None, **folds: Running) -> DataFrame:
    """df with a bigint column for each fold, over the rows of a key in order (which should tell rows apart; null keys
    are one key). sum and count are 0 where nothing came before, max and previous null.

    Keys are counted first. Where each has at most key_rows rows, this is a window. Where one has more, rows are ranged by
    (key, order), so that a hot key is cut into many tasks; each task folds its sorted rows as they
    stream by, the folds of earlier tasks of the same key are added from a table of one row a task at
    most, and nothing is shuffled twice. Empty table: no rows.
    """
    key_rows = KEY_ROWS if key_rows is None else key_rows
    largest = df.groupBy(*key).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if largest <= key_rows:
        return _windowed(df, key, order, folds)
    out = _ranged(df, key, order, {n: f for n, f in folds.items() if f.how != "total"}, key_rows)
    totals = {n: f for n, f in folds.items() if f.how == "total"}
    if totals:
        keys = own_names([*df.columns, *folds], *[f"key{i}" for i in range(len(key))])
        sums = df.groupBy(*[F.col(k).alias(n) for k, n in zip(key, keys, strict=True)]).agg(*[F.coalesce(F.sum(f.value), F.lit(0)).cast("bigint").alias(n) for n, f in totals.items()])
        same = [out[k].eqNullSafe(F.col(n)) for k, n in zip(key, keys, strict=True)]
        out = join_checked(out, scratch(sums, "running-totals"), same, "left").drop(*keys)
    return out.select(*df.columns, *folds)


def whole_number(df: DataFrame, column: str) -> Column | None:
    """The column as an integer in the same order, if its type has one."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.IntegralType):
        return F.col(column).cast("bigint")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(column)
    return F.unix_date(column).cast("bigint") if isinstance(kind, T.DateType) else None
