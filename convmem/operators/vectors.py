"""Vectors: checks, incremental sync, exact nearest neighbours."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType

from convmem.plans.joins import join_checked
from convmem.plans.running import Running, running
from convmem.plans.scratch import scratch, write_scratch

#: Queries and vectors of a block; a task holds the similarities of one block with another.
QUERY_BLOCK, VECTOR_BLOCK = 1_000, 1_000
#: As QUERY_BLOCK, where each query brings the candidates whose places it asks for.
PLACE_BLOCK = 500
#: Blocks of queries that are broadcast at a time (32 MB at 64 dimensions), pairs of a batch that is put out.
BLOCKS, PIECE = 64, 200_000
#: Vectors of a block that is stored, bytes of a row group of these, and similarities that a task of whole rankings
#: holds (80 MB), unless one query needs more.
STORED_BLOCK, ROW_GROUP, HELD = 256, 16 << 20, 10_000_000
#: Arcs that a block of queries meets at a time.
ARCS = 1_000
#: Similarities that are nearer are taken as equal: more than sums in another order differ by.
TIE = 1e-13


def unit(vector: Column) -> Column:
    """The vector in doubles scaled to length 1; null if it has a value that is not finite, or
    only zeros, or is null."""
    v = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    good = ~F.exists(v, lambda x: F.isnan(x) | (F.abs(x) == float("inf"))) & (norm > 0)
    return F.when(good, F.transform(v, lambda x: x / norm))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def pending_rows(source: DataFrame, heads: DataFrame, key: list[str], seq: str = "seq", max_items: int | None = None) -> DataFrame:
    """Rows after each key's last indexed sequence number (all, where a key has none)."""
    joined = source.join(heads, key, "left").where(F.col(seq) > F.coalesce("last_seq", F.lit(-1)))
    if max_items is not None:
        joined = joined.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(seq))).where(F.col("_r") <= max_items).drop("_r")
    return joined.drop("last_seq")


def index_status(source: DataFrame, vectors: DataFrame, key: list[str]) -> DataFrame:
    """Per key the newest sequence number, the head, both counts, and whether the index is complete."""
    s = source.groupBy(*key).agg(F.max("seq").alias("max_seq"), F.count("*").alias("n_source"))
    v = vectors.groupBy(*key).agg(F.max("seq").alias("head"), F.count("*").alias("n_vectors"))
    out = s.join(v, key, "left").withColumn("n_vectors", F.coalesce("n_vectors", F.lit(0)))
    return out.withColumn("complete", F.coalesce((F.col("head") == F.col("max_seq")) & (F.col("n_vectors") == F.col("n_source")), F.lit(False)))


def integrity(vectors: DataFrame, key: list[str], vector: str = "vector") -> DataFrame:
    """Per key: distinct dimensions, vectors with a value that is not finite, zero vectors."""
    v = F.col(vector)
    broken = F.exists(v, lambda x: F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    zero = ~F.exists(v, lambda x: x != 0)
    return vectors.groupBy(*key).agg(F.count("*").alias("n"), F.countDistinct(F.size(v)).alias("dimensions"), F.count_if(broken).alias("not_finite"), F.count_if(zero).alias("zero")).withColumn("sound", (F.col("dimensions") == 1) & (F.col("not_finite") == 0) & (F.col("zero") == 0))


def missing_vectors(wanted: DataFrame, stored: DataFrame, key: list[str]) -> DataFrame:
    """Rows of wanted whose key has no stored vector: what a cache must still compute."""
    return wanted.join(stored.select(*key).distinct(), key, "left_anti")


def _matrix(rows: pa.Array) -> np.ndarray:
    """Arrays of one length as a matrix of doubles."""
    lengths = pc.list_value_length(rows).to_numpy(zero_copy_only=False)
    if len(rows) and (lengths != lengths[0]).any():
        raise ValueError("vectors must have one number of dimensions")
    return pc.list_flatten(rows).to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), -1)


def _packed(rows: DataFrame, name: str, most: int, extra: dict[str, str]) -> DataFrame:
    """Rows (name, _v, extra columns) as blocks of up to `most`, one row each: their columns as arrays in
    order of the name, and vectors scaled to length 1 as the bytes of a matrix. Vectors without a
    direction (zero, or not finite) are left out."""
    columns = {name: rows.schema[name].dataType.simpleString(), **extra}
    schema = ", ".join([*(f"{c} array<{t}>" for c, t in columns.items()), "_m binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                part = pa.table({n: c for n, c in zip(batch.schema.names, batch.slice(at, most).columns)})
                v = _matrix(part["_v"].combine_chunks())
                with np.errstate(all="ignore"):
                    norms = np.linalg.norm(v, axis=1)
                good = np.flatnonzero(np.isfinite(norms) & (norms > 0))
                good = good[pc.sort_indices(part[name].take(pa.array(good))).to_numpy()]
                if not len(good):
                    continue
                kept = part.take(pa.array(good))
                listed = {c: pa.ListArray.from_arrays(pa.array([0, len(good)], pa.int32()), kept[c].combine_chunks()) for c in columns}
                yield pa.RecordBatch.from_pydict({**listed, "_m": pa.array([(v[good] / norms[good, None]).tobytes()], pa.binary())})

    return rows.select(*columns, "_v").mapInArrow(run, schema)


def _heard(allowed: list, groups: list) -> np.ndarray | None:
    """Which vectors each query may find; None: all find all. allowed: lists of groups, None for all."""
    limited = [i for i, a in enumerate(allowed) if a is not None]
    if not limited:
        return None
    of: dict[str, list[int]] = {}
    for at, names in enumerate(groups):
        for name in names if names is not None else ():
            of.setdefault(name, []).append(at)
    heard = np.ones((len(allowed), len(groups)), bool)
    for i in limited:
        heard[i] = False
        for name in allowed[i]:
            heard[i, of.get(name, [])] = True
    return heard


def _compared(queries: bytes, vectors: bytes, allowed: pa.Array, groups: pa.Array) -> np.ndarray:
    """The similarities of a block of queries with a block of vectors, -inf where not allowed; of queries
    with several vectors the largest."""
    n, m = len(allowed), len(groups)
    v, q = np.frombuffer(vectors).reshape(m, -1), np.frombuffer(queries)
    width = q.size // (n * v.shape[1])  # vectors of a query, end to end
    sims = q.reshape(n * width, -1) @ v.T
    if width > 1:
        sims = sims.reshape(n, width, m).max(axis=1) * np.sqrt(width)
    if allowed.null_count < n:
        sims[~_heard(allowed.to_pylist(), groups.to_pylist())] = -np.inf
    return sims


def _first(values: np.ndarray, k: int) -> np.ndarray:
    """Which k of each row come first by (-value, place); -inf never does."""
    chosen = values > -np.inf
    if k < values.shape[1]:
        kth = -np.partition(-values, k - 1, axis=1)[:, k - 1, None]
        above = values > kth
        tied = chosen & (values == kth)
        chosen &= above | (tied & (np.cumsum(tied, axis=1) <= k - above.sum(axis=1)[:, None]))
    return chosen


def _names(rows: pa.ListArray, at: int) -> pa.Array:
    return rows[at].values


def _pieces(names: pa.Array, ids: pa.Array, sims: np.ndarray, chosen: np.ndarray | None, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows (query, id, score) of the chosen pairs, in batches of bounded size."""
    step = max(1, PIECE // max(1, sims.shape[1]))
    for a in range(0, len(sims), step):
        q, at = np.nonzero(sims[a:a + step] > -np.inf if chosen is None else chosen[a:a + step])
        yield pa.RecordBatch.from_arrays([names.take(pa.array(q + a)).cast(schema.types[0]), ids.take(pa.array(at)).cast(schema.types[1]), pa.array(sims[a + q, at])], schema=schema)


def _nearest(k: int | None, digits: int, largest: bool, qid: pa.DataType, id_: pa.DataType):
    """The similarities of all queries with the vectors; with k only those that can be among a query's k
    best by (-score rounded to digits, id). A task holds one block of each side at a time, and the
    k-th score that a query reached in one block is the floor of what later ones may bring."""
    schema = pa.schema([("qid", qid), ("id", id_), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floors: dict[str, np.ndarray] = {}
        for batch in batches:
            c = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            for r in range(batch.num_rows):
                names, ids = _names(c["qid"], r), _names(c["_id"], r)
                sims = _compared(c["_mq"][r].as_py(), c["_m"][r].as_py(), _names(c["_allow"], r), _names(c["_groups"], r))
                if k is None:
                    yield from _pieces(names, ids, sims, None, schema)
                    continue
                sims = np.round(sims, digits)
                if largest:  # blocks are in order of id
                    sims, ids = np.ascontiguousarray(sims[:, ::-1]), ids.take(pa.array(np.arange(len(ids))[::-1]))
                floor = floors.setdefault(c["_b"][r].as_py(), np.full(len(names), -np.inf))
                sims[sims < floor[:, None]] = -np.inf
                if k <= sims.shape[1]:
                    np.maximum(floor, -np.partition(-sims, k - 1, axis=1)[:, k - 1], out=floor)
                yield from _pieces(names, ids, sims, _first(sims, k), schema)

    return run


def _better(qid: pa.DataType):
    """How many vectors come before each of a query's candidates (_scores, _ids) by (-similarity, id):
    counted from sorted similarities, and by ids among the equal ones. A task sums its counts."""
    schema = pa.schema([("qid", qid), ("_at", pa.int32()), ("better", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, tuple[list, list[np.ndarray]]] = {}
        for batch in batches:
            c = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            for r in range(batch.num_rows):
                ids = np.array(_names(c["_id"], r).to_pylist(), object)
                sims = _compared(c["_mq"][r].as_py(), c["_m"][r].as_py(), _names(c["_allow"], r), _names(c["_groups"], r))
                asked, known = _names(c["_scores"], r), _names(c["_ids"], r)
                if c["_b"][r].as_py() not in sums:
                    sums[c["_b"][r].as_py()] = _names(c["qid"], r).to_pylist(), [np.zeros(len(x), np.int64) for x in asked]
                for at, (row, counted) in enumerate(zip(sims, sums[c["_b"][r].as_py()][1])):
                    scores, ordered = asked[at].values.to_numpy(), np.sort(row)
                    high, low = np.searchsorted(ordered, scores + TIE, "right"), np.searchsorted(ordered, scores - TIE, "left")
                    counted += len(row) - high
                    tied = np.flatnonzero(high > low)
                    if len(tied):
                        before = np.searchsorted(ids, np.array(known[at].values.to_pylist(), object)[tied], "left")
                        by_score = np.argsort(scores[tied], kind="stable")
                        runs = np.split(by_score, np.flatnonzero(np.diff(scores[tied][by_score]) > TIE) + 1)
                        for run_ in runs:  # copies share one run; blocks are in order of id
                            members = np.flatnonzero(np.abs(row - scores[tied[run_[0]]]) <= TIE)
                            counted[tied[run_]] += np.searchsorted(members, before[run_], "left")
        for names, counts in sums.values():
            for a in range(0, len(names), PLACE_BLOCK):
                held = counts[a:a + PLACE_BLOCK]
                sizes = [len(x) for x in held]
                places = np.concatenate([np.arange(n, dtype=np.int32) for n in sizes])
                yield pa.RecordBatch.from_arrays([pa.array(names[a:a + PLACE_BLOCK]).take(pa.array(np.repeat(np.arange(len(held)), sizes))).cast(qid), pa.array(places), pa.array(np.concatenate(held))], schema=schema)

    return run


def _meet(queries: DataFrame, vectors: DataFrame, compare, schema: str, block: int, part: int, extra: dict[str, str] | None = None) -> DataFrame | None:
    """compare, a function for mapInArrow, over every pair of a block of queries and a block of vectors,
    a row each; None without queries.

    Queries are counted, and their blocks are broadcast, so vectors are read once and moved once, packed,
    for an even spread. Beyond BLOCKS blocks the queries are taken in as many rounds as it needs. What a
    task holds depends on the sizes of the blocks alone, and so does a row of work.
    """
    queries = scratch(queries, "vector-queries")
    count = queries.count()
    if not count:
        return None
    spread = {"_allow": "array<string>", **(extra or {})}
    blocks = -(-count // block)
    rounds = -(-blocks // BLOCKS)
    tasks = max(queries.sparkSession.sparkContext.defaultParallelism, int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parts = _packed(vectors, "_id", part, {"_groups": "array<string>"}).repartition(tasks)
    out = None
    for i in range(rounds):
        some = queries.where(F.pmod(F.xxhash64("qid"), F.lit(rounds)) == i) if rounds > 1 else queries
        packed = _packed(some.repartition(-(-blocks // rounds)), "qid", block, spread).withColumnRenamed("_m", "_mq").withColumn("_b", F.md5(F.concat("_mq", F.col("qid")[0].cast("string").cast("binary"))))
        found = parts.crossJoin(F.broadcast(packed)).mapInArrow(compare, schema)
        out = found if out is None else out.unionByName(found)
    return out


def _sides(queries: DataFrame, vectors: DataFrame, qid: str, id_col: str, vector: str, allowed: str | None, groups: str | None) -> tuple[DataFrame, DataFrame]:
    """Queries as (qid, _v, _allow) and vectors as (_id, _v, _groups), without null vectors."""
    named = lambda c: (F.col(c) if c else F.lit(None)).cast("array<string>")
    q = queries.select(F.col(qid).alias("qid"), F.col(vector).cast("array<double>").alias("_v"), named(allowed).alias("_allow"))
    c = vectors.select(F.col(id_col).alias("_id"), F.col(vector).cast("array<double>").alias("_v"), named(groups).alias("_groups"))
    return q.where("_v IS NOT NULL"), c.where("_v IS NOT NULL")


def cosine_topk(
    queries: DataFrame, vectors: DataFrame, k: int | None, qid: str = "qid", id_col: str = "id", vector: str = "vector", block: int = QUERY_BLOCK, part: int = VECTOR_BLOCK,
    allowed: str | None = None, groups: str | None = None, digits: int = 12, largest: bool = False,
) -> DataFrame:
    """(qid, id, score, rank): the k most similar vectors of each query (None: all), ties by
    ascending id, or descending if largest. Scores are equal if they are so when rounded to digits,
    and rounded ones are returned if there is a k.

    Queries meet vectors as in _meet, and about k rows for each query and task are shuffled. Zero and
    null vectors have no similarity and are left out. Filters on the collection are applied before by
    the caller and reach the scan; `allowed` names a column of queries with the groups a query may
    find (null: all), `groups` one of vectors with the groups a vector is in.
    """
    id_type, qid_type = vectors.schema[id_col].dataType, queries.schema[qid].dataType
    schema = f"qid {qid_type.simpleString()}, id {id_type.simpleString()}, score double"
    asked, collection = _sides(queries, vectors, qid, id_col, vector, allowed, groups)
    found = _meet(asked, collection, _nearest(k, digits, largest, to_arrow_type(qid_type), to_arrow_type(id_type)), schema, block, part)
    if found is None:
        return queries.sparkSession.createDataFrame([], schema + ", rank int")
    order = F.desc(F.round("score", digits)), F.desc("id") if largest else F.asc("id")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(*order)))
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def cosine_best(queries: DataFrame, vectors: DataFrame, qid: str = "qid", id_col: str = "id", vector: str = "vector", block: int = QUERY_BLOCK, part: int = VECTOR_BLOCK) -> DataFrame:
    """(qid, id, score) of all queries and vectors: the largest similarity where a query has several
    rows, found where both are compared, so no pair is shuffled."""
    id_type, qid_type = vectors.schema[id_col].dataType, queries.schema[qid].dataType
    schema = f"qid {qid_type.simpleString()}, id {id_type.simpleString()}, score double"
    asked, collection = _sides(queries, vectors, qid, id_col, vector, None, None)
    several = asked.select("qid", "_allow", unit(F.col("_v")).alias("_v")).where("_v IS NOT NULL").groupBy("qid", "_allow").agg(F.collect_list("_v").alias("_l"))
    several = scratch(several, "vector-cues")
    width = several.agg(F.max(F.size("_l"))).first()[0]
    if not width:
        return queries.sparkSession.createDataFrame([], schema)
    # Shorter lists repeat their vectors.
    even = several.select("qid", F.flatten(F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.get("_l", i % F.size("_l")))).alias("_v"), "_allow")
    return _meet(even, collection, _nearest(None, 12, False, to_arrow_type(qid_type), to_arrow_type(id_type)), schema, block, part)


def _shares(sims: np.ndarray, weights: np.ndarray, constant: int, digits: int) -> np.ndarray:
    """The sum of weight / (constant + rank) of each vector (a column, in order of id) over the rows of sims, which are
    ranked as one list by (-similarity rounded to digits, id). What sums in another order tell apart is equal before
    it is rounded, or copies could fall to both sides of a rounded value."""
    flat, n = sims.ravel(), sims.shape[1]
    order = np.argsort(-flat)
    s = flat[order]
    new = np.append(True, s[:-1] - s[1:] > TIE)
    keys = np.round(s[new], digits)
    new[new] = np.append(True, keys[1:] != keys[:-1])
    tied = ~new
    tied[:-1] |= tied[1:]
    at = np.flatnonzero(tied)
    if len(at):
        order[at] = order[at][np.lexsort((order[at] % n, np.cumsum(new)[at]))]
    return np.bincount(order % n, weights[order // n] / (constant + 1 + np.arange(len(order))), n)


def _fused(total: int, constant: int, digits: int, qid: pa.DataType, id_: pa.DataType):
    """The fused rankings of the queries that come with each block of vectors (_q, the same each time), put out in
    bounded batches when all `total` vectors have been met. A task holds their similarities and the ids."""
    schema = pa.schema([("qid", qid), ("id", id_), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, vectors, known, at = [], [], [], 0
        for batch in batches:
            c = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            for r in range(batch.num_rows):
                if not known:
                    for query in c["_q"][r].as_py():
                        cues: dict = {}
                        for x in query["_l"]:
                            rows, weights = cues.setdefault(x["cue"], ([], []))
                            weights.append(x["weight"])
                            if x["_v"] is not None:
                                rows.append(len(vectors))
                                vectors.append(x["_v"])
                        asked.append((query["qid"], [(rows, weights) for rows, weights in cues.values() if rows]))
                    q = np.array(vectors)
                    sims = np.empty((len(q), total))
                ids = _names(c["_id"], r)
                m = len(ids)
                np.matmul(q, np.frombuffer(c["_m"][r].as_buffer()).reshape(m, -1).T, out=sims[:, at:at + m])
                known.append(ids.take(pa.array(np.arange(m))))  # a copy: a slice would keep its batch
                at += m
        if not known:
            return
        ids = pa.concat_arrays(known)
        by_id = pc.sort_indices(ids)
        ids, by_id = ids.take(by_id), by_id.to_numpy()
        first = np.append(0, 1 + np.flatnonzero(pc.fill_null(pc.not_equal(ids.slice(1), ids.slice(0, total - 1)), True).to_numpy(zero_copy_only=False)))
        ids = ids if len(first) == total else ids.take(pa.array(first))
        for name, cues in asked:
            scores = np.zeros(total)
            for rows, weights in cues:  # of a cue with several rows, each vector meets each weight
                scores += _shares(sims[np.repeat(rows, len(weights))][:, by_id], np.tile(np.array(weights, float), len(rows)), constant, digits)
            scores = scores if len(first) == total else np.add.reduceat(scores, first)
            for a in range(0, len(ids), PIECE):
                some = ids.slice(a, PIECE)
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(name, qid), len(some)), some.cast(id_), pa.array(scores[a:a + PIECE])], schema=schema)

    return run


def cosine_fused(cues: DataFrame, vectors: DataFrame, constant: int = 60, id_col: str = "id", vector: str = "vector", digits: int = 12, part: int = STORED_BLOCK, held: int = HELD) -> DataFrame:
    """(qid, id, score) for every query and vector: weighted reciprocal-rank fusion of the whole rankings of the
    query's cues (qid, cue, weight, vector) by (-similarity rounded to digits, id). Cues without a weight or a
    direction rank nothing, and vectors without one are left out.

    No pair is shuffled or written. Vectors are stored once, packed, and each task reads all of them for a few
    queries of its own, so disk grows with vectors and queries, never with their product. A task holds at most about
    `held` similarities, or those of one query, and works on one ranking at a time.
    """
    spark, id_type, qid_type = cues.sparkSession, vectors.schema[id_col].dataType, cues.schema["qid"].dataType
    schema = f"qid {qid_type.simpleString()}, id {id_type.simpleString()}, score double"
    asking = cues.where("qid IS NOT NULL AND cue IS NOT NULL AND weight IS NOT NULL").select("qid", F.struct("cue", F.col("weight").cast("double").alias("weight"), unit(F.col(vector)).alias("_v")).alias("_x"))
    lists = asking.groupBy("qid").agg(F.sort_array(F.collect_list("_x")).alias("_l")).where(F.exists("_l", lambda x: x["_v"].isNotNull()))
    lists = scratch(lists.withColumn("_n", F.size("_l")), "fusion-queries")
    collection = vectors.select(F.col(id_col).alias("_id"), F.col(vector).cast("array<double>").alias("_v")).where("_v IS NOT NULL")
    blocks = write_scratch(_packed(collection, "_id", part, {}), "fusion-vectors", ROW_GROUP)[0]
    total = blocks.agg(F.sum(F.size("_id"))).first()[0]
    rows, widest = lists.agg(F.sum("_n"), F.max("_n")).first()
    if not total or not rows:
        return spark.createDataFrame([], schema)
    # Queries are dealt in order into groups of up to `most` cues, and one more query's.
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    most = max(widest, min(held // total, -(-rows // tasks)))
    before = running(lists.select(F.lit(0).alias("_all"), "qid", "_n"), ["_all"], ["qid"], _before=Running("sum", F.col("_n")))
    dealt = lists.join(before.select("qid", F.floor(F.col("_before") / most).alias("_g")), "qid")
    packed = scratch(dealt.groupBy("_g").agg(F.collect_list(F.struct("qid", "_l")).alias("_q")), "fusion-groups")
    groups, step = packed.agg(F.max("_g")).first()[0] + 1, max(1, BLOCKS * QUERY_BLOCK // most)
    compare = _fused(total, constant, digits, to_arrow_type(qid_type), to_arrow_type(id_type))
    out = None
    for low in range(0, groups, step):
        high = min(groups, low + step)
        # A task for each group: a range of one number a partition, and a cartesian product with one partition of vectors.
        own = spark.range(low, high, 1, high - low).withColumnRenamed("id", "_g").join(F.broadcast(packed.where(F.col("_g").between(low, high - 1))), "_g")
        found = blocks.coalesce(1).crossJoin(own.select("_q").hint("shuffle_replicate_nl")).mapInArrow(compare, schema)
        out = found if out is None else out.unionByName(found)
    return out


def cosine_ends(arcs: DataFrame, queries: DataFrame, ends: list[str], deal: int, qid: str = "qid", vector: str = "vector", block: int = QUERY_BLOCK) -> DataFrame:
    """Every arc for every query, with the query's similarities to its two ends as _sa and _ta; 0 where an
    end or the query has no direction. arcs has the vectors of its ends, of length 1 or null, as _<end>,
    and `deal` the number of parts it is dealt into by its ends; a part meets one block of queries at a time."""
    asked = scratch(queries.select(F.col(qid).alias("qid"), unit(F.col(vector)).alias("_v")), "vector-queries")
    kept = [c for c in arcs.columns if c not in [f"_{e}" for e in ends]]
    fields = {"qid": asked.schema["qid"].dataType, **{c: arcs.schema[c].dataType for c in kept}, "_sa": DoubleType(), "_ta": DoubleType()}
    schema = pa.schema([(c, to_arrow_type(t)) for c, t in fields.items()])
    blocks = _packed(asked.where("_v IS NOT NULL").repartition(max(1, -(-asked.count() // block))), "qid", block, {}).withColumnRenamed("_m", "_mq")
    arc = F.struct(F.struct(*kept).alias("_arc"), *[f"_{e}" for e in ends])
    dealt = arcs.groupBy(F.pmod(F.xxhash64(*ends), F.lit(deal)).alias("_p")).agg(F.collect_list(arc).alias("_l"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                rows, names = batch.column("_l")[r].values, batch.column("qid")[r].values
                q = np.frombuffer(batch.column("_mq")[r].as_py()).reshape(len(names), -1)
                arc = rows.field("_arc")
                sims = []
                for e in ends:
                    v = rows.field(f"_{e}")
                    has = np.flatnonzero(v.is_valid().to_numpy(zero_copy_only=False))
                    s = np.zeros((len(names), len(rows)))
                    if len(has):
                        s[:, has] = q @ _matrix(v.take(pa.array(has))).T
                    sims.append(np.round(s, 12))
                step = max(1, PIECE // len(rows))
                for a in range(0, len(names), step):
                    n = len(names[a:a + step])
                    every, each = pa.array(np.repeat(np.arange(a, a + n), len(rows))), pa.array(np.tile(np.arange(len(rows)), n))
                    columns = [names.take(every), *(arc.field(c).take(each) for c in kept), *(pa.array(s[a:a + n].ravel()) for s in sims)]
                    yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, schema.types)], schema=schema)

    found = dealt.crossJoin(F.broadcast(blocks)).mapInArrow(run, ", ".join(f"{c} {t.simpleString()}" for c, t in fields.items()))
    aimless = arcs.select(*kept).crossJoin(asked.where("_v IS NULL").select("qid"))
    return found.unionByName(aimless.withColumns({"_sa": F.lit(0.0), "_ta": F.lit(0.0)}))


@F.pandas_udf(DoubleType())
def _cosine(a: pd.Series, b: pd.Series) -> pd.Series:
    if not len(a):
        return pd.Series(dtype="float64")
    x, y = (np.stack([np.asarray(v, np.float64) for v in side]) for side in (a, b))
    norms = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    good = np.isfinite(norms[0]) & np.isfinite(norms[1]) & (norms[0] > 0) & (norms[1] > 0)
    out = np.full(len(x), np.nan)  # null
    out[good] = np.einsum("ij,ij->i", x[good] / norms[0][good, None], y[good] / norms[1][good, None])
    return pd.Series(out)


def cosine_of(pairs: DataFrame, queries: DataFrame, vectors: DataFrame, qid: str = "qid", id_col: str = "id", vector: str = "vector", allowed: str | None = None, groups: str | None = None) -> DataFrame:
    """(qid, id, score) of the asked pairs (qid, id) only; pairs without a direction on either side, or
    that are not allowed, are left out. pairs must be cheap to count (a written table): they are
    broadcast up to a counted size, so that vectors are compared where they are read."""
    asked, collection = _sides(queries, vectors, qid, id_col, vector, allowed, groups)
    met = join_checked(collection.withColumnRenamed("_id", "id"), pairs.select("qid", "id"), "id", "inner")
    q = asked.withColumnRenamed("_v", "_q")
    heard = F.col("_allow").isNull() | F.arrays_overlap("_allow", F.coalesce("_groups", F.array().cast("array<string>")))
    return join_checked(met, q, "qid", "inner", QUERY_BLOCK).where(heard).select("qid", "id", _cosine("_q", "_v").alias("score")).where("score IS NOT NULL")


def cosine_places(
    wanted: DataFrame, queries: DataFrame, vectors: DataFrame, qid: str = "qid", id_col: str = "id", vector: str = "vector", block: int = PLACE_BLOCK, part: int = VECTOR_BLOCK,
    allowed: str | None = None, groups: str | None = None,
) -> DataFrame:
    """(qid, id, rank): the exact place of each wanted pair (qid, id, score as cosine_of gives it)
    among all vectors that the query may find, by (-score, id).

    Vectors are read once and only counts are shuffled, at most one row a task and wanted pair,
    however many vectors come before. wanted has a bounded number of rows for each query, and a task
    holds a count for each.
    """
    qid_type, id_type = queries.schema[qid].dataType, vectors.schema[id_col].dataType.simpleString()
    asked, collection = _sides(queries, vectors, qid, id_col, vector, allowed, groups)
    listed = wanted.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("score", "id"))).alias("_l")).select("qid", F.col("_l.score").alias("_scores"), F.col("_l.id").alias("_ids"))
    listed = scratch(listed, "vector-places")
    found = _meet(asked.join(listed, "qid"), collection, _better(to_arrow_type(qid_type)), f"qid {qid_type.simpleString()}, _at int, better bigint", block, part, {"_scores": "array<double>", "_ids": f"array<{id_type}>"})
    places = listed.select("qid", F.posexplode("_ids").alias("_at", "id"))
    if found is None:
        return places.select("qid", "id", F.lit(1).cast("bigint").alias("rank")).where("1 = 0")
    return places.join(found.groupBy("qid", "_at").agg(F.sum("better").alias("_n")), ["qid", "_at"], "left").select("qid", "id", (1 + F.coalesce("_n", F.lit(0))).alias("rank"))
