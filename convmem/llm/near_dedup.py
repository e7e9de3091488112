"""Near-duplicate groups by a chosen-path set similarity join over minwise tokens."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from convmem.llm.batches import released
from convmem.llm.shingles import map_texts, shingle_set, sorted_groups
from convmem.plans.components import connected_components
from convmem.plans.joins import join_checked
from convmem.plans.scratch import ScratchTables

TREES, DEPTH = 8, 8
COORDINATES = TREES * DEPTH
#: Nodes of up to so many documents, with so many shingles, are compared exhaustively in one task.
LEAF, LEAF_SHINGLES = 1000, 2_000_000
#: Members of a large node that its other members are compared with first.
PIVOTS = 8
_A = np.random.default_rng(77).integers(1, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def minwise(s: np.ndarray) -> np.ndarray:
    """The minwise token of a set for each coordinate, as 32-bit values."""
    best = np.full(COORDINATES, 2**32 - 1, np.uint32)
    for low in range(0, len(s), 4096):
        h = ((s[low : low + 4096, None] * _A[None, :]) >> np.uint64(32)).astype(np.uint32)
        best = np.minimum(best, h.min(axis=0))
    return best


def _fingerprint(s: np.ndarray) -> tuple[int, int]:
    """Two sums over the set: equal sets agree, whatever their order."""
    a = int((s * np.uint64(0xC2B2AE3D27D4EB4F)).sum(dtype=np.uint64) ^ np.bitwise_xor.reduce(s))
    b = int(((s ^ (s >> np.uint64(29))) * np.uint64(0x165667B19E3779F9)).sum(dtype=np.uint64))
    return a - 2**63, b - 2**63


def _sign(k: int):
    def row(text: str | None) -> tuple:
        s = shingle_set(text, k)
        if not len(s):
            return 0, None, None, None
        f, g = _fingerprint(s)
        return len(s), f, g, minwise(s).tobytes()

    return map_texts([("n_shingles", pa.int64()), ("_f", pa.int64()), ("_g", pa.int64()), ("_sig", pa.binary())], row, ["_id"])


def _pack(k: int):
    """The set itself, as 64-bit hashes."""
    return map_texts([("_set", pa.binary())], lambda text: (shingle_set(text, k).tobytes(),), ["_id"])


def _roots(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if (up == parent).all():
            return parent
        parent = up


def _promising(share: float):
    """For a leaf: the groups of members whose signatures agree in at least this share of the
    coordinates. A pair is named by itself, a larger group by its members."""
    least = int(COORDINATES * share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes: list[int] = []
        ids: list[int] = []
        for group in sorted_groups(batches, "_node"):
            n = group.num_rows
            if n < 2:
                continue
            member = group.column("_id").to_numpy()
            sig = np.frombuffer(b"".join(group.column("_bits").to_pylist()), np.uint8).reshape(n, COORDINATES)
            parent = np.arange(n)
            for i in range(n):
                close = np.flatnonzero((sig[i + 1 :] == sig[i]).sum(axis=1) >= least) + i + 1
                if len(close):
                    roots = np.unique(parent[np.append(close, i)])
                    parent[np.isin(parent, roots)] = roots[0]
            for root in np.unique(parent):
                own = np.unique(member[parent == root])
                if len(own) > 1:
                    name = int.from_bytes(hashlib.blake2b(own.tobytes(), digest_size=8).digest(), "little", signed=True)
                    nodes += [name] * len(own)
                    ids += own.tolist()
            if len(ids) >= 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(ids, pa.int64())], names=["_node", "_id"])
                nodes, ids = [], []
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(ids, pa.int64())], names=["_node", "_id"])

    return run


def _confirm(percent: int):
    """For a group: exact comparison of one member's whole set with all others at a time, until
    all are connected or each has been compared; yields links that span what is connected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, "_node"):
            n = group.num_rows
            if n < 2:
                continue
            member = group.column("_id").to_numpy()
            sets = [np.frombuffer(b.as_py(), np.uint64) for b in group.column("_set")]
            size = np.array([len(s) for s in sets])
            _, at = np.unique(np.concatenate(sets), return_inverse=True)
            first = np.cumsum(size) - size
            mark = np.zeros(int(at.max()) + 1, np.int32)
            root = np.arange(n)
            left, right = [], []
            for i in np.argsort(-size, kind="stable"):
                own = at[first[i] : first[i] + size[i]]
                mark[own] = 1
                common = np.add.reduceat(mark[at], first)
                mark[own] = 0
                linked = np.flatnonzero(100 * common >= percent * (size + size[i] - common))
                for j in linked:
                    if root[j] != root[i]:
                        left.append(int(member[i]))
                        right.append(int(member[j]))
                        root[root == root[j]] = root[i]
                if (root == root[0]).all():
                    break
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["src", "dst"])

    return run


def _token(tree: int, level: int) -> Column:
    """Tree and level choose one coordinate of the signature."""
    return F.substring("_sig", 4 * (tree % TREES * DEPTH + level) + 1, 4)


def _fits(leaf: int) -> Column:
    """Small enough for one task, by the number of documents and by the size of their sets."""
    return (F.col("_n") <= leaf) & (F.col("_size") <= LEAF_SHINGLES)


def _parts(n: str, size: str, leaf: int) -> Column:
    """Into how many blocks of half a leaf this many documents and shingles are dealt."""
    return F.ceil(F.greatest(F.col(n) / (leaf // 2), F.col(size) / (LEAF_SHINGLES // 2))).cast("int")


def first_nodes(reps: DataFrame, leaf: int, tables: ScratchTables) -> tuple[DataFrame, DataFrame]:
    """The nodes of all trees after their first token: (_node, _id) of small ones, and
    (_id, _len, _tree, _node, _n, _size) of large ones. Nodes of one document end here.

    Large nodes are few (at most one for each `leaf` rows) and taken out first, by a broadcast of
    checked size, so no hot node meets in a task.
    """
    start = F.array(*[F.struct(F.lit(t).alias("_tree"), F.xxhash64(F.lit(t), _token(t, 0)).alias("_node")) for t in range(TREES)])
    rows = reps.select("_id", "_len", F.explode(start).alias("_x")).select("_id", "_len", "_x.*")
    sizes = tables.write(rows.groupBy("_node").agg(F.count("*").alias("_n"), F.sum("_len").alias("_size")).where("_n > 1"), "near-sizes")
    big = tables.write(sizes.where(~_fits(leaf)), "near-big")
    rest = join_checked(rows, big.select("_node"), "_node", "left_anti")
    small = rest.join(sizes.where(_fits(leaf)).select("_node"), "_node", "left_semi").select("_node", "_id")
    return small, tables.write(join_checked(rows, big, "_node", "inner"), "near-large")


def blocks(large: DataFrame, leaf: int) -> DataFrame:
    """(_node, _id): large nodes cut into blocks, each with the same few pivots of the node.

    Connects most of a large group of near copies at little cost. What it leaves open is found by
    branches.
    """
    named = large.select("_node", "_id", _parts("_n", "_size", leaf).alias("_blocks"))
    pivots = named.groupBy("_node", "_blocks").agg(*[F.min(F.struct(F.xxhash64("_id", F.lit(j)), "_id")).alias(f"_p{j}") for j in range(PIVOTS)])
    each = F.array_distinct(F.array(*[F.col(f"_p{j}._id") for j in range(PIVOTS)]))
    pivots = pivots.select("_node", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_b"), each.alias("_each")).select("_node", "_b", F.explode("_each").alias("_id"))
    dealt = named.select("_node", F.pmod(F.xxhash64("_id", "_node"), "_blocks").cast("int").alias("_b"), "_id")
    return dealt.unionByName(pivots).select(F.xxhash64("_node", "_b").alias("_node"), "_id").distinct()


def branches(large: DataFrame, component: DataFrame, reps: DataFrame, percent: int, leaf: int, tables: ScratchTables) -> DataFrame | None:
    """(_node, _id): the groups in which all pairs of each large node meet that collide on a path
    and that no component has already; None if no node has such pairs.

    component (node, component) is what is linked so far. A node whose members all are in one
    component ends: no comparison there can change the result, so a group of copies is not branched
    any further. In others the largest component needs no comparison within itself, which leaves
    `others` times `members` pairs. Nodes small enough, or with no more such pairs than a leaf
    has, are compared exhaustively; the rest branches on the token that the next minwise
    coordinate selects, and on a second one as often as needed for 100 / percent branches on average,
    so that a pair at the threshold keeps an expected collision. What is large at the last
    level is a set alike in all coordinates of a path, and is compared exhaustively too, dealt into
    as many groups as its pairs need.
    """
    known = component.select(F.col("node").alias("_id"), F.col("component").alias("_c"))
    rows = large.select("_id", "_len", "_tree", "_node").join(known, "_id", "left").withColumn("_c", F.coalesce("_c", "_id"))
    out: DataFrame | None = None
    for level in range(1, DEPTH + 1):
        rows = tables.write(rows, "near-rows")
        parts = rows.groupBy("_node", "_c").agg(F.count("*").alias("_n"), F.sum("_len").alias("_size"))
        nodes = parts.groupBy("_node").agg(F.sum("_n").alias("_n"), F.sum("_size").alias("_size"), F.max(F.struct("_n", "_size", "_c")).alias("_m")).where("_n > _m._n")
        nodes = nodes.select("_node", "_n", "_size", F.col("_m._c").alias("_main"), (F.col("_n") - F.col("_m._n")).alias("_others"), (F.col("_size") - F.col("_m._size")).alias("_others_size"))
        dealt = (F.col("_others") * F.col("_n") <= leaf * leaf) & (F.col("_others_size") * F.col("_size") <= LEAF_SHINGLES**2) if level < DEPTH else F.lit(True)
        nodes = tables.write(nodes.withColumn("_kind", F.when(_fits(leaf), "leaf").when(dealt, "pairs").otherwise("branch")), "near-nodes")
        kinds = {r[0] for r in nodes.select("_kind").distinct().collect()}  # three at most
        if not kinds:
            break
        sized = tables.write(join_checked(rows, nodes, "_node", "inner"), "near-sized")
        found = sized.where("_kind = 'leaf'").select("_node", "_id").unionByName(crossings(sized.where("_kind = 'pairs'"), leaf))
        out = found if out is None else out.unionByName(found)
        if "branch" not in kinds:
            break
        deeper = sized.where("_kind = 'branch'").join(reps.select("_id", "_sig"), "_id")
        one = F.when(F.col("_tree") == 0, _token(0, level % DEPTH))
        two = F.when(F.col("_tree") == 0, _token(1, level % DEPTH))
        for t in range(1, TREES):
            one, two = one.when(F.col("_tree") == t, _token(t, level % DEPTH)), two.when(F.col("_tree") == t, _token(t + 1, level % DEPTH))
        second = F.pmod(F.xxhash64("_node", F.lit("second")), F.lit(1000)) < int(1000 * (100 / percent - 1))
        named = F.when(second, F.array(F.xxhash64("_node", one), F.xxhash64("_node", two, F.lit("second")))).otherwise(F.array(F.xxhash64("_node", one)))
        rows = deeper.select("_id", "_len", "_tree", "_c", F.explode(named).alias("_node"))
    return out


def crossings(sized: DataFrame, leaf: int = LEAF) -> DataFrame:
    """(_node, _id): groups of about `leaf` documents in which all pairs of each node meet but those
    within its largest component (_main).

    All other members are dealt into blocks, the whole node is too, and each pair of blocks is a
    group. A node of copies of one document has next to no other members; one of m others and n
    members takes m * n comparisons, spread over its groups.
    """
    a, b = _parts("_others", "_others_size", leaf), _parts("_n", "_size", leaf)
    dealt = sized.select("_node", "_id", (F.col("_c") != F.col("_main")).alias("_other"), a.alias("_a"), b.alias("_b"))
    dealt = dealt.withColumn("_i", F.pmod(F.xxhash64("_id", F.lit("other")), "_a").cast("int")).withColumn("_j", F.pmod(F.xxhash64("_id"), "_b").cast("int"))
    each_j, each_i = F.explode(F.sequence(F.lit(0), F.col("_b") - 1)), F.explode(F.sequence(F.lit(0), F.col("_a") - 1))
    others = dealt.where("_other").select("_node", "_id", "_i", each_j.alias("_j"))
    whole = dealt.select("_node", "_id", each_i.alias("_i"), "_j")
    return others.unionByName(whole).select(F.xxhash64("_node", "_i", "_j").alias("_node"), "_id").distinct()


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, leaf: int = LEAF) -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept.

    Documents whose sets of lower-cased k-word shingles have a Jaccard similarity of at least
    percent / 100 are linked; component_id is the smallest id reachable, kept marks its holder.

    Equal sets are one class, represented by its smallest id (copies never form pairs). The
    representatives go through the chosen-path trees: small nodes (see first_nodes) are compared
    exhaustively, large ones first in blocks with common pivots (see blocks), then, as far as
    connected components leave them open, on deeper paths (see branches). In a group, members whose
    64 minwise coordinates agree too rarely are set aside (four standard deviations under the
    threshold), groups found by several trees are joined into one, and the rest is confirmed on
    whole sets. Only spanning links leave a task. Eight trees find a pair at the threshold with
    probability 1 - (1 - s) ** 8 where nodes are small, and above 1 - (1 - s ** 3) ** 8 for
    groups of up to a million; connections through other members add to it.

    Null or wordless text: n_shingles 0, linked with nothing. Null id: linked with nothing,
    component_id null, kept. Rows that share an id are one document (linked). Empty table: no
    rows. Further columns are ignored.
    """
    texts = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).alias("_text"))
    tables = ScratchTables()
    signed = tables.write(texts.mapInArrow(released(_sign(k)), "_id bigint, n_shingles bigint, _f bigint, _g bigint, _sig binary"), "near-signed")
    classes = signed.where("_f IS NOT NULL AND _id IS NOT NULL").groupBy("_f", "_g", "n_shingles").agg(F.min("_id").alias("_rep"), F.first("_sig").alias("_sig"))
    classes = tables.write(classes, "near-classes")
    # A shared id (repeated rows with other texts) links the classes through the id itself.
    reps = classes.select(F.col("_rep").alias("_id"), F.col("n_shingles").alias("_len"), "_sig")

    bits = F.concat(*[F.substring("_sig", 4 * i + 1, 1) for i in range(COORDINATES)])
    compact = reps.select("_id", bits.alias("_bits"))
    s = percent / 100
    share = s - 4 * (s * (1 - s) / COORDINATES) ** 0.5
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def linked(nodes: DataFrame) -> DataFrame:
        """The links that the comparison of all members of each node confirms."""
        in_node = nodes.join(compact, "_id").repartition(n, "_node").sortWithinPartitions("_node")
        groups = in_node.mapInArrow(released(_promising(share)), "_node bigint, _id bigint").distinct()
        groups = tables.write(groups, "near-groups")
        needed = tables.write(groups.select("_id").distinct(), "near-needed")
        sets = join_checked(texts, needed, "_id", "left_semi").mapInArrow(released(_pack(k)), "_id bigint, _set binary")
        sets = tables.write(sets.groupBy("_id", F.xxhash64("_set").alias("_h")).agg(F.first("_set").alias("_set")), "near-sets")
        whole = groups.join(sets.select("_id", "_set"), "_id").repartition(n, "_node").sortWithinPartitions("_node")
        return tables.write(whole.mapInArrow(released(_confirm(percent)), "src bigint, dst bigint"), "near-links")

    small, large = first_nodes(reps, leaf, tables)
    shared = signed.where("_f IS NOT NULL AND _id IS NOT NULL").join(classes.select("_f", "_g", "n_shingles", "_rep"), ["_f", "_g", "n_shingles"]).select("_id", "n_shingles", "_rep")
    members = tables.write(shared, "near-members")
    crossing = members.groupBy("_id").agg(F.min("_rep").alias("src"), F.max("_rep").alias("dst")).where("src <> dst").select("src", "dst")
    links = linked(small.unionByName(blocks(large, leaf))).unionByName(crossing)
    found = tables.write(connected_components(links, label="near"), "near-components")
    if not large.isEmpty() and (more := branches(large, found, reps, percent, leaf, tables)) is not None:
        found = tables.write(connected_components(links.unionByName(linked(more)), label="near"), "near-components")
    tables.drop_all_but(signed, members, found)

    placed = members.join(found.withColumnRenamed("node", "_rep"), "_rep", "left").select("_id", "n_shingles", F.coalesce("component", "_rep").alias("component_id"))
    alone = signed.where("_f IS NULL OR _id IS NULL").select("_id", "n_shingles", F.col("_id").alias("component_id"))
    return placed.unionByName(alone).select(F.col("_id").alias(id_col), "n_shingles", "component_id", F.col("_id").eqNullSafe(F.col("component_id")).alias("kept"))
