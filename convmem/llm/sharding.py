"""Sharding by a consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, functions as F

from convmem.plans.scratch import scratch

#: Positions of the ring; what the driver sees of the data is one count for each.
RING = 65_536


def ring_owners(shards: int, virtual_nodes: int = 64) -> list[int]:
    """For each position of the ring, the shard of the next virtual node clockwise.

    Virtual nodes lie at hashed positions; the first one to claim a position holds it, so a
    further shard only takes positions for itself.
    """
    node: dict[int, int] = {}
    for shard in range(shards):
        for k in range(virtual_nodes):
            at = zlib.crc32(f"shard {shard} node {k}".encode()) % RING
            node.setdefault(at, shard)
    owners, last = [0] * RING, node[min(node)]
    for at in range(RING - 1, -1, -1):
        last = node.get(at, last)
        owners[at] = last
    return owners


def bounded_loads(counts: list[int], owners: list[int], shards: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (position, first rank, end rank, shard, first slot) that place counts[p] rows of each
    position p so that shard loads differ by one at most.

    Rows go to the owner of their position; what a full shard cannot take continues clockwise
    to the next shard with room. A hot position is cut into as many runs as it needs. There are
    at most RING + 2 * shards runs.
    """
    total = sum(counts)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    used = [0] * shards
    runs: list[tuple[int, int, int, int, int]] = []
    for at, count in enumerate(counts):
        done, step = 0, at
        while done < count:
            shard = owners[step % RING]
            take = min(count - done, room[shard] - used[shard])
            if take > 0:
                runs.append((at, done, done + take, shard, used[shard]))
                used[shard] += take
                done += take
            while done < count and owners[step % RING] == shard:
                step += 1
    return runs


def shard_rows(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", virtual_nodes: int = 64, partitions: int | None = None) -> DataFrame:
    """One row per input row: id, size, text_crc32, law, shard, slot, grown_shard.

    The law is `rows`: the loads of any two shards differ by one row at most. A row's ring key
    is the hash of its text, so equal texts lie together and a group that one shard cannot hold
    overflows clockwise; within a key rows are ordered by id. size is the text's UTF-8 bytes
    plus 16. slot numbers a shard's rows from 0 without gaps. grown_shard is null under this law.

    Rows are ordered by (ring position, text hash, id) with a range partitioning, which cuts a
    hot text at its ids; ranks follow from the row numbers within partitions and the partitions'
    counts, both taken from one written table. The driver sees one count for each of 65,536
    positions and each partition; the placements, as few, are broadcast.

    Null text: size 16, CRC of the empty text, ring key of the empty text. Null ids come first in
    their key. Repeated rows are placed separately. Empty table: no rows. Further columns are
    ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.xxhash64(text)
    narrow = docs.select(
        F.col(id_col).alias("_id"), (F.octet_length(text) + F.lit(16)).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"),
        key.alias("_key"), F.shiftrightunsigned(key, 48).cast("int").alias("_at"),
    )
    narrow = scratch(narrow, "shard-rows")
    order = ["_at", "_key", "_id", "text_crc32"]
    ranged = narrow.repartitionByRange(partitions, *order) if partitions else narrow.repartitionByRange(*order)
    ranked = scratch(ranged.sortWithinPartitions(*order).withColumn("_mid", F.monotonically_increasing_id()), "shard-ranked")
    part, local = F.shiftrightunsigned("_mid", 33).cast("int"), F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))

    at_counts: dict[int, int] = {}
    pieces = ranked.groupBy(part.alias("p"), "_at").agg(F.count("*").alias("n"), F.min(local).alias("first"))
    pieces = scratch(pieces, "shard-pieces")  # positions of a partition are neighbours: at most RING + partitions rows
    bases = []
    for r in sorted(pieces.collect(), key=lambda r: (r["_at"], r["p"])):
        bases.append((r["p"], r["_at"], at_counts.get(r["_at"], 0) - r["first"]))
        at_counts[r["_at"]] = at_counts.get(r["_at"], 0) + r["n"]
    runs = bounded_loads([at_counts.get(a, 0) for a in range(RING)], ring_owners(shards, virtual_nodes), shards)

    spark = docs.sparkSession
    base = spark.createDataFrame(bases, "_p int, _at int, _base bigint")
    run = spark.createDataFrame(runs, "_at int, _low bigint, _high bigint, shard int, _slot bigint")
    placed = ranked.withColumn("_p", part).withColumn("_local", local).join(F.broadcast(base), ["_p", "_at"])
    placed = placed.withColumn("_rank", F.col("_local") + F.col("_base")).join(F.broadcast(run), ["_at"])
    placed = placed.where("_rank >= _low AND _rank < _high")
    return placed.select(
        F.col("_id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"), "shard",
        (F.col("_slot") + F.col("_rank") - F.col("_low")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
