"""Arcs that stay in place: packed neighbour blocks in a bucketed table, which steps of an iteration read.

An iteration that joins plain arcs shuffles all of them at every step. Here arcs are dealt once: each
source's arcs lie in blocks of about BLOCK arcs, and the table is bucketed and sorted by (source,
block). A step shuffles (or broadcasts) what it expands, and no arcs. A source of huge degree is
many blocks in many buckets, so no task holds all its arcs.

Dealing moves every arc, which does not pay while a step expands few nodes: WrittenArcs sends such nodes
to the arcs, and deals these at the first step that expands many.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from convmem.plans.joins import BROADCAST_ROWS, join_checked
from convmem.plans.scratch import drop_scratch, shared_dir, write_scratch

#: Arcs of a block on average where a source has more, and arcs of a bucket.
BLOCK, BUCKET = 2_048, 4_000_000
#: What Spark takes as buckets of a table at most.
MAX_BUCKETS = 100_000


@dataclass(frozen=True)
class Adjacency:
    """blocks: key, _block, _arcs (array of the arcs' other columns), bucketed by key and _block; hubs:
    key, _n of the sources that have more than one block."""

    key: list[str]
    blocks: DataFrame
    hubs: DataFrame
    table: str
    paths: tuple[str, str]

    def of(self, front: DataFrame) -> DataFrame:
        """front (with the key's columns) joined with its arcs; rows without arcs are left out."""
        n = F.coalesce("_n", F.lit(1)).cast("int")
        asked = join_checked(front, self.hubs, self.key, "left").withColumn("_block", F.explode(F.sequence(F.lit(0), n - 1)))
        return asked.join(self.blocks, [*self.key, "_block"]).select(*front.columns, F.inline("_arcs"))

    def drop(self) -> None:
        """Deletes the tables; no plan over them may run later."""
        spark = self.blocks.sparkSession
        spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        for path in self.paths:
            drop_scratch(spark, path)


def write_adjacency(arcs: DataFrame, key: list[str], block: int = BLOCK, bucket: int = BUCKET) -> Adjacency:
    """Deals arcs to blocks by a hash of the arc, and blocks to buckets by key and number. Arcs with a
    null in the key are nobody's and left out; repeated arcs stay, each a row. There are at least as
    many buckets as the session has shuffle partitions."""
    spark = arcs.sparkSession
    arcs = arcs.where(" AND ".join(f"{k} IS NOT NULL" for k in key))
    rest = [c for c in arcs.columns if c not in key]
    degrees, degrees_path = write_scratch(arcs.groupBy(*key).agg(F.count("*").alias("_d")), "adjacency-degrees")
    hubs = degrees.where(F.col("_d") > block).select(*key, F.ceil(F.col("_d") / block).cast("int").alias("_n"))
    n_arcs = degrees.agg(F.sum("_d")).first()[0] or 0
    buckets = min(MAX_BUCKETS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_arcs // bucket)))
    number = F.coalesce(F.pmod(F.xxhash64(*rest), F.col("_n").cast("bigint")), F.lit(0)).cast("int")
    dealt = join_checked(arcs, hubs, key, "left").withColumn("_block", number).repartition(buckets, *key, "_block")
    packed = dealt.groupBy(*key, "_block").agg(F.collect_list(F.struct(*rest)).alias("_arcs"))
    table, path = f"adjacency_{uuid.uuid4().hex}", f"{shared_dir(spark)}/convmem-adjacency-{uuid.uuid4().hex}"
    packed.write.bucketBy(buckets, *key, "_block").sortBy(*key, "_block").option("path", path).saveAsTable(table)
    return Adjacency(key, spark.table(table), hubs, table, (path, degrees_path))


class WrittenArcs:
    """Arcs written once as they come, and as an Adjacency once a step expands more than `limit` rows."""

    def __init__(self, arcs: DataFrame, key: list[str], limit: int = BROADCAST_ROWS) -> None:
        self.key, self.limit = key, limit
        self.arcs, self.path = write_scratch(arcs, "arcs")
        self.dealt: Adjacency | None = None

    def of(self, front: DataFrame) -> DataFrame:
        """As Adjacency.of(); front must be cheap to count (a written table) and narrow."""
        if self.dealt is None and front.limit(self.limit + 1).count() > self.limit:
            self.dealt = write_adjacency(self.arcs, self.key)
        if self.dealt is not None:
            return self.dealt.of(front)
        return self.arcs.join(F.broadcast(front), self.key).select(*front.columns, *[c for c in self.arcs.columns if c not in self.key])

    def drop(self) -> None:
        """As Adjacency.drop()."""
        drop_scratch(self.arcs.sparkSession, self.path)
        if self.dealt is not None:
            self.dealt.drop()
