"""Comparing versions of a table by a hash tree, so that only ranges that differ are opened.

Rows lie in key ranges (leading hex digits of a hash of the key). A leaf is an order-insensitive
fingerprint of its range's rows, an inner node one of its sixteen children. Two versions are compared from the roots
down: below equal nodes nothing is read, and rows are compared in leaves that differ only.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from convmem.operators.graph import fingerprint
from convmem.plans.joins import join_checked
from convmem.plans.scratch import ScratchTables, shared_dir

#: Hex digits of a range; of these the first FOLDER name its folder, so at most 256 folders are listed.
DEPTH, FOLDER = 4, 2


@dataclass(frozen=True)
class Version:
    """rows: the rows with _folder and _leaf, in folders by the former; tree: level, node, fingerprint."""

    key: list[str]
    rows: DataFrame
    tree: DataFrame
    depth: int


def _leaf(key: list[str], depth: int) -> Column:
    return F.substring(F.sha2(F.to_json(F.struct(*key), {"ignoreNullFields": "false"}), 256), 1, depth)


def write_version(rows: DataFrame, key: list[str], depth: int = DEPTH, path: str | None = None) -> Version:
    """Writes the rows by key range, and their tree: one shuffle of the rows, then one row a range and
    level. Nulls in the key are a key; rows that repeat are counted. depth: FOLDER digits or more."""
    if depth < FOLDER:
        raise ValueError(f"depth must be {FOLDER} or more")
    spark = rows.sparkSession
    path = path or f"{shared_dir(spark)}/convmem-version-{uuid.uuid4().hex}"
    placed = rows.withColumn("_leaf", _leaf(key, depth)).withColumn("_folder", F.substring("_leaf", 1, FOLDER))
    placed.repartitionByRange("_leaf").sortWithinPartitions("_leaf").write.partitionBy("_folder").parquet(f"{path}/rows")
    kept = spark.read.schema(placed.schema).parquet(f"{path}/rows")
    whole = F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("_row")
    tables = ScratchTables()
    level = tables.write(fingerprint(kept.select(F.col("_leaf").alias("node"), whole), ["_row"], ["node"]).select(F.lit(depth).alias("level"), "node", "fingerprint"), "version-leaves")
    levels = [level]
    for n in range(depth - 1, -1, -1):
        above = fingerprint(levels[-1].select(F.substring("node", 1, n).alias("up"), "node", "fingerprint"), ["node", "fingerprint"], ["up"])
        levels.append(tables.write(above.select(F.lit(n).alias("level"), F.col("up").alias("node"), "fingerprint"), f"version-{n}"))
    reduce(DataFrame.unionByName, levels).coalesce(1 if depth <= DEPTH else 64).write.partitionBy("level").parquet(f"{path}/tree")
    tables.drop_all_but()
    return Version(key, kept, spark.read.schema("node string, fingerprint string, level int").parquet(f"{path}/tree"), depth)


def differing_ranges(old: Version, new: Version) -> tuple[DataFrame, list[tuple[int, int, int]]]:
    """(node: the ranges whose rows differ, [(level, nodes compared, nodes that differ)]). Each level
    reads the children of nodes that differ above; equal roots end it at once."""
    tables, report = ScratchTables(), []
    opened = None
    for level in range(old.depth + 1):
        sides = []
        for version, name in ((old, "_a"), (new, "_b")):
            nodes = version.tree.where(F.col("level") == level).select("node", F.col("fingerprint").alias(name))
            if opened is not None:
                up = F.substring("node", 1, level - 1)
                nodes = join_checked(nodes.withColumn("_up", up), opened.withColumnRenamed("node", "_up"), "_up", "left_semi").drop("_up")
            sides.append(nodes)
        met = tables.write(sides[0].join(sides[1], "node", "full_outer").select("node", (~F.col("_a").eqNullSafe(F.col("_b"))).alias("_differs")), f"ranges-{level}")
        opened = tables.write(met.where("_differs").select("node"), f"differing-{level}")
        report.append((level, met.count(), opened.count()))
        tables.drop_all_but(opened)
        if not report[-1][2]:
            break
    return opened, report


def changes(old: Version, new: Version) -> tuple[DataFrame, list[tuple[int, int, int]]]:
    """(key, change: added, removed or changed; the report of differing_ranges). Rows are read in the
    folders and ranges that differ. A key with several rows is changed if they are not the same rows
    as often."""
    if (old.key, old.depth) != (new.key, new.depth):
        raise ValueError("versions must have one key and depth")
    ranges, report = differing_ranges(old, new)
    folders = [r[0] for r in ranges.select(F.substring("node", 1, FOLDER)).distinct().collect()]  # 256 at most
    sides = []
    for version, name in ((old, "_a"), (new, "_b")):
        read = join_checked(version.rows.where(F.col("_folder").isin(folders)), ranges.withColumnRenamed("node", "_leaf"), "_leaf", "left_semi").drop("_folder", "_leaf")
        row = F.to_json(F.struct(*read.columns), {"ignoreNullFields": "false"}).alias("_row")
        sides.append(fingerprint(read.select(*version.key, row), ["_row"], version.key).select(*version.key, F.col("fingerprint").alias(name)))
    a, b = sides[0].alias("a"), sides[1].alias("b")
    same = reduce(lambda x, y: x & y, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in old.key])
    met = a.join(b, same, "full_outer").where(~F.col("_a").eqNullSafe(F.col("_b")))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").otherwise("changed")
    here = F.col("_a").isNotNull()
    return met.select(*[F.when(here, F.col(f"a.{k}")).otherwise(F.col(f"b.{k}")).alias(k) for k in old.key], change.alias("change")), report
