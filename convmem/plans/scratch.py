"""Scratch tables in the folder that the whole cluster shares.

A scratch table cuts lineage: it is a Parquet table under ``spark.checkpoint.dir``, so a lost
executor costs only the tasks that were running, and rows that came from a non-deterministic
order (row numbers, partition ids) are fixed once written.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_DIR = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster. Where none is named, a session on one machine takes a
    temporary folder; on a cluster a missing setting is an error."""
    named = spark.conf.get(_DIR, None) or spark.sparkContext.getConf().get(_DIR)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {_DIR} to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="convmem-scratch-")
        spark.conf.set(_DIR, named)
    return named.rstrip("/")


def write_scratch(df: DataFrame, label: str, row_group: int | None = None) -> tuple[DataFrame, str]:
    """Writes df once and returns (the table read back, its path). row_group: bytes of Parquet's row groups,
    of which a reader of long rows holds one; at least 100 rows."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/convmem-{label}-{uuid.uuid4().hex}"
    writer = df.write if row_group is None else df.write.option("parquet.block.size", row_group)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def scratch(df: DataFrame, label: str) -> DataFrame:
    """As write_scratch, for tables that live as long as the shared folder keeps them."""
    return write_scratch(df, label)[0]


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Deletes a scratch table that no later plan reads."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


class ScratchTables:
    """Scratch tables of one operator, which it can drop when no later plan reads them."""

    def __init__(self) -> None:
        self._kept: list[tuple[DataFrame, str]] = []

    def write(self, df: DataFrame, label: str) -> DataFrame:
        """As scratch()."""
        self._kept.append(write_scratch(df, label))
        return self._kept[-1][0]

    def drop_all_but(self, *needed: DataFrame) -> None:
        """Deletes all tables written so far but those that a returned plan still reads."""
        for df, path in self._kept:
            if not any(df is n for n in needed):
                drop_scratch(df.sparkSession, path)
        self._kept = [(df, path) for df, path in self._kept if any(df is n for n in needed)]
