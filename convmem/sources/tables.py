"""Sources and sinks: message files, versioned tables by scope, cursors, audits and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from convmem.sources.arrays import array_elements

#: A message as files have it, wrapped with its scope.
MESSAGE = "scope string, event struct<id: string, speaker: string, time: string, text: string, replyTo: string, displayName: string, role: string, media: string>"


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """Message files, one JSON value per line or one array per file; which of the two is told from
    each file's first line that is not blank. Files of both forms are read in splits. Lines and parts of
    arrays that cannot be parsed come with null scope and event. The driver holds the files' names."""
    lines = spark.read.text(path).select(F.trim("value").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    # Within a task the ids rise in the order of the file, and tasks start at different bytes.
    place = F.struct("start", F.monotonically_increasing_id().alias("at"))
    first = lines.withColumn("place", place).where("line <> ''").groupBy("file").agg(F.min_by("line", "place").alias("line"))
    kinds = first.select("file", F.col("line").startswith("[").alias("array")).collect()
    alone, arrays = ([r["file"] for r in kinds if r["array"] == array] for array in (False, True))
    rows = spark.read.schema(MESSAGE).json(path).where(F.col("_metadata.file_path").isin(alone))
    if arrays:
        rows = rows.unionByName(array_elements(spark, path, arrays).select(F.from_json("text", MESSAGE).alias("m")).select("m.*"))
    return rows.select("scope", "event.*").withColumnRenamed("replyTo", "reply_to").withColumnRenamed("displayName", "display_name")


def read_scope(spark: SparkSession, path: str, scope: str | None = None, episode: str | None = None) -> DataFrame:
    """A table written by scope, restricted so that only the scope's folder is read."""
    rows = spark.read.parquet(path)
    if scope is not None:
        rows = rows.where(F.col("scope") == scope)
    return rows.where(F.col("episode") == episode) if episode is not None else rows


def write_by_scope(rows: DataFrame, path: str, mode: str = "append") -> None:
    rows.write.mode(mode).partitionBy("scope").parquet(path)


def next_rows(rows: DataFrame, cursors: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """(the next n rows after each scope's cursor, new cursors: null where nothing is left).
    cursors: scope, after."""
    later = rows.join(cursors, "scope").where(F.col("seq") > F.coalesce("after", F.lit(-1)))
    page = later.withColumn("_r", F.row_number().over(Window.partitionBy("scope").orderBy("seq"))).where(F.col("_r") <= n).drop("_r", "after")
    moved = page.groupBy("scope").agg(F.max("seq").alias("after"))
    return page, cursors.select("scope").join(moved, "scope", "left")


def scope_summary(tables: dict[str, DataFrame], events: DataFrame, scopes: DataFrame) -> DataFrame:
    """Per scope the row count of each table, pending (unprocessed) events, and the revision."""
    out = scopes.select("scope", "revision")
    for name, table in tables.items():
        out = out.join(table.groupBy("scope").agg(F.count("*").alias(f"n_{name}")), "scope", "left").fillna(0, [f"n_{name}"])
    pending = events.groupBy("scope").agg(F.count_if(~F.col("processed")).alias("pending"))
    return out.join(pending, "scope", "left").fillna(0, ["pending"])


def export_scope(tables: dict[str, DataFrame], scope: str, json_columns: dict[str, dict[str, str]]) -> dict[str, DataFrame]:
    """All tables of a scope with their JSON columns parsed by the given schemas."""
    out = {}
    for name, table in tables.items():
        rows = table.where(F.col("scope") == scope)
        for column, schema in json_columns.get(name, {}).items():
            rows = rows.withColumn(column, F.from_json(column, schema))
        out[name] = rows
    return out


def as_of(rows: DataFrame, key: list[str], revision: int) -> DataFrame:
    """Rows as of a revision: the newest row of each key written up to it; deleted ones (deleted is
    true) are gone. The newest is a combining maximum over (rev, row), so of rows with one revision the
    one with the largest columns, in their order, counts."""
    columns = [c for c in rows.columns if c not in key]
    newest = rows.where(F.col("rev") <= revision).groupBy(*key).agg(F.max_by(F.struct(*columns), F.struct("rev", *columns)).alias("_r"))
    out = newest.select(*key, "_r.*")
    return out.where("NOT coalesce(deleted, false)").drop("deleted") if "deleted" in rows.columns else out


def append_audit(recalls: DataFrame, path: str) -> None:
    write_by_scope(recalls, path)


def find_audit(spark: SparkSession, path: str, scope: str, ident: str) -> DataFrame:
    """The audited recall; raises if there is none."""
    found = read_scope(spark, path, scope).where(F.col("id") == ident)
    if found.isEmpty():
        raise LookupError(f"no recall {ident} in {scope}")
    return found


def insert_new(stored: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key is not stored yet, each key once: what an insert-or-ignore appends."""
    return rows.dropDuplicates(key).join(stored.select(*key), key, "left_anti")


def status_rollup(intake: DataFrame) -> DataFrame:
    """(scope, status, n) of intake rows."""
    return intake.groupBy("scope", "status").agg(F.count("*").alias("n"))


def latest_per_scope(rows: DataFrame, n: int = 20, order: str = "seq") -> DataFrame:
    """The newest n rows of each scope with their rank."""
    w = Window.partitionBy("scope").orderBy(F.desc(order))
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
