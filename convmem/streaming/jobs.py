"""Structured Streaming jobs: intake, stateful dedup, late data, FIFO eviction, vector sync. Topics: see topics.py.

Each stateful job keeps per-key state with applyInPandasWithState; rows of a micro-batch are put in
arrival order within a key before they are processed, so results equal the batch operators'.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

MESSAGE = "scope string, id string, arrival bigint, t bigint, speaker string, text string, episode string"
LIVE = "scope string, seq bigint, id string, t bigint, speaker string, text string, reply_to string"


def message_stream(spark: SparkSession, path: str, schema: str = MESSAGE, form: str = "json", files_per_batch: int | None = None) -> DataFrame:
    """Messages from files that appear in a folder."""
    reader = spark.readStream.schema(schema).format(form)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def _ordered(frames: Iterator[pd.DataFrame], by: str = "arrival") -> pd.DataFrame:
    return pd.concat(list(frames)).sort_values(by, kind="stable")


def _stateful(messages: DataFrame, key: list[str], output: str, state: str, step: Callable, horizon: int | None = None) -> DataFrame:
    """step over each key's rows and state. horizon: seconds of event time after a key's last row at which
    its state is dropped (rows that come later than that are dropped by the watermark); None keeps
    states for ever."""
    def run(k: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        rows = _ordered(frames)
        out, value = step(k, rows, held.get if held.exists else None)
        held.update(value)
        if horizon is not None:
            held.setTimeoutTimestamp(max(1000 * (int(rows["t"].max()) + horizon), held.getCurrentWatermarkMs() + 1))
        yield out

    if horizon is None:
        return messages.groupBy(*key).applyInPandasWithState(run, output, state, "append", GroupStateTimeout.NoTimeout)
    timed = messages.withColumn("_ts", F.timestamp_seconds("t")).withWatermark("_ts", f"{horizon} seconds")
    return timed.groupBy(*key).applyInPandasWithState(run, output, state, "append", GroupStateTimeout.EventTimeTimeout)


def dedup_stream(messages: DataFrame, horizon: int | None = None) -> DataFrame:
    """(scope, id, arrival, outcome): first, duplicate or conflict against the first text of a scope's
    id. State: one hash for each (scope, id), for ever or until `horizon` seconds of event time after
    the id was last seen."""

    def step(key: tuple, rows: pd.DataFrame, state: tuple | None) -> tuple[pd.DataFrame, tuple]:
        known = state[0] if state else None
        outcomes = []
        for text in rows["text"]:
            digest = hashlib.sha256((text if text is not None else "\0").encode()).hexdigest()
            outcomes.append("first" if known is None else "duplicate" if digest == known else "conflict")
            known = known or digest
        return pd.DataFrame({"scope": rows["scope"], "id": rows["id"], "arrival": rows["arrival"], "outcome": outcomes}), (known,)

    return _stateful(messages, ["scope", "id"], "scope string, id string, arrival bigint, outcome string", "hash string", step, horizon)


def late_stream(messages: DataFrame) -> DataFrame:
    """(scope, id, arrival, late) against each scope's clock; late rows are marked, not dropped."""

    def step(key: tuple, rows: pd.DataFrame, state: tuple | None) -> tuple[pd.DataFrame, tuple]:
        clock = state[0] if state else None
        late = []
        for t in rows["t"].tolist():
            late.append(clock is not None and t < clock)
            clock = t if clock is None else max(clock, t)
        return pd.DataFrame({"scope": rows["scope"], "id": rows["id"], "arrival": rows["arrival"], "late": late}), (clock,)

    return _stateful(messages, ["scope"], "scope string, id string, arrival bigint, late boolean", "clock bigint", step)


def eviction_stream(messages: DataFrame, capacity: int = 12, batch: int = 6, horizon: int | None = None) -> DataFrame:
    """(scope, episode, eviction, ids): the oldest `batch` events of an episode whenever one more than
    `capacity` are held. State: the ids in the context, at most `capacity` of them, for ever or until
    `horizon` seconds of event time after the episode's last event."""

    def step(key: tuple, rows: pd.DataFrame, state: tuple | None) -> tuple[pd.DataFrame, tuple]:
        held, count = (list(state[0]), state[1]) if state else ([], 0)
        out = []
        for ident in rows["id"]:
            held.append(ident)
            if len(held) > capacity:
                count += 1
                out.append((key[0], key[1], count, held[:batch]))
                held = held[batch:]
        return pd.DataFrame(out, columns=["scope", "episode", "eviction", "ids"]), (held, count)

    return _stateful(messages, ["scope", "episode"], "scope string, episode string, eviction bigint, ids array<string>", "ids array<string>, n bigint", step, horizon)


def sync_vectors(messages: DataFrame, path: str, embed: Callable[[DataFrame], DataFrame], checkpoint: str, scopes_listed: int = 1_000) -> StreamingQuery:
    """Embeds new messages batch by batch and appends those whose (scope, id) has no vector yet. The table
    is partitioned by scope, and a batch reads the partitions of its own scopes (all of them only where
    it has more than `scopes_listed`)."""

    def each(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates(["scope", "id"])
        named = [r["scope"] for r in new.select("scope").distinct().limit(scopes_listed + 1).collect()]  # bounded
        try:
            stored = spark.read.parquet(path).select(F.col("scope").cast("string").alias("scope"), "id")
        except Exception as e:  # the table does not exist before the first batch
            if "PATH_NOT_FOUND" not in str(e):
                raise
        else:
            stored = stored.where(F.col("scope").isin(named)) if len(named) <= scopes_listed else stored
            new = new.join(stored, ["scope", "id"], "left_anti")
        embed(new).write.mode("append").partitionBy("scope").parquet(path)

    return messages.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def collect_now(stream: DataFrame, name: str, checkpoint: str) -> DataFrame:
    """Runs a stream over all that is there and returns what it put out (a Parquet table)."""
    out = f"{checkpoint}/{name}-out"
    query = stream.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", f"{checkpoint}/{name}-state").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)
