"""The FIFO working context of an episode: a closed form instead of a loop.

With capacity C and batch B, the event at position p of its episode belongs to eviction
k = (p - 1) div B + 1, which the arrival at position C + 1 + (k - 1) * B fires. So every eviction
follows from a position and a count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from convmem.plans.running import Running, running

KEY = ["scope", "episode"]


def eviction_schedule(events: DataFrame, capacity: int = 12, batch: int = 6, key: list[str] | None = None) -> DataFrame:
    """Adds position, eviction (its number), fired_at (the arrival's position) and evicted."""
    key = key or KEY
    out = running(events, key, ["seq"], position=Running("count", F.lit(1), inclusive=True), _n=Running("total", F.lit(1)))
    out = out.withColumn("position", F.col("position").cast("int"))
    out = out.withColumn("eviction", (F.floor((F.col("position") - 1) / batch) + 1).cast("int"))
    out = out.withColumn("fired_at", (capacity + 1 + (F.col("eviction") - 1) * batch).cast("int"))
    return out.withColumn("evicted", F.col("fired_at") <= F.col("_n")).drop("_n")


def eviction_id(key: list[str], eviction: str = "eviction") -> F.Column:
    """eviction_ and 24 hex digits of the SHA-256 over the key and the number as a JSON array."""
    parts = F.array(*[F.col(k).cast("string") for k in key], F.col(eviction).cast("string"))
    return F.concat(F.lit("eviction_"), F.substring(F.sha2(F.to_json(parts), 256), 1, 24))


def eviction_payloads(events: DataFrame, capacity: int = 12, batch: int = 6, key: list[str] | None = None) -> DataFrame:
    """One row per fired eviction: the evicted events and the context that remains with the
    arriving event, both ordered.

    An event at position p is in the context of eviction k if it is not evicted by k or earlier
    and came no later than the arrival: k ranges over a bounded interval, which is exploded.
    """
    key = key or KEY
    s = eviction_schedule(events, capacity, batch, key)
    total = s.groupBy(*key).agg(F.count("*").alias("_n"))
    e = s.join(total, key)
    first = F.greatest(F.lit(1), F.ceil((F.col("position") - capacity - 1) / batch) + 1).cast("int")
    last = F.least(F.col("eviction"), F.floor((F.col("_n") - capacity - 1) / batch) + 1).cast("int")
    spread = e.where(last >= first).select(*key, "position", "id", "eviction", F.explode(F.sequence(first, last)).alias("k"))
    pair = F.struct("position", "id")
    # Context rows carry k < eviction; the rows with k = eviction are the evicted ones.
    got = spread.groupBy(*key, "k").agg(
        F.sort_array(F.collect_list(F.when(F.col("k") == F.col("eviction"), pair))).alias("_out"),
        F.sort_array(F.collect_list(F.when(F.col("k") < F.col("eviction"), pair))).alias("_in"),
    )
    return got.select(*key, F.col("k").alias("eviction"), F.transform("_out", lambda x: x["id"]).alias("evicted_ids"), F.transform("_in", lambda x: x["id"]).alias("context_ids"))


def residual_context(events: DataFrame, capacity: int = 12, batch: int = 6, key: list[str] | None = None) -> DataFrame:
    """The events still in each episode's context, ordered."""
    key = key or KEY
    left = eviction_schedule(events, capacity, batch, key).where("NOT evicted")
    return left.groupBy(*key).agg(F.transform(F.sort_array(F.collect_list(F.struct("position", "id"))), lambda x: x["id"]).alias("context_ids"))


def working_size(contexts: DataFrame, pending: DataFrame, limit: int = 360_000) -> DataFrame:
    """UTF-8 bytes per scope of open contexts and pending inputs (both with scope, text)."""
    both = contexts.select("scope", "text").unionByName(pending.select("scope", "text"))
    out = both.groupBy("scope").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("n_bytes"))
    return out.withColumn("over_limit", F.col("n_bytes") > limit)


def byte_guard(runs: DataFrame, columns: list[str], limit: int, key: str = "run_id") -> DataFrame:
    """UTF-8 bytes of the JSON of some columns, and whether they pass the limit."""
    size = F.octet_length(F.to_json(F.struct(*columns)))
    return runs.select(key, size.alias("n_bytes"), (size > limit).alias("over_limit"))


def episode_state(events: DataFrame, temporaries: DataFrame, finals: DataFrame, capacity: int = 12, batch: int = 6) -> DataFrame:
    """Per episode its context, full history, active temporaries and final records, as ordered
    arrays; empty arrays where there is none."""
    empty = F.array().cast("array<string>")
    def ids(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*KEY).agg(F.sort_array(F.collect_list("id")).alias(name))
    history = events.groupBy(*KEY).agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "id"))), lambda x: x["id"]).alias("history"))
    out = history.join(residual_context(events, capacity, batch).withColumnRenamed("context_ids", "context"), KEY, "left")
    out = out.join(ids(temporaries.where("status = 'ACTIVE'"), "active_temporaries"), KEY, "left").join(ids(finals, "finals"), KEY, "left")
    return out.select(*KEY, *[F.coalesce(c, empty).alias(c) for c in ("context", "history", "active_temporaries", "finals")])
