"""Dedup of a stream with state that has a lifetime, and the state read back as an audit."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from convmem.streaming.topics import use_rocksdb

OUTCOME = "scope string, id string, arrival bigint, outcome string"
#: Parts of a scope's ids: a hot scope is dealt to as many keys.
PARTS = 64


class FirstTexts(StatefulProcessor):
    """Keeps the digest of each id's first text, for lifetime_ms after it was stored (None: for ever)."""

    def __init__(self, lifetime_ms: int | None):
        self.lifetime_ms = lifetime_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getMapState("first", "id string", "hash string", self.lifetime_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("arrival", kind="stable")
        known: dict[str | None, str | None] = {}
        outcomes = []
        for ident, text in zip(batch["id"], batch["text"], strict=True):
            digest = hashlib.sha256((text if text is not None else "\0").encode()).hexdigest()
            if ident not in known:
                stored = self.first.getValue((ident,)) if self.first.containsKey((ident,)) else None
                known[ident] = stored[0] if stored else None
            if known[ident] is None:
                known[ident] = digest
                self.first.updateValue((ident,), (digest,))
                outcomes.append("first")
            else:
                outcomes.append("duplicate" if known[ident] == digest else "conflict")
        yield pd.DataFrame({"scope": batch["scope"], "id": batch["id"], "arrival": batch["arrival"], "outcome": outcomes})


def first_text_stream(messages: DataFrame, lifetime: float | None = None, parts: int = PARTS) -> DataFrame:
    """(scope, id, arrival, outcome): first, duplicate or conflict against the first text of a scope's id, as
    jobs.dedup_stream. State: a map from ids to digests under RocksDB for each scope and part of its ids; an entry
    leaves it `lifetime` seconds of processing time after it was stored (None: never), by itself. A query whose
    state has a lifetime goes on until it is stopped: availableNow does not end it.
    """
    use_rocksdb(messages.sparkSession)
    dealt = messages.select("scope", "id", "arrival", "text", F.pmod(F.xxhash64("id"), F.lit(parts)).alias("_part"))
    return dealt.groupBy("scope", "_part").transformWithStateInPandas(FirstTexts(None if lifetime is None else int(1000 * lifetime)), OUTCOME, "append", "ProcessingTime" if lifetime is not None else "None")


def stored_ids(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(scope, id, hash) that a first_text_stream with this checkpoint holds."""
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "first").load()
    value = F.col("user_map_value")
    inner = state.schema["user_map_value"].dataType.names
    digest = value["hash"] if "hash" in inner else value["value"]["hash"]
    return state.select(F.col("key")["scope"].alias("scope"), F.col("user_map_key")["id"].alias("id"), digest.alias("hash"))
