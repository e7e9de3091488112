"""Topics as streams: lifecycle with timers, and routing of live messages to open topics.

State is kept with transformWithStateInPandas under RocksDB: one map entry an open topic of a scope, and
an event-time timer, so a silent scope's topics close, and leave the state, without another row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from convmem.operators.segment import OpenTopic, TopicIndex, routed_messages

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CLOSED = "scope string, episode string, first_id string, first_t bigint, last_t bigint, n bigint, reason string"
ROUTED = "scope string, seq bigint, id string, episode string"


def _timed(messages: DataFrame, delay: int) -> DataFrame:
    """The stream with its event time; rows that come more than delay seconds behind the latest are late."""
    use_rocksdb(messages.sparkSession)
    return messages.withColumn("_ts", F.timestamp_seconds("t")).withWatermark("_ts", f"{delay} seconds")


def use_rocksdb(spark: SparkSession) -> None:
    """Stateful processors need this store; a running query keeps the one it began with."""
    if spark.conf.get(_PROVIDER, "") != _ROCKSDB:
        spark.conf.set(_PROVIDER, _ROCKSDB)


class _Waking(StatefulProcessor):
    """Keeps one timer a key, at the earliest time that something falls due."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle

    def wake_at(self, seconds: int | None, watermark_ms: int) -> None:
        wanted = None if seconds is None else max(1000 * seconds, watermark_ms + 1)
        held = list(self.handle.listTimers())
        for ms in held:
            if ms != wanted:
                self.handle.deleteTimer(ms)
        if wanted is not None and wanted not in held:
            self.handle.registerTimer(wanted)


class Lifecycle(_Waking):
    def __init__(self, ttl: int, span: int, most: int):
        self.ttl, self.span, self.most = ttl, span, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.open = handle.getMapState("open", "episode string", "first_id string, first_t bigint, last_t bigint, n bigint")

    def due_at(self, topic: tuple) -> int:
        _, first, last, n = topic
        return last if n >= self.most else min(last + self.ttl, first + self.span)

    def why(self, topic: tuple) -> str:
        """What closes a topic that is due: its count, or the deadline that comes first."""
        _, first, last, n = topic
        return "count" if n >= self.most else "ttl" if last + self.ttl <= first + self.span else "span"

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        stored = {k[0]: tuple(v) for k, v in self.open.iterator()}
        topics, closed = dict(stored), []

        def finish(episode: str, reason: str) -> None:
            closed.append((key[0], episode, *topics.pop(episode), reason))

        for ident, t, text, episode in pd.concat(list(rows)).sort_values("arrival", kind="stable")[["id", "t", "text", "episode"]].itertuples(index=False, name=None):
            for name in [k for k, v in topics.items() if self.due_at(v) <= t]:
                finish(name, self.why(topics[name]))
            if ident is None:
                for name in [k for k in topics if text == "close" and episode in (None, k)]:
                    finish(name, "close")
                continue
            first_id, first, _, n = topics.get(episode, (ident, t, t, 0))
            topics[episode] = (first_id, first, t, n + 1)
        for name in stored.keys() - topics.keys():
            self.open.removeKey((name,))
        for name, own in topics.items():
            if stored.get(name) != own:
                self.open.updateValue((name,), own)
        self.wake_at(min(map(self.due_at, topics.values()), default=None), timerValues.getCurrentWatermarkInMs())
        yield self._rows(closed)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        closed, next_due = [], None
        for (name,), own in list(self.open.iterator()):
            own = tuple(own)
            if 1000 * self.due_at(own) <= now:
                closed.append((key[0], name, *own, self.why(own)))
                self.open.removeKey((name,))
            else:
                next_due = min(next_due or self.due_at(own), self.due_at(own))
        self.wake_at(next_due, now)
        yield self._rows(closed)

    @staticmethod
    def _rows(closed: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(closed, columns=[c.split()[0] for c in CLOSED.split(", ")])


def lifecycle_stream(messages: DataFrame, ttl: int = 900, span: int = 3600, most: int = 24, delay: int = 60) -> DataFrame:
    """Closed topics (scope, episode, first_id, first_t, last_t, n, reason) of a stream of messages, each
    of which names its topic in `episode`. A scope has any number of open topics.

    A topic is due ttl seconds after its last message, span seconds after its first, or with `most` messages.
    What is due closes before the scope's next row, be it a message or a control row (null id, text `tick`),
    or by itself once the stream's time has passed: a scope needs no further row. A control row `close` closes the topic that it
    names, or all if it names none. The reason is the deadline that came first (count, ttl, span) or `close`, and so
    does not depend on who noticed. A message to a closed topic's name opens it anew, told by its
    first_id.

    Rows of a micro-batch are taken in order of arrival. `delay` (seconds) must cover how far scopes lag behind
    each other: rows behind the watermark are dropped. State: the open topics only.
    """
    return _timed(messages, delay).groupBy("scope").transformWithStateInPandas(Lifecycle(ttl, span, most), CLOSED, "append", "EventTime")


class Routing(_Waking):
    def __init__(self, route: Callable, ttl: int, span: int, most: int, threshold: float):
        self.route, self.threshold, self.limits = route, threshold, (ttl, span, most)

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        view = "struct<slot: int, speaker: string, grams: array<string>>"
        self.open = handle.getMapState("open", "episode string", f"first_t bigint, last_t bigint, last_seq bigint, ids array<string>, views array<{view}>")

    def _index(self) -> TopicIndex:
        index = TopicIndex(*self.limits)
        index.restore(OpenTopic(k[0], v[0], v[1], v[2], list(v[3]), {w[0]: (w[1], list(w[2])) for w in v[4]}) for k, v in self.open.iterator())
        return index

    def _keep(self, index: TopicIndex, before: dict[str, int], watermark_ms: int) -> None:
        for name in before.keys() - index.topics.keys():
            self.open.removeKey((name,))
        for name, own in index.topics.items():
            if before.get(name) != own.last_seq:
                self.open.updateValue((name,), (own.first_t, own.last_t, own.last_seq, own.ids, [(slot, who, list(grams)) for slot, (who, grams) in own.views.items()]))
        self.wake_at(index.next_due(), watermark_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        index = self._index()
        before = {name: own.last_seq for name, own in index.topics.items()}
        batch = pd.concat(list(rows)).sort_values("seq", kind="stable")
        columns = batch[["seq", "id", "t", "speaker", "reply_to", "grams"]].itertuples(index=False, name=None)
        placed = [index.place(key[0], (*m[:5], list(m[5])), self.route, self.threshold) for m in columns]
        self._keep(index, before, timerValues.getCurrentWatermarkInMs())
        yield pd.DataFrame({"scope": key[0], "seq": batch["seq"], "id": batch["id"], "episode": placed})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        index = self._index()
        before = {name: own.last_seq for name, own in index.topics.items()}
        index.close(timerValues.getCurrentWatermarkInMs() // 1000)
        self._keep(index, before, timerValues.getCurrentWatermarkInMs())
        yield pd.DataFrame([], columns=[c.split()[0] for c in ROUTED.split(", ")])


def routing_stream(messages: DataFrame, route: Callable[[list[tuple[float, str]]], tuple[float, list[float]]], ttl: int = 900, span: int = 3600, most: int = 24, threshold: float = 0.5, delay: int = 60) -> DataFrame:
    """(scope, seq, id, episode): live messages routed to one of their scope's open topics or to a new one,
    as operators.segment.assign_topics decides. messages: scope, seq, id, t, speaker, text, reply_to.

    State: a scope's open topics with their views (the first and the last three messages' bigrams); the index over them is
    set up once a micro-batch and then follows each message. Topics that fall due leave the state by timer.
    """
    ready = routed_messages(_timed(messages, delay), "_ts")
    return ready.groupBy("scope").transformWithStateInPandas(Routing(route, ttl, span, most, threshold), ROUTED, "append", "EventTime")
