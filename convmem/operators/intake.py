"""Intake: contract checks, deduplication, reply resolution, late data, quotas.

Messages are rows with scope, id, seq (log order within a scope) and the message's fields. Every
operator is keyed by scope, so any number of scopes runs in one job. Null and empty cases are
stated for each operator; an empty table gives an empty result throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from convmem.plans.joins import own_names
from convmem.plans.running import Running, running, whole_number

ROLES = ("user", "assistant", "system", "unknown")
MEDIA = ("none", "described", "unreadable")
#: Zone suffix of an ISO-8601 time: Z or an offset.
_ZONED = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}([.]\d{1,9})?)?(Z|[+-]\d{2}:?\d{2})$"


def _rules(*named: tuple[str, Column]) -> Column:
    """The names of the rules whose condition holds (null counts as not holding)."""
    return F.filter(F.array(*[F.when(broken, F.lit(name)) for name, broken in named]), lambda x: x.isNotNull())


def with_defaults(messages: DataFrame) -> DataFrame:
    """role and media default to 'unknown' and 'none' where they are null."""
    return messages.withColumns({"role": F.coalesce("role", F.lit("unknown")), "media": F.coalesce("media", F.lit("none"))})


def zoned_instant(time: Column) -> Column:
    """The instant of an ISO-8601 text with a zone; null if it has none or is no time."""
    return F.when(time.rlike(_ZONED), F.try_to_timestamp(time))


def check_messages(messages: DataFrame) -> DataFrame:
    """Adds violations: the names of the contract rules that a message breaks (empty: none).

    Columns: id, speaker, time, text, role, media, reply_to. Null id, speaker, time or text breaks
    its rule; null reply_to does not.
    """
    def short(c: str) -> Column:
        return F.col(c).isNull() | (F.trim(c) == "") | (F.char_length(c) > 200)

    blank = F.col("text").isNull() | (F.trim(F.translate("text", "\n\t\r", "   ")) == "") | (F.char_length("text") > 12000)
    return messages.withColumn("violations", _rules(
        ("id", short("id")), ("speaker", short("speaker")), ("time", short("time")), ("zone", zoned_instant(F.col("time")).isNull()),
        ("text", blank), ("role", F.col("role").isNull() | ~F.col("role").isin(*ROLES)), ("media", F.col("media").isNull() | ~F.col("media").isin(*MEDIA)),
        ("reply_to", F.char_length("reply_to") > 200),
    ))


def dedup(messages: DataFrame, content: list[str], arrival: str = "arrival") -> DataFrame:
    """Adds outcome: first, duplicate (same content as the first arrival of its scope and id) or
    conflict (other content). Null content columns compare as equal to null.

    The first arrival is found by a combining minimum and joined back, so an id that is resent
    without end is no single task's group; AQE splits it in the join.
    """
    digest = F.sha2(F.to_json(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in content])), 256)
    hashed = messages.withColumn("_hash", digest)
    first = hashed.groupBy("scope", "id").agg(F.min(F.struct(arrival, "_hash")).alias("_first"))
    joined = hashed.join(first, ["scope", "id"])
    outcome = F.when(F.col(arrival) == F.col(f"_first.{arrival}"), "first").when(F.col("_hash") == F.col("_first._hash"), "duplicate").otherwise("conflict")
    return joined.withColumn("outcome", outcome).drop("_hash", "_first")


def resolve_replies(messages: DataFrame) -> DataFrame:
    """Adds reply_state: none, resolved (the target came earlier in the scope) or dangling."""
    targets = messages.groupBy("scope", "id").agg(F.min("seq").alias("_target_seq")).withColumnRenamed("id", "reply_to")
    joined = messages.join(targets, ["scope", "reply_to"], "left")
    state = F.when(F.col("reply_to").isNull(), "none").when(F.col("_target_seq") < F.col("seq"), "resolved").otherwise("dangling")
    return joined.withColumn("reply_state", state).drop("_target_seq")


def _before(key: list[str], order: str) -> Window:
    return Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def time_regressions(messages: DataFrame, time: str = "t") -> DataFrame:
    """Messages whose time lies before an earlier message of their episode."""
    latest = F.max(time).over(_before(["scope", "episode"], "seq"))
    return messages.withColumn("latest_before", latest).where(F.col(time) < F.col("latest_before"))


def sequence_errors(messages: DataFrame, sequence: str, order: str) -> DataFrame:
    """Messages whose sequence number does not exceed all earlier ones of their scope."""
    number = whole_number(messages, sequence)
    if number is None:  # no integers: the window's plan at any size
        ranked = messages.withColumn("highest_before", F.max(sequence).over(_before(["scope"], order)))
    else:
        ranked = running(messages, ["scope"], [order], highest_before=Running("max", number))
        number = whole_number(ranked, sequence)
    return ranked.where((F.col(sequence) if number is None else number) <= F.col("highest_before"))


def archive_class(text: Column, media: Column, limit: int = 1024) -> Column:
    """UNREADABLE_ONLY (no text, media unreadable), TEXT_LIMIT (longer than limit), else null."""
    empty = F.trim(F.coalesce(text, F.lit(""))) == ""
    return F.when(empty & (media == "unreadable"), "UNREADABLE_ONLY").when(F.char_length(text) > limit, "TEXT_LIMIT")


def late_rows(messages: DataFrame, time: str, arrival: list[str], archived: Column | None = None) -> DataFrame:
    """Adds late: true where a row's time lies before the scope's clock, the largest time of
    earlier rows that were themselves neither archived nor late.

    A late row never raises the clock above what it already is, so the running maximum over all
    earlier rows that are not archived is that clock. Equal times are not late; archived rows
    are not judged.
    """
    put_away = F.coalesce(archived, F.lit(False)) if archived is not None else F.lit(False)
    judged, clock, at = own_names(messages.columns, "away", "clock", "at")
    number = whole_number(messages, time)
    marked = messages.withColumn(judged, put_away).withColumn(at, F.col(time) if number is None else number)
    value = F.when(~F.col(judged), F.col(at))
    if number is None:
        w = Window.partitionBy("scope").orderBy(*arrival).rowsBetween(Window.unboundedPreceding, -1)
        marked = marked.withColumn(clock, F.max(value).over(w))
    else:
        marked = running(marked, ["scope"], arrival, **{clock: Running("max", value)})
    return marked.withColumn("late", ~F.col(judged) & F.coalesce(F.col(at) < F.col(clock), F.lit(False))).drop(judged, clock, at)


def over_quota(messages: DataFrame, max_rows: int = 50_000, max_bytes: int = 268_435_456, order: str = "seq") -> DataFrame:
    """Adds rows_so_far, bytes_so_far (UTF-8) and over_quota for each scope in arrival order."""
    out = running(messages, ["scope"], [order], rows_so_far=Running("count", F.lit(1), inclusive=True), bytes_so_far=Running("sum", F.octet_length("text"), inclusive=True))
    return out.withColumn("over_quota", (F.col("rows_so_far") > max_rows) | (F.col("bytes_so_far") > max_bytes))


def size_guard(rows: DataFrame, key: list[str], limit: int) -> DataFrame:
    """How many rows each key has, and whether that passes the limit; nothing is cut."""
    return rows.groupBy(*key).agg(F.count("*").alias("n")).withColumn("over_limit", F.col("n") > limit)
