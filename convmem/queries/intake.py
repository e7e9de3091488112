"""Queries of sources, intake and the FIFO context."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from convmem.fixtures import sql_with, view
from convmem.operators import fifo, intake
from convmem.plans import versions
from convmem.plans.scratch import shared_dir
from convmem.sources import tables

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql_with(sql, *views)
        return f

    return register


def _sent(spark, sf) -> DataFrame:
    """Messages with zoned times, defaults to fill and some contract violations."""
    m = view(spark, sf, "f_msg")
    zone = F.when(F.col("seq") % 9 == 0, "").when(F.col("seq") % 4 == 0, "+08:00").otherwise("Z")
    stamp = F.date_format(F.timestamp_seconds("t"), "yyyy-MM-dd'T'HH:mm:ss")
    return m.select(
        "scope", "id", "seq", "speaker", F.concat(stamp, zone).alias("time"), F.when(F.col("seq") % 13 == 0, "  ").otherwise(F.col("text")).alias("text"),
        F.when(F.col("seq") % 5 != 0, F.when(F.col("seq") % 17 == 0, "robot").otherwise(F.col("role"))).alias("role"), F.when(F.col("seq") % 3 == 0, "described").alias("media"), "reply_to",
    )


_SENT = """
    WITH sent AS (SELECT scope, id, seq, speaker,
        concat(strftime(to_timestamp(t) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S'), CASE WHEN seq % 9 = 0 THEN '' WHEN seq % 4 = 0 THEN '+08:00' ELSE 'Z' END) AS time, t,
        CASE WHEN seq % 13 = 0 THEN '  ' ELSE text END AS text,
        CASE WHEN seq % 5 <> 0 THEN CASE WHEN seq % 17 = 0 THEN 'robot' ELSE role END END AS role,
        CASE WHEN seq % 3 = 0 THEN 'described' END AS media, reply_to FROM f_msg)"""


@query("ing_1_contract", _SENT + """
    SELECT scope, id, array_to_string(list_filter([
        CASE WHEN seq % 9 = 0 THEN 'zone' END, CASE WHEN trim(text) = '' OR length(text) > 12000 THEN 'text' END,
        CASE WHEN coalesce(role, 'unknown') NOT IN ('user', 'assistant', 'system', 'unknown') THEN 'role' END], lambda x: x IS NOT NULL), ',') AS violations
    FROM sent""", ("f_msg",))
def ing_1(spark, sf):
    """Contract violations of every message."""
    out = intake.check_messages(intake.with_defaults(_sent(spark, sf)))
    return out.select("scope", "id", F.array_join("violations", ",").alias("violations"))


@query("ing_2_instants", _SENT + """
    SELECT scope, id, CASE WHEN seq % 9 <> 0 THEN t - CASE WHEN seq % 4 = 0 THEN 28800 ELSE 0 END END AS instant FROM sent""", ("f_msg",))
def ing_2(spark, sf):
    """Instants of zoned times; null without a zone."""
    return _sent(spark, sf).select("scope", "id", F.unix_timestamp(intake.zoned_instant(F.col("time"))).alias("instant"))


@query("ing_3_defaults", _SENT + "SELECT scope, coalesce(role, 'unknown') AS role, coalesce(media, 'none') AS media, count(*) AS n FROM sent GROUP BY ALL", ("f_msg",))
def ing_3(spark, sf):
    """Messages by role and media after defaults."""
    return intake.with_defaults(_sent(spark, sf)).groupBy("scope", "role", "media").agg(F.count("*").alias("n"))


@query("ing_4_dedup", """
    SELECT scope, id, arrival, CASE WHEN arrival = first_value(arrival) OVER w THEN 'first' WHEN text IS NOT DISTINCT FROM first_value(text) OVER w THEN 'duplicate' ELSE 'conflict' END AS outcome
    FROM f_dup WINDOW w AS (PARTITION BY scope, id ORDER BY arrival)""", ("f_dup",))
def ing_4(spark, sf):
    """First arrivals, duplicates and conflicts."""
    return intake.dedup(view(spark, sf, "f_dup"), ["text"]).select("scope", "id", "arrival", "outcome")


@query("ing_5_replies", """
    SELECT m.scope, m.id, CASE WHEN m.r IS NULL THEN 'none' WHEN t.seq < m.seq THEN 'resolved' ELSE 'dangling' END AS reply_state
    FROM (SELECT *, CASE WHEN seq % 10 = 3 THEN concat('x', id) ELSE reply_to END AS r FROM f_msg) m LEFT JOIN f_msg t ON t.scope = m.scope AND t.id = m.r""", ("f_msg",))
def ing_5(spark, sf):
    """Whether each reply target came before."""
    m = view(spark, sf, "f_msg").withColumn("reply_to", F.when(F.col("seq") % 10 == 3, F.concat(F.lit("x"), "id")).otherwise(F.col("reply_to")))
    # Targets that nobody sent are left dangling.
    return intake.resolve_replies(m).select("scope", "id", "reply_state")


@query("ing_6_time_regressions", """
    SELECT scope, id, latest_before FROM (SELECT *, max(t2) OVER (PARTITION BY scope, episode ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest_before
    FROM (SELECT *, t - CASE WHEN seq % 7 = 0 THEN 1000 ELSE 0 END AS t2 FROM f_msg)) WHERE t2 < latest_before""", ("f_msg",))
def ing_6(spark, sf):
    """Messages whose time goes backwards within their episode."""
    m = view(spark, sf, "f_msg").withColumn("t", F.col("t") - F.when(F.col("seq") % 7 == 0, 1000).otherwise(0))
    return intake.time_regressions(m).select("scope", "id", "latest_before")


@query("ing_7_sequence", """
    SELECT scope, id, s, highest_before FROM (SELECT *, max(s) OVER (PARTITION BY scope ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS highest_before
    FROM (SELECT *, seq - CASE WHEN seq % 6 = 0 THEN 2 ELSE 0 END AS s FROM f_msg)) WHERE s <= highest_before""", ("f_msg",))
def ing_7(spark, sf):
    """Sequence numbers that do not increase."""
    m = view(spark, sf, "f_msg").withColumn("s", F.col("seq") - F.when(F.col("seq") % 6 == 0, 2).otherwise(0))
    return intake.sequence_errors(m, "s", "seq").select("scope", "id", "s", "highest_before")


@query("ing_8_archive", """
    SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'UNREADABLE_ONLY' WHEN length(text) > 1024 THEN 'TEXT_LIMIT' END AS archive FROM documents""")
def ing_8(spark, sf):
    """The archive class of each text."""
    d = view(spark, sf, "documents")
    empty = F.col("doc_id") % 11 == 0
    return d.select("doc_id", intake.archive_class(F.when(empty, "").otherwise(F.col("text")), F.when(empty, "unreadable").otherwise("none")).alias("archive"))


@query("ing_9_late", """
    WITH a AS (SELECT event_id, concat('u', user_id % 3) AS scope, epoch_us(ts) AS us, epoch_us(ts) + ((event_id * 7919) % 3600) * 1000000 AS arrival FROM events)
    SELECT scope, event_id, coalesce(us < max(us) OVER (PARTITION BY scope ORDER BY arrival, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS late FROM a""")
def ing_9(spark, sf):
    """Late rows against each scope's clock, in a jittered order of arrival."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    e = view(spark, sf, "events").select("event_id", F.concat(F.lit("u"), (F.col("user_id") % 3).cast("string")).alias("scope"), us.alias("us"), (us + ((F.col("event_id") * 7919) % 3600) * 1000000).alias("arrival"))
    return intake.late_rows(e, "us", ["arrival", "event_id"]).select("scope", "event_id", "late")


@query("ing_10_quota", """
    SELECT scope, id, rows_so_far, bytes_so_far, rows_so_far > 20 OR bytes_so_far > 8000 AS over_quota FROM (
    SELECT scope, id, count(*) OVER w AS rows_so_far, CAST(sum(strlen(text)) OVER w AS BIGINT) AS bytes_so_far FROM f_msg WINDOW w AS (PARTITION BY scope ORDER BY seq))""", ("f_msg",))
def ing_10(spark, sf):
    """Running rows and bytes of each scope against a quota."""
    return intake.over_quota(view(spark, sf, "f_msg"), 20, 8000).select("scope", "id", "rows_so_far", "bytes_so_far", "over_quota")


@query("ing_11_size_guard", "SELECT scope, episode, count(*) AS n, count(*) > 4 AS over_limit FROM f_msg GROUP BY ALL", ("f_msg",))
def ing_11(spark, sf):
    """Episodes over a size limit."""
    return intake.size_guard(view(spark, sf, "f_msg"), ["scope", "episode"], 4)


@query("src_1_messages", "SELECT scope, id, speaker, text, reply_to FROM f_msg", ("f_msg",))
def src_1(spark, sf):
    """Messages written as lines and as arrays into one folder, and read back whole."""
    m = view(spark, sf, "f_msg")
    event = F.struct("id", "speaker", F.col("t").cast("string").alias("time"), "text", F.col("reply_to").alias("replyTo"))
    wrapped = m.select(F.struct("scope", event.alias("event")).alias("m"), "seq")
    path = f"{shared_dir(spark)}/convmem-messages-{uuid.uuid4().hex}"
    wrapped.where("m.scope < 'g3'").select(F.to_json("m").alias("value")).write.mode("append").text(path)
    arrays = wrapped.where("m.scope >= 'g3'").groupBy("m.scope", F.floor(F.col("seq") / 500)).agg(F.collect_list("m").alias("l"))
    arrays.select(F.to_json("l").alias("value")).write.mode("append").option("maxRecordsPerFile", 1).text(path)
    return tables.read_messages(spark, path).select("scope", "id", "speaker", "text", "reply_to")


@query("src_2_scope_scan", "SELECT id, seq, speaker, t FROM f_msg WHERE scope = 'g3'", ("f_msg",))
def src_2(spark, sf):
    """All messages of one scope."""
    return view(spark, sf, "f_msg").where("scope = 'g3'").select("id", "seq", "speaker", "t")


_CURSORS = "WITH cur AS (SELECT scope, CASE WHEN substr(scope, 2) = '5' THEN NULL ELSE max(seq) // 2 END AS after FROM f_msg GROUP BY scope)"


@query("src_3_next_rows", _CURSORS + """
    SELECT scope, id, seq FROM (SELECT m.*, row_number() OVER (PARTITION BY m.scope ORDER BY seq) AS r FROM f_msg m JOIN cur ON cur.scope = m.scope WHERE seq > coalesce(after, -1)) WHERE r <= 5""", ("f_msg",))
def src_3(spark, sf):
    """The next five rows after each scope's cursor."""
    m = view(spark, sf, "f_msg")
    cur = m.groupBy("scope").agg(F.max("seq").alias("m")).select("scope", F.when(F.col("scope") != "g5", F.floor(F.col("m") / 2)).alias("after"))
    return tables.next_rows(m, cur, 5)[0].select("scope", "id", "seq")


@query("src_4_scope_summary", """
    SELECT s.scope, s.revision, n_events, coalesce(n_nodes, 0) AS n_nodes, pending FROM
    (SELECT scope, max(seq) AS revision, count(*) AS n_events, count(*) FILTER (seq % 4 = 0) AS pending FROM f_msg GROUP BY scope) s
    LEFT JOIN (SELECT concat('g', vec_id % 20) AS scope, count(*) AS n_nodes FROM embeddings GROUP BY 1) n ON n.scope = s.scope""", ("f_msg",))
def src_4(spark, sf):
    """Counts per scope over several tables."""
    m = view(spark, sf, "f_msg").withColumn("processed", F.col("seq") % 4 != 0)
    n = view(spark, sf, "embeddings").select(F.concat(F.lit("g"), (F.col("vec_id") % 20).cast("string")).alias("scope"))
    scopes = m.groupBy("scope").agg(F.max("seq").alias("revision"))
    return tables.scope_summary({"events": m, "nodes": n}, m, scopes)


@query("src_5_export", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE user_id % 20 = 3")
def src_5(spark, sf):
    """One scope's rows with their JSON column parsed."""
    e = view(spark, sf, "events").withColumn("scope", F.concat(F.lit("s"), (F.col("user_id") % 20).cast("string")))
    out = tables.export_scope({"events": e}, "s3", {"events": {"props": "k bigint"}})["events"]
    return out.select("event_id", F.col("props.k").alias("k"))


@query("src_6_as_of", """
    SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r FROM orders WHERE o_orderkey <= 5000) WHERE r = 1 AND o_orderkey % 10 <> 0""")
def src_6(spark, sf):
    """The newest row of each key as of a revision; some are deletions."""
    o = view(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", F.col("o_orderkey").alias("rev"), (F.col("o_orderkey") % 10 == 0).alias("deleted"))
    return tables.as_of(o, ["o_custkey"], 5000).select("o_custkey", "o_orderkey", "o_orderstatus")


@query("src_6_changes", """
    SELECT o_orderkey, 'removed' AS change FROM orders WHERE o_orderkey % 97 = 0
    UNION ALL SELECT o_orderkey, 'changed' FROM orders WHERE o_orderkey % 89 = 0 AND o_orderkey % 97 <> 0
    UNION ALL SELECT -1 - o_orderkey, 'added' FROM orders WHERE o_orderkey % 101 = 0""")
def src_6_changes(spark, sf):
    """What differs between two versions of a table, found down a hash tree."""
    o = view(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    edited = o.where("o_orderkey % 97 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 89 == 0, "X").otherwise(F.col("o_orderstatus")))
    added = o.where("o_orderkey % 101 = 0").withColumn("o_orderkey", -1 - F.col("o_orderkey"))
    old, new = (versions.write_version(rows, ["o_orderkey"]) for rows in (o, edited.unionByName(added)))
    return versions.changes(old, new)[0]


@query("src_7_audit", "SELECT scope, id, seq FROM f_msg WHERE scope = 'g7' AND seq = 1", ("f_msg",))
def src_7(spark, sf):
    """Looks an audited row up again after an append by scope."""
    path = f"{shared_dir(spark)}/convmem-audit-{uuid.uuid4().hex}"
    m = view(spark, sf, "f_msg").select("scope", "id", "seq")
    tables.append_audit(m, path)
    first = m.where("scope = 'g7' AND seq = 1").select("id").first()
    return tables.find_audit(spark, path, "g7", first["id"]).select("scope", "id", "seq")


@query("src_8_insert_new", "SELECT vec_id FROM embeddings WHERE vec_id % 3 <> 0")
def src_8(spark, sf):
    """Vectors that an insert-or-ignore would append."""
    v = view(spark, sf, "embeddings").select("vec_id")
    return tables.insert_new(v.where("vec_id % 3 = 0"), v.unionByName(v), ["vec_id"])


@query("src_9_status", """
    SELECT concat('u', user_id % 5) AS scope, event_type AS status, count(*) AS n FROM events GROUP BY ALL""")
def src_9(spark, sf):
    """Rows by scope and status."""
    return tables.status_rollup(view(spark, sf, "events").select(F.concat(F.lit("u"), (F.col("user_id") % 5).cast("string")).alias("scope"), F.col("event_type").alias("status")))


@query("src_10_latest", "SELECT scope, id, rank FROM (SELECT scope, id, CAST(row_number() OVER (PARTITION BY scope ORDER BY seq DESC) AS INTEGER) AS rank FROM f_msg) WHERE rank <= 20", ("f_msg",))
def src_10(spark, sf):
    """The newest twenty of each scope."""
    return tables.latest_per_scope(view(spark, sf, "f_msg")).select("scope", "id", "rank")


_FIFO = """
    WITH p AS (SELECT scope, id, seq, row_number() OVER (PARTITION BY scope ORDER BY seq) AS position, count(*) OVER (PARTITION BY scope) AS n FROM f_msg),
    s AS (SELECT *, (position - 1) // 6 + 1 AS eviction, 13 + ((position - 1) // 6) * 6 AS fired_at FROM p)"""


@query("fif_1_schedule", _FIFO + "SELECT scope, id, CAST(eviction AS INTEGER) AS eviction, CAST(fired_at AS INTEGER) AS fired_at, fired_at <= n AS evicted FROM s", ("f_msg",))
def fif_1(spark, sf):
    """When each event leaves the context of its scope."""
    return fifo.eviction_schedule(view(spark, sf, "f_msg"), key=["scope"]).select("scope", "id", "eviction", "fired_at", "evicted")


@query("fif_2_payloads", _FIFO + """
    , k AS (SELECT DISTINCT scope, eviction FROM s WHERE fired_at <= n)
    SELECT k.scope, CAST(k.eviction AS INTEGER) AS eviction,
      string_agg(s.id, ',' ORDER BY position) FILTER (s.eviction = k.eviction) AS evicted_ids,
      string_agg(s.id, ',' ORDER BY position) FILTER (s.eviction > k.eviction) AS context_ids
    FROM k JOIN s ON s.scope = k.scope AND s.eviction >= k.eviction AND s.position <= 13 + (k.eviction - 1) * 6 GROUP BY ALL""", ("f_msg",))
def fif_2(spark, sf):
    """What each eviction takes out and what remains."""
    p = fifo.eviction_payloads(view(spark, sf, "f_msg"), key=["scope"])
    return p.select("scope", "eviction", F.array_join("evicted_ids", ",").alias("evicted_ids"), F.array_join("context_ids", ",").alias("context_ids"))


@query("fif_3_residual", _FIFO + "SELECT scope, string_agg(id, ',' ORDER BY position) AS context_ids FROM s WHERE fired_at > n GROUP BY scope", ("f_msg",))
def fif_3(spark, sf):
    """What each scope's context still holds."""
    return fifo.residual_context(view(spark, sf, "f_msg"), key=["scope"]).select("scope", F.array_join("context_ids", ",").alias("context_ids"))


@query("fif_4_ids", _FIFO + """
    SELECT DISTINCT scope, CAST(eviction AS INTEGER) AS eviction, concat('eviction_', substr(sha256(concat('["', scope, '","', CAST(eviction AS VARCHAR), '"]')), 1, 24)) AS eviction_id FROM s WHERE fired_at <= n""", ("f_msg",))
def fif_4(spark, sf):
    """Deterministic ids of the evictions."""
    s = fifo.eviction_schedule(view(spark, sf, "f_msg"), key=["scope"]).where("evicted")
    return s.select("scope", "eviction").distinct().withColumn("eviction_id", fifo.eviction_id(["scope"]))


@query("fif_5_working_size", _FIFO + """
    SELECT scope, CAST(sum(b) AS BIGINT) AS n_bytes, sum(b) > 6000 AS over_limit FROM (
      SELECT s.scope, strlen(m.text) AS b FROM s JOIN f_msg m ON m.id = s.id WHERE fired_at > n
      UNION ALL SELECT scope, strlen(text) FROM f_msg WHERE seq % 5 = 0) GROUP BY scope""", ("f_msg",))
def fif_5(spark, sf):
    """Bytes of contexts and pending inputs."""
    m = view(spark, sf, "f_msg")
    return fifo.working_size(fifo.eviction_schedule(m, key=["scope"]).where("NOT evicted"), m.where("seq % 5 = 0"), 6000)


@query("fif_6_byte_guard", """
    SELECT concat(conv_id, '-', turn) AS run_id, CAST(strlen(concat('{"role":"', role, '","turn":', turn, '}')) AS INTEGER) AS n_bytes, strlen(concat('{"role":"', role, '","turn":', turn, '}')) > 26 AS over_limit FROM conversations""")
def fif_6(spark, sf):
    """Bytes of each run's JSON against a guard."""
    c = view(spark, sf, "conversations").withColumn("run_id", F.concat("conv_id", F.lit("-"), "turn"))
    return fifo.byte_guard(c, ["role", "turn"], 26)


@query("fif_7_episode_state", """
    WITH p AS (SELECT *, row_number() OVER (PARTITION BY scope, episode ORDER BY seq) AS position, count(*) OVER (PARTITION BY scope, episode) AS n FROM f_msg)
    SELECT scope, episode, string_agg(id, ',' ORDER BY seq) AS history,
      coalesce(string_agg(id, ',' ORDER BY seq) FILTER (4 + ((position - 1) // 2) * 2 > n), '') AS context,
      coalesce(string_agg(concat('t', id), ',' ORDER BY concat('t', id)) FILTER (seq % 3 = 0 AND seq % 2 = 0), '') AS active_temporaries,
      coalesce(string_agg(concat('f', id), ',' ORDER BY concat('f', id)) FILTER (seq % 5 = 0), '') AS finals
    FROM p GROUP BY scope, episode""", ("f_msg",))
def fif_7(spark, sf):
    """The state of each episode as arrays."""
    m = view(spark, sf, "f_msg")
    temporaries = m.where("seq % 3 = 0").select("scope", "episode", F.concat(F.lit("t"), "id").alias("id"), F.when(F.col("seq") % 2 == 0, "ACTIVE").otherwise("ARCHIVED").alias("status"))
    finals = m.where("seq % 5 = 0").select("scope", "episode", F.concat(F.lit("f"), "id").alias("id"))
    s = fifo.episode_state(m, temporaries, finals, 3, 2)
    return s.select("scope", "episode", *[F.array_join(c, ",").alias(c) for c in ("history", "context", "active_temporaries", "finals")])
