"""Queries of formation checks and applies. Drafts are one memory per message; a run is a conversation."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from convmem.fixtures import sql_with, view
from convmem.operators import formation as fm

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ("f_msg",)):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql_with(sql, *views)
        return f

    return register


def _events(spark, sf) -> DataFrame:
    return view(spark, sf, "f_msg").select(F.col("episode").alias("run_id"), F.col("id").alias("event_id"), "speaker", "text", "seq", "scope", "reply_to")


def _evidence(spark, sf) -> DataFrame:
    """A citation per message; some quotes are wrong, some events unknown."""
    quote = F.when(F.col("seq") % 5 == 0, F.concat(F.lit("#"), F.substring("text", 1, 20))).otherwise(F.substring("text", 3, 20))
    event = F.when(F.col("seq") % 11 == 0, F.concat(F.lit("x"), "event_id")).otherwise(F.col("event_id"))
    return _events(spark, sf).select("run_id", F.concat(F.lit("m"), "event_id").alias("key"), event.alias("event_id"), quote.alias("quote"))


_E = "ev AS (SELECT episode AS run_id, id AS event_id, speaker, text, seq, scope, reply_to FROM f_msg)"


def _memories(spark, sf) -> DataFrame:
    """(run_id, key, subject, used, supersedes): a memory uses that of the message it replies to and
    supersedes it now and then."""
    e = _events(spark, sf)
    used = F.when(F.col("reply_to").isNotNull(), F.array(F.concat(F.lit("m"), "reply_to"))).otherwise(F.array().cast("array<string>"))
    return e.select("run_id", F.concat(F.lit("m"), "event_id").alias("key"), F.concat(F.lit("p"), F.when(F.col("seq") % 7 == 0, "?").otherwise(F.col("speaker"))).alias("subject"), used.alias("used"), F.when(F.col("seq") % 3 == 0, used).otherwise(F.array().cast("array<string>")).alias("supersedes"), "seq")


@query("frm_1_shape", """SELECT id AS run_id, rule, part FROM f_msg, (VALUES (2, 'keys', ''), (3, 'value', 'entities'), (4, 'keys', 'memories'), (5, 'text', 'memories'), (6, 'items', 'skipped'), (7, 'value', 'associations'), (8, 'text', 'entities'), (9, 'keys', '')) t(k, rule, part) WHERE seq % 11 = k""")
def frm_1(spark, sf):
    """Drafts that break the contract of their shape, values and limits."""
    m = view(spark, sf, "f_msg")
    k = F.col("seq") % 11
    cite = F.array(F.struct(F.col("id").alias("eventId"), F.lit("x").alias("quote")))
    none = F.array().cast("array<string>")
    name = F.when(k == 8, "  ").otherwise(F.col("speaker"))
    entity = F.struct(F.lit("e1").alias("key"), F.when(k == 3, "ROBOT").otherwise("PERSON").alias("type"), name.alias("label"), F.col("speaker").alias("speakerId"), cite.alias("evidence"))
    text = F.when(k == 5, F.repeat(F.lit("ab"), 6001)).otherwise(F.concat(F.lit("t"), "id"))
    memory = [F.lit("m1").alias("key"), F.lit("GOAL").alias("kind"), text.alias("text"), F.lit("e1").alias("subject"), cite.alias("evidence"), none.alias("usedMemoryIds"), none.alias("supersedes")]
    memory = F.when(k == 4, F.to_json(F.struct(*memory[:-1]))).otherwise(F.to_json(F.struct(*memory)))
    tie = F.struct(F.lit("e1").alias("source"), F.lit("m1").alias("target"), F.when(k == 7, "LIKES").otherwise("CAUSAL").alias("relation"), F.lit(0.5).alias("strength"), cite.alias("evidence"), F.lit("so").alias("rationale"))
    skip = F.array_repeat(F.struct(F.col("id").alias("eventId"), F.lit("no").alias("reason")), F.when(k == 6, 501).otherwise(1).cast("int"))
    parts = [F.lit('{"entities":['), F.to_json(entity), F.lit('],"memories":['), memory, F.lit('],"associations":['), F.to_json(tie), F.lit('],"skipped":'), F.to_json(skip), F.when(k == 2, ',"more":1}').otherwise("}")]
    return fm.draft_violations(m.select(F.col("id").alias("run_id"), F.when(k == 9, "{broken").otherwise(F.concat(*parts)).alias("body")))


@query("frm_2_evidence", f"""WITH {_E} SELECT run_id, CASE WHEN seq % 11 = 0 THEN 'unknown_event' ELSE 'quote' END AS rule, concat('m', event_id) AS key FROM ev
    WHERE seq % 11 = 0 OR (seq % 5 = 0 AND instr(text, concat('#', substr(text, 1, 20))) = 0)""")
def frm_2(spark, sf):
    """Citations of unknown events and quotes that are not there."""
    return fm.evidence_errors(_evidence(spark, sf), _events(spark, sf))


@query("frm_3_pending", f"WITH {_E} SELECT run_id, 'not_pending' AS rule, concat('m', event_id) AS key FROM ev WHERE seq % 11 = 0 OR seq % 2 = 1")
def frm_3(spark, sf):
    """Memories that cite no pending event."""
    return fm.stale_citations(_evidence(spark, sf), _events(spark, sf).where("seq % 2 = 0"))


@query("frm_4_coverage", f"""WITH {_E}, pending AS (SELECT * FROM ev WHERE seq % 2 = 0), skipped AS (SELECT run_id, event_id, seq FROM ev WHERE seq % 6 = 0 UNION ALL SELECT run_id, event_id, seq FROM ev WHERE seq % 12 = 0 OR seq % 15 = 1)
    SELECT run_id, 'uncovered' AS rule, event_id AS key FROM pending WHERE seq % 11 = 0 AND NOT EXISTS (SELECT 1 FROM skipped s WHERE s.event_id = pending.event_id)
    UNION ALL SELECT run_id, 'skipped_twice', event_id FROM skipped GROUP BY run_id, event_id HAVING count(*) > 1
    UNION ALL SELECT run_id, 'skipped_not_pending', event_id FROM skipped WHERE seq % 2 = 1""")
def frm_4(spark, sf):
    """Events left uncovered, skipped twice or skipped without being pending."""
    e = _events(spark, sf)
    skipped = e.where("seq % 6 = 0").unionByName(e.where("seq % 12 = 0 OR seq % 15 = 1"))
    return fm.uncovered_events(e.where("seq % 2 = 0"), _evidence(spark, sf), skipped)


@query("frm_5_keys", f"""WITH {_E}, k AS (SELECT run_id, concat('m', event_id) AS key, seq FROM ev UNION ALL SELECT run_id, concat('m', event_id), seq FROM ev WHERE seq % 8 = 0)
    SELECT run_id, 'repeated_key' AS rule, key FROM k GROUP BY run_id, key HAVING count(*) > 1 UNION ALL SELECT run_id, 'existing_id', key FROM k WHERE seq % 9 = 0""")
def frm_5(spark, sf):
    """Keys that repeat or are taken."""
    k = _memories(spark, sf).select("run_id", "key", "seq")
    return fm.key_errors(k.unionByName(k.where("seq % 8 = 0")), k.where("seq % 9 = 0").select(F.col("key").alias("id")))


@query("frm_6_speakers", f"""WITH {_E}, b AS (SELECT run_id, concat('m', event_id) AS key, CASE WHEN seq % 6 = 0 THEN 'TOPIC' ELSE 'PERSON' END AS type, speaker AS label, CASE WHEN seq % 4 = 0 THEN 'nobody' ELSE speaker END AS speaker_id, seq FROM ev)
    SELECT run_id, 'speaker_label' AS rule, key FROM b WHERE type <> 'PERSON' OR label <> speaker_id
    UNION ALL SELECT run_id, 'speaker_evidence', key FROM b WHERE seq % 11 = 0 OR seq % 4 = 0
    UNION ALL SELECT run_id, 'speaker_twice', speaker_id FROM b GROUP BY run_id, speaker_id HAVING count(*) > 1""")
def frm_6(spark, sf):
    """Speaker bindings that do not hold."""
    e = _events(spark, sf)
    bound = e.select("run_id", F.concat(F.lit("m"), "event_id").alias("key"), F.when(F.col("seq") % 6 == 0, "TOPIC").otherwise("PERSON").alias("type"), F.col("speaker").alias("label"), F.when(F.col("seq") % 4 == 0, "nobody").otherwise(F.col("speaker")).alias("speaker_id"))
    return fm.speaker_errors(bound, _evidence(spark, sf), e)


_MINT = "concat('node_', substr(sha256(concat('[\"', run_id, '\",\"', key, '\"]')), 1, 24))"


@query("frm_7_identity", f"""WITH {_E}, ent AS (SELECT scope, run_id, concat('m', event_id) AS key, speaker AS speaker_id FROM ev), known AS (SELECT scope, speaker AS speaker_id, min(concat('n', event_id)) AS id FROM ev WHERE seq < 4 GROUP BY ALL)
    SELECT ent.scope, run_id, key, coalesce(known.id, {_MINT}) AS node_id FROM ent LEFT JOIN known ON known.scope = ent.scope AND known.speaker_id = ent.speaker_id""")
def frm_7(spark, sf):
    """Speakers resolved to the nodes they already have."""
    e = _events(spark, sf)
    entities = e.select("scope", "run_id", F.concat(F.lit("m"), "event_id").alias("key"), F.col("speaker").alias("speaker_id"))
    nodes = e.where("seq < 4").select("scope", F.col("speaker").alias("speaker_id"), F.concat(F.lit("n"), "event_id").alias("id"))
    return fm.resolve_identity(entities, nodes).select("scope", "run_id", "key", "node_id")


@query("frm_8_references", f"""WITH {_E} SELECT run_id, 'subject' AS rule, concat('m', event_id) AS key FROM ev WHERE seq % 7 = 0
    UNION ALL SELECT m.run_id, 'used_unknown', concat('m', m.event_id) FROM ev m JOIN ev t ON t.event_id = m.reply_to AND t.run_id = m.run_id WHERE t.seq % 4 = 0""")
def frm_8(spark, sf):
    """Subjects and used ids that do not exist."""
    m = _memories(spark, sf)
    known = m.where("seq % 4 <> 0").select("run_id", F.col("key").alias("id"))
    return fm.reference_errors(m, m.where("subject <> 'p?'").select("run_id", F.col("subject").alias("key")), known)


@query("frm_9_supersedes", f"""WITH {_E}, m AS (SELECT run_id, concat('m', event_id) AS key, concat('p', CASE WHEN seq % 7 = 0 THEN '?' ELSE speaker END) AS subject, seq, CASE WHEN reply_to IS NOT NULL THEN concat('m', reply_to) END AS used FROM ev)
    SELECT s.run_id, CASE WHEN t.seq % 5 = 0 THEN 'not_current' ELSE 'other_subject' END AS rule, s.key FROM m s JOIN m t ON t.run_id = s.run_id AND t.key = s.used WHERE s.seq % 3 = 0 AND (t.seq % 5 = 0 OR t.subject <> s.subject)""")
def frm_9(spark, sf):
    """Supersedes of memories that are not current or have another subject."""
    m = _memories(spark, sf)
    known = m.select("run_id", F.col("key").alias("id"), F.when(F.col("seq") % 5 == 0, "SUPERSEDED").otherwise("CURRENT").alias("status"), "subject")
    return fm.supersede_errors(m, known)


_A = """a AS (SELECT concat('r', l_orderkey % 50) AS run_id, concat(l_orderkey, '-', l_linenumber) AS key, concat('k', l_suppkey % 12) AS source, concat('k', l_partkey % 12) AS target,
    CASE l_returnflag WHEN 'A' THEN 'CAUSAL' ELSE 'SIMILARITY' END AS relation, CAST(l_quantity AS DOUBLE) / 48 AS strength FROM lineitem),
    n AS (SELECT DISTINCT run_id, source AS key FROM a WHERE source <> 'k7'), x AS (SELECT a.*, CASE WHEN s.key = 'k3' THEN 'node-k4' ELSE concat('node-', s.key) END AS s, CASE WHEN t.key = 'k3' THEN 'node-k4' ELSE concat('node-', t.key) END AS t
      FROM a LEFT JOIN n s ON s.run_id = a.run_id AND s.key = a.source LEFT JOIN n t ON t.run_id = a.run_id AND t.key = a.target)"""


def _associations(spark, sf):
    li = view(spark, sf, "lineitem")
    a = li.select(F.concat(F.lit("r"), (F.col("l_orderkey") % 50).cast("string")).alias("run_id"), F.concat(F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("key"), F.concat(F.lit("k"), (F.col("l_suppkey") % 12).cast("string")).alias("source"), F.concat(F.lit("k"), (F.col("l_partkey") % 12).cast("string")).alias("target"), F.when(F.col("l_returnflag") == "A", "CAUSAL").otherwise("SIMILARITY").alias("relation"), (F.col("l_quantity").cast("double") / 48).alias("strength"))
    names = a.where("source <> 'k7'").select("run_id", F.col("source").alias("key")).distinct().withColumn("node_id", F.when(F.col("key") == "k3", "node-k4").otherwise(F.concat(F.lit("node-"), "key")))
    return a, names


@query("frm_10_associations", f"""WITH {_A}
    SELECT run_id, CASE WHEN s IS NULL OR t IS NULL OR s = 'node-' OR t = 'node-' THEN 'unknown_end' WHEN s = t THEN 'same_end' ELSE 'strength' END AS rule, key FROM (SELECT run_id, key, CASE WHEN s = 'node-' THEN NULL ELSE s END AS s, CASE WHEN t = 'node-' THEN NULL ELSE t END AS t, strength FROM x)
    WHERE s IS NULL OR t IS NULL OR s = t OR NOT strength BETWEEN 0.01 AND 1
    UNION ALL SELECT run_id, 'repeated', min(key) FROM x WHERE s <> 'node-' AND t <> 'node-' GROUP BY run_id, CASE WHEN relation = 'CAUSAL' THEN s ELSE least(s, t) END, CASE WHEN relation = 'CAUSAL' THEN t ELSE greatest(s, t) END, relation HAVING count(*) > 1""", ())
def frm_10(spark, sf):
    """Associations with wrong ends, strengths or repetitions."""
    return fm.association_errors(*_associations(spark, sf))


def _records(spark, sf):
    """Temporary records by customer orders: id, what they read directly and use."""
    o = view(spark, sf, "orders").select(F.concat(F.lit("r"), (F.col("o_custkey") % 40).cast("string")).alias("run_id"), F.col("o_orderkey").alias("k"))
    ids = lambda c: F.concat(F.lit("t"), c.cast("string"))
    empty = F.array().cast("array<string>")
    return o.select("run_id", ids(F.col("k")).alias("key"), "k", F.when(F.col("k") % 13 == 0, empty).otherwise(F.array(F.lit("a"))).alias("subjects"), F.when(F.col("k") % 3 == 0, empty).otherwise(F.array(F.concat(F.lit("e"), (F.col("k") % 10).cast("string")))).alias("direct"),
                    F.when(F.col("k") % 2 == 0, F.array(F.concat(F.lit("u"), (F.col("k") % 6).cast("string")))).otherwise(empty).alias("used"), F.when(F.col("k") % 8 == 0, F.array(F.concat(F.lit("u"), (F.col("k") % 6).cast("string")))).otherwise(empty).alias("supersedes"))


_R = "o AS (SELECT concat('r', o_custkey % 40) AS run_id, concat('t', o_orderkey) AS key, o_orderkey AS k FROM orders)"


@query("frm_11_records", f"""WITH {_R}, bad AS (
    SELECT run_id, unnest(list_filter([CASE WHEN k % 13 = 0 THEN 'subjects' END, CASE WHEN k % 3 <> 0 AND k % 10 >= 8 THEN 'direct' END, CASE WHEN k % 3 = 0 AND k % 2 <> 0 THEN 'no_source' END,
      CASE WHEN k % 2 = 0 AND k % 6 = 4 THEN 'used' END, CASE WHEN k % 8 = 0 AND k % 6 >= 2 THEN 'supersedes' END], lambda x: x IS NOT NULL)) AS rule, key FROM o)
    SELECT run_id, rule, key FROM bad UNION ALL SELECT run_id, 'replaced_twice', concat('u', k % 6) FROM o WHERE k % 8 = 0 GROUP BY run_id, k % 6 HAVING count(*) > 1""", ())
def frm_11(spark, sf):
    """Temporary records against what their run could read, use and replace."""
    r = _records(spark, sf)
    runs = r.select("run_id").distinct()
    def given(prefix: str, n: int, name: str):
        return runs.select("run_id", F.explode(F.array(*[F.lit(f"{prefix}{i}") for i in range(n)])).alias(name))
    return fm.record_errors(r, given("e", 8, "event_id"), given("u", 4, "id"), given("u", 2, "id"))


@query("frm_12_sources", f"""WITH {_R} SELECT key, CASE WHEN k % 2 = 0 THEN concat('z', k % 6, ',', 'z', k % 6 + 1) ELSE '' END AS inherited,
    concat_ws(',', CASE WHEN k % 3 <> 0 THEN concat('e', k % 10) END, CASE WHEN k % 2 = 0 THEN concat('z', k % 6, ',', 'z', k % 6 + 1) END) AS all_sources FROM o""", ())
def frm_12(spark, sf):
    """Inherited and all sources of each record."""
    r = _records(spark, sf).select(F.col("key").alias("id"), "direct", "used")
    n = F.substring("id", 2, 3).cast("int")
    sources = r.select(F.explode("used").alias("id")).distinct().select("id", F.array(F.concat(F.lit("z"), n.cast("string")), F.concat(F.lit("z"), (n + 1).cast("string"))).alias("source_ids"))
    out = fm.with_sources(r, sources)
    return out.select(F.col("id").alias("key"), F.array_join("inherited", ",").alias("inherited"), F.array_join("all_sources", ",").alias("all_sources"))


@query("frm_13_formed_with", f"WITH {_R} SELECT key AS source, concat('u', k % 6) AS target FROM o WHERE k % 2 = 0", ())
def frm_13(spark, sf):
    """Provenance links to used records."""
    return fm.formed_with(_records(spark, sf), "key")


@query("frm_14_archive", f"""WITH {_E} SELECT concat('m', t.event_id) AS id, CASE WHEN t.run_id LIKE '%3' OR EXISTS (SELECT 1 FROM ev s WHERE s.reply_to = t.event_id AND s.seq % 3 = 0) THEN 'ARCHIVED' ELSE 'ACTIVE' END AS status FROM ev t""")
def frm_14(spark, sf):
    """Temporaries that were superseded or whose episode closed."""
    m = _memories(spark, sf)
    t = m.select(F.col("key").alias("id"), F.lit("s").alias("scope"), F.col("run_id").alias("episode"), F.lit("ACTIVE").alias("status"))
    closed = t.where("episode LIKE '%3'").select("scope", "episode").distinct()
    return fm.archive_superseded(t, m, closed).select("id", "status")


@query("frm_15_mint", f"WITH {_E}, k AS (SELECT run_id, concat('m', event_id) AS key FROM ev) SELECT run_id, key, {_MINT} AS node_id FROM k")
def frm_15(spark, sf):
    """Minted node ids."""
    return _memories(spark, sf).select("run_id", "key", fm.mint_node(F.col("run_id"), F.col("key")).alias("node_id"))


def _entities(spark, sf):
    e = _events(spark, sf).select("run_id", F.concat(F.lit("p"), "speaker").alias("key"), F.lit("PERSON").alias("type"), F.col("speaker").alias("label")).distinct()
    return e.withColumn("node_id", fm.mint_node(F.col("run_id"), F.col("key")))


@query("frm_16_nodes", f"""WITH {_E}, ent AS (SELECT DISTINCT run_id, concat('p', speaker) AS key, speaker FROM ev), mem AS (SELECT run_id, concat('m', event_id) AS key, concat('p', speaker) AS subject, text FROM ev)
    SELECT {_MINT} AS id, 'PERSON' AS type, CAST(NULL AS VARCHAR) AS subject, speaker AS label FROM ent
    UNION ALL SELECT {_MINT}, 'MEMORY', {_MINT.replace('key', 'subject')}, text FROM mem""")
def frm_16(spark, sf):
    """Node rows of drafts: entities and memories."""
    memories = _events(spark, sf).select("run_id", F.concat(F.lit("m"), "event_id").alias("key"), F.lit("FACT").alias("kind"), "text", F.concat(F.lit("p"), "speaker").alias("subject"))
    return fm.build_nodes(_entities(spark, sf), memories, "TEMPORARY").select("id", "type", "subject", "label")


@query("frm_16_edges", f"WITH {_A} SELECT run_id, key, CASE WHEN s IS NULL OR s = 'node-' THEN source ELSE s END AS source, CASE WHEN t IS NULL OR t = 'node-' THEN target ELSE t END AS target FROM x", ())
def frm_16e(spark, sf):
    """Edges with their ends mapped to nodes."""
    return fm.build_edges(*_associations(spark, sf)).select("run_id", "key", "source", "target")


@query("frm_17_mentions", f"""WITH {_E}, c AS (SELECT run_id, concat('p', speaker) AS node_id, event_id, seq, speaker FROM ev UNION ALL SELECT a.run_id, concat('p', b.speaker), a.event_id, a.seq, a.speaker FROM ev a JOIN ev b ON b.event_id = a.reply_to)
    SELECT node_id, run_id, string_agg(DISTINCT concat(event_id, '|q', seq % 3), ',' ORDER BY concat(event_id, '|q', seq % 3)) AS evidence FROM c WHERE node_id LIKE 'puser%' AND concat('p', speaker) = node_id OR node_id NOT LIKE 'puser%' GROUP BY node_id, run_id""")
def frm_17(spark, sf):
    """Mentions: of bound speakers only what they wrote themselves."""
    e = _events(spark, sf)
    own = e.select("run_id", F.concat(F.lit("p"), "speaker").alias("node_id"), "event_id", F.concat(F.lit("q"), (F.col("seq") % 3).cast("string")).alias("quote"))
    to = e.select(F.col("event_id").alias("reply_to"), F.concat(F.lit("p"), "speaker").alias("node_id"))
    cited = e.select("run_id", "reply_to", "event_id", F.concat(F.lit("q"), (F.col("seq") % 3).cast("string")).alias("quote")).join(to, "reply_to").select("run_id", "node_id", "event_id", "quote")
    nodes = own.select("node_id").distinct().withColumn("speaker_id", F.when(F.col("node_id").startswith("puser"), F.substring("node_id", 2, 99)))
    return fm.build_mentions(own.unionByName(cited), e.select("event_id", "speaker"), nodes).select("node_id", "run_id", F.array_join("evidence", ",").alias("evidence"))


@query("frm_18_supersede", f"WITH {_E} SELECT concat('m', t.event_id) AS id, CASE WHEN EXISTS (SELECT 1 FROM ev s WHERE s.reply_to = t.event_id AND s.seq % 3 = 0) THEN 'SUPERSEDED' ELSE 'CURRENT' END AS status FROM ev t")
def frm_18(spark, sf):
    """Nodes marked superseded."""
    m = _memories(spark, sf).withColumn("node_id", F.col("key"))
    return fm.apply_supersedes(m.select(F.col("key").alias("id"), F.lit("CURRENT").alias("status")), m)[0].select("id", "status")


@query("frm_19_processed", "SELECT scope, id, seq % 4 = 0 OR seq % 6 = 0 AS processed FROM f_msg")
def frm_19(spark, sf):
    """Events marked processed."""
    m = view(spark, sf, "f_msg").withColumn("processed", F.col("seq") % 4 == 0)
    return fm.mark_processed(m, m.where("seq % 6 = 0").select("scope", F.col("id").alias("event_id"))).select("scope", "id", "processed")


def _final(spark, sf):
    o = view(spark, sf, "orders").select(F.concat(F.lit("r"), (F.col("o_custkey") % 40).cast("string")).alias("run_id"), F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderkey").alias("k"))
    kind = F.when(F.col("k") % 5 == 0, "conflict").otherwise("event")
    action = F.when(F.col("k") % 3 == 0, "USED").when(F.col("k") % 5 == 0, F.when(F.col("k") % 2 == 0, "RETAIN_UNRESOLVED").otherwise("ARCHIVE")).otherwise("ARCHIVE")
    empty = F.array().cast("array<string>")
    memories = o.where("k % 4 <> 0").select("run_id", F.when(F.col("k") % 3 == 0, F.array("id")).otherwise(empty).alias("used"), F.when(F.col("k") % 35 == 0, F.array("id")).otherwise(empty).alias("supersedes"))
    return o.where("k % 11 <> 0").select("run_id", "id", action.alias("action")), o.where("k % 17 <> 0").select("run_id", "id", kind.alias("kind")), memories


@query("frm_20_final_decisions", """WITH o AS (SELECT concat('r', o_custkey % 40) AS run_id, CAST(o_orderkey AS VARCHAR) AS key, o_orderkey AS k FROM orders)
    SELECT run_id, CASE WHEN k % 17 = 0 THEN 'foreign' WHEN k % 11 = 0 THEN 'undecided' WHEN (k % 3 = 0) <> (k % 3 = 0 AND k % 4 <> 0) THEN 'used_mismatch' ELSE 'unresolved' END AS rule, key FROM o
    WHERE (k % 17 = 0 AND k % 11 <> 0) OR (k % 17 <> 0 AND (k % 11 = 0 OR (k % 3 = 0 AND k % 4 = 0) OR (k % 5 = 0 AND k % 3 <> 0 AND k % 2 <> 0)))
    UNION ALL SELECT run_id, 'supersedes_temporary', key FROM o WHERE k % 4 <> 0 AND k % 35 = 0 AND k % 17 <> 0""", ())
def frm_20(spark, sf):
    """Final decisions that do not cover or fit the temporaries."""
    return fm.final_decision_errors(*_final(spark, sf))


@query("frm_21_stage", """SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'UNRESOLVED' ELSE 'LONG_TERM' END AS stage FROM orders WHERE o_orderkey % 17 <> 0""", ())
def frm_21(spark, sf):
    """The stage of final records by their kind."""
    return _final(spark, sf)[1].select("id", fm.final_stage(F.col("kind")).alias("stage"))


@query("frm_22_packets", """WITH e AS (SELECT *, seq % 2 = 0 AS processed, min(seq) FILTER (seq % 2 = 1) OVER (PARTITION BY scope, episode) AS first FROM f_msg),
    p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scope, episode ORDER BY seq) AS r FROM e WHERE NOT processed) WHERE r <= 2),
    c0 AS (SELECT scope, episode, id, seq, speaker FROM (SELECT *, row_number() OVER (PARTITION BY scope, episode ORDER BY seq DESC) AS r FROM e WHERE processed) WHERE r <= 2
      UNION SELECT f.scope, f.episode, x.id, x.seq, x.speaker FROM (SELECT DISTINCT scope, episode, min(seq) OVER (PARTITION BY scope, episode) AS s, first FROM e) f JOIN e x ON x.scope = f.scope AND x.seq = f.s - 2 AND x.processed AND x.seq < f.first),
    c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scope, episode ORDER BY seq DESC) AS r FROM c0) WHERE r <= 2),
    ho AS (SELECT DISTINCT scope, episode, speaker FROM (SELECT scope, episode, speaker FROM p UNION ALL SELECT scope, episode, speaker FROM c)),
    nd AS (SELECT scope, episode, concat('n', id) AS id, seq FROM e WHERE seq % 3 <> 0 UNION SELECT h.scope, h.episode, concat('p', h.speaker), 0 FROM ho h WHERE h.speaker LIKE 'user%' OR EXISTS (SELECT 1 FROM e WHERE e.scope = h.scope AND e.episode = h.episode AND e.speaker = h.speaker AND e.turn = 0)),
    ed AS (SELECT a.scope, a.episode, concat(x.id, '>', x.reply_to) AS id FROM e x JOIN nd a ON a.scope = x.scope AND a.id = concat('n', x.id) JOIN nd b ON b.scope = a.scope AND b.episode = a.episode AND b.id = concat('n', x.reply_to))
    SELECT scope, episode, string_agg(id, ',' ORDER BY seq) AS pending_ids, coalesce((SELECT string_agg(id, ',' ORDER BY seq) FROM c WHERE c.scope = p.scope AND c.episode = p.episode), '') AS context_ids,
    coalesce((SELECT string_agg(id, ',' ORDER BY seq, id) FROM nd WHERE nd.scope = p.scope AND nd.episode = p.episode), '') AS node_ids, coalesce((SELECT string_agg(id, ',' ORDER BY id) FROM ed WHERE ed.scope = p.scope AND ed.episode = p.episode), '') AS edge_ids FROM p GROUP BY scope, episode""")
def frm_22(spark, sf):
    """Input packets of the episodes with pending events, with asked context, identities and edges."""
    m = view(spark, sf, "f_msg").withColumn("processed", F.col("seq") % 2 == 0)
    own = m.select("scope", "episode", "seq", F.concat(F.lit("n"), "id").alias("id"), F.when(F.col("seq") % 3 == 0, "SUPERSEDED").otherwise("CURRENT").alias("status"), F.lit("TEMPORARY").alias("stage"), F.lit(None).cast("string").alias("speaker_id"))
    known = F.col("speaker").startswith("user")
    people = m.where(known | (F.col("turn") == 0)).select("scope", F.when(known, "").otherwise(F.col("episode")).alias("episode"), F.lit(0).cast(own.schema["seq"].dataType).alias("seq"), F.concat(F.lit("p"), "speaker").alias("id"), F.lit("PAST").alias("status"), F.when(known, "LONG_TERM").otherwise("TEMPORARY").alias("stage"), F.col("speaker").alias("speaker_id")).distinct()
    edges = m.where("reply_to IS NOT NULL").select("scope", F.concat("id", F.lit(">"), "reply_to").alias("id"), F.concat(F.lit("n"), "id").alias("source"), F.concat(F.lit("n"), "reply_to").alias("target"))
    before = m.groupBy("scope", "episode").agg((F.min("seq") - 2).alias("seq")).join(m.where("processed").select("scope", "seq", "id"), ["scope", "seq"]).select("scope", "episode", "id")
    return fm.formation_packets(m, own.unionByName(people), edges, before, 2, 2).select("scope", "episode", *[F.array_join(c, ",").alias(c) for c in ("pending_ids", "context_ids", "node_ids", "edge_ids")])


def _consolidation(spark, sf):
    o = view(spark, sf, "orders").select(F.concat(F.lit("r"), (F.col("o_custkey") % 40).cast("string")).alias("run_id"), F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderkey").alias("k"))
    merge = F.col("k") % 3 == 0
    targets = F.when(merge & (F.col("k") % 7 != 0), F.array(F.concat(F.lit("m"), "id"))).when(~merge & (F.col("k") % 13 == 0), F.array(F.lit("m0"))).otherwise(F.array().cast("array<string>"))
    decisions = o.where("k % 11 <> 0").select("run_id", "id", F.when(merge, "MERGE").when(F.col("k") % 3 == 1, "KEEP").otherwise("ARCHIVE").alias("action"), targets.alias("targets"))
    memories = o.where("k % 3 = 0 AND k % 5 <> 0").select("run_id", F.concat(F.lit("m"), "id").alias("key"), F.array("id").alias("used"))
    return decisions, o.select("run_id", "id"), memories


@query("frm_23_consolidation", """WITH o AS (SELECT concat('r', o_custkey % 40) AS run_id, CAST(o_orderkey AS VARCHAR) AS id, o_orderkey AS k FROM orders)
    SELECT run_id, 'undecided' AS rule, id AS key FROM o WHERE k % 11 = 0
    UNION ALL SELECT run_id, 'targets', id FROM o WHERE k % 11 <> 0 AND ((k % 3 = 0 AND k % 7 = 0) OR (k % 3 <> 0 AND k % 13 = 0))
    UNION ALL SELECT run_id, 'use_without_merge', concat('m', id) FROM o WHERE k % 3 = 0 AND k % 5 <> 0 AND (k % 11 = 0 OR k % 7 = 0)
    UNION ALL SELECT run_id, 'merge_without_use', id FROM o WHERE k % 11 <> 0 AND k % 3 = 0 AND k % 7 <> 0 AND k % 5 = 0""", ())
def frm_23(spark, sf):
    """Consolidation decisions that do not fit the new memories."""
    return fm.consolidation_errors(*_consolidation(spark, sf))


def _stored(spark, sf):
    o = view(spark, sf, "orders")
    return o.select(F.lit("s").alias("scope"), F.concat(F.lit("e"), (F.col("o_custkey") % 200).cast("string")).alias("episode"), F.col("o_orderkey").cast("string").alias("id"), F.lit("TEMPORARY").alias("stage"), F.when(F.col("o_orderkey") % 19 == 0, "SUPERSEDED").otherwise("CURRENT").alias("status"))


_ACT = "CASE WHEN k % 11 = 0 THEN NULL WHEN k % 3 = 0 THEN 'MERGE' WHEN k % 3 = 1 THEN 'KEEP' ELSE 'ARCHIVE' END"


@query("frm_24_apply", f"""SELECT CAST(k AS VARCHAR) AS id, CASE WHEN a = 'KEEP' THEN 'LONG_TERM' WHEN a IN ('MERGE', 'ARCHIVE') THEN 'ARCHIVED' WHEN k % 19 = 0 THEN 'ARCHIVED' ELSE 'TEMPORARY' END AS stage,
    CASE WHEN a = 'MERGE' THEN 'CONSOLIDATED' WHEN k % 19 = 0 THEN 'SUPERSEDED' ELSE 'CURRENT' END AS status FROM (SELECT o_orderkey AS k, {_ACT.replace('k %', 'o_orderkey %')} AS a FROM orders)""", ())
def frm_24(spark, sf):
    """Stages and states after consolidation."""
    return fm.apply_consolidation(_stored(spark, sf), _consolidation(spark, sf)[0])[0].select("id", "stage", "status")


@query("frm_25_closure", f"""WITH {_E}, ids AS (SELECT concat('m', event_id) AS id FROM ev WHERE seq % 5 = 0 UNION SELECT concat('p', speaker) FROM ev WHERE seq % 4 = 0 UNION SELECT concat('m', event_id) FROM ev WHERE seq % 6 = 0 AND reply_to IS NOT NULL UNION SELECT concat('m', reply_to) FROM ev WHERE seq % 6 = 0 AND reply_to IS NOT NULL)
    SELECT id FROM ids UNION SELECT concat('p', speaker) FROM ev WHERE concat('m', event_id) IN (SELECT id FROM ids)""")
def frm_25(spark, sf):
    """Everything that a promotion takes along."""
    e = _events(spark, sf)
    nodes = e.select(F.concat(F.lit("m"), "event_id").alias("id"), F.concat(F.lit("p"), "speaker").alias("subject"), "seq")
    edges = e.where("seq % 6 = 0 AND reply_to IS NOT NULL").select(F.concat(F.lit("m"), "event_id").alias("source"), F.concat(F.lit("m"), "reply_to").alias("target"))
    return fm.promotion_closure(nodes.where("seq % 5 = 0"), nodes.where("seq % 4 = 0"), edges, nodes)


@query("frm_26_publish", """SELECT DISTINCT id AS edge_id, concat('w', CAST(substr(source, 2) AS INT) % 5) AS write_id FROM f_edge WHERE strength > 0.5""", ("f_edge",))
def frm_26(spark, sf):
    """Retained edges that are published."""
    e = view(spark, sf, "f_edge")
    retained = e.where("strength > 0.5").select(F.concat(F.lit("w"), (F.substring("source", 2, 9).cast("int") % 5).cast("string")).alias("write_id"), F.array("id", F.concat(F.lit("gone-"), "id")).alias("edge_ids"))
    return fm.published_edges(retained, e)


@query("frm_27_spans", """SELECT concat('m', id) AS key, id AS event_id, instr(text, substr(text, 3, 20)) - 1 AS "start", instr(text, substr(text, 3, 20)) - 1 + length(substr(text, 3, 20)) AS "end" FROM f_msg WHERE seq % 5 <> 0 AND length(text) > 3""")
def frm_27(spark, sf):
    """Quotes as half-open character ranges."""
    m = view(spark, sf, "f_msg").where("length(text) > 3")
    evidence = m.where("seq % 5 <> 0").select(F.concat(F.lit("m"), "id").alias("key"), F.col("id").alias("event_id"), F.substring("text", 3, 20).alias("quote"))
    return fm.span_references(evidence, m).select("key", "event_id", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"))


@query("frm_28_selective", f"""WITH {_E}, chosen AS (SELECT * FROM ev WHERE seq % 9 = 0), sub AS (SELECT DISTINCT concat('p', speaker) AS id FROM chosen),
    edge AS (SELECT DISTINCT concat('p', a.speaker) AS x, concat('p', b.speaker) AS y FROM ev a JOIN ev b ON b.event_id = a.reply_to), both_ AS (SELECT x, y FROM edge UNION SELECT y, x FROM edge)
    SELECT concat('m', event_id) AS id, 'temporary' AS role FROM chosen UNION ALL SELECT id, 'subject' FROM sub
    UNION ALL SELECT DISTINCT y, 'bridge' FROM both_ WHERE x IN (SELECT id FROM sub) AND y NOT IN (SELECT id FROM sub) UNION ALL SELECT event_id, 'event' FROM chosen
    UNION ALL SELECT DISTINCT id, 'context' FROM (SELECT reply_to AS id FROM chosen WHERE reply_to IS NOT NULL UNION ALL SELECT event_id FROM ev WHERE seq % 50 = 0 AND concat('p', speaker) IN (SELECT id FROM sub UNION ALL SELECT y FROM both_ WHERE x IN (SELECT id FROM sub))) WHERE id IN (SELECT event_id FROM ev) AND id NOT IN (SELECT event_id FROM chosen)""")
def frm_28(spark, sf):
    """Chosen temporaries with their subjects, bridges, cited events, and these events' context."""
    e = _events(spark, sf)
    nodes = e.select(F.concat(F.lit("m"), "event_id").alias("id"), F.lit("MEMORY").alias("type"), F.concat(F.lit("p"), "speaker").alias("subject"), "seq")
    people = e.select(F.concat(F.lit("p"), "speaker").alias("id"), F.lit("PERSON").alias("type"), F.lit(None).cast("string").alias("subject"), F.lit(0).cast("bigint").alias("seq")).distinct()
    to = e.select(F.col("event_id").alias("reply_to"), F.concat(F.lit("p"), "speaker").alias("target"))
    edges = e.join(to, "reply_to").select(F.concat(F.lit("p"), "speaker").alias("source"), "target").distinct()
    evidence = e.select(F.concat(F.lit("m"), "event_id").alias("key"), "event_id").unionByName(e.where("seq % 50 = 0").select(F.concat(F.lit("p"), "speaker").alias("key"), "event_id"))
    return fm.selective_context(nodes.where("seq % 9 = 0"), nodes.unionByName(people), edges, evidence, e.select(F.col("event_id").alias("id"), "reply_to"))


@query("frm_29_versions", "SELECT scope, id, CASE WHEN seq % 8 = 0 THEN 'gone' ELSE 'changed' END AS change FROM f_msg WHERE seq % 8 = 0 OR (seq % 10 = 0 AND seq % 8 <> 0)")
def frm_29(spark, sf):
    """Inputs that changed or went since they were read."""
    m = view(spark, sf, "f_msg").select("scope", "id", "text", "reply_to", "seq")
    now = m.where("seq % 8 <> 0").withColumn("text", F.when(F.col("seq") % 10 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return fm.changed_sources(m, now, ["scope", "id"], ["text", "reply_to"])


@query("frm_30_close", """WITH g AS (SELECT scope, episode, min(conv_id) % 4 AS k, count(*) FILTER (seq % 7 = 0) AS busy FROM f_msg GROUP BY scope, episode)
    SELECT scope, episode, CASE k WHEN 0 THEN 'CLOSED' WHEN 1 THEN 'OPEN' ELSE 'CONSOLIDATED' END AS episode_status, 'closed' AS outcome FROM g WHERE (k < 2 AND busy = 0 AND k = 0) OR k = 2
    UNION ALL SELECT scope, episode, 'OPEN', 'reopened' FROM g WHERE k IN (1, 3) AND (k = 3 OR busy = 0) UNION ALL SELECT scope, episode, 'OPEN', 'refused' FROM g WHERE k < 2 AND busy > 0""")
def frm_30(spark, sf):
    """Episodes without unprocessed events are closed or sealed; what is sealed can be reopened."""
    m = view(spark, sf, "f_msg").withColumn("processed", F.col("seq") % 7 != 0)
    k = F.min("conv_id") % 4
    status = F.when(k < 2, "OPEN").when(k == 2, "CONSOLIDATED").otherwise("SEALED")
    episodes = m.groupBy("scope", "episode").agg(F.when(k % 2 == 0, "legacy").otherwise("consolidate").alias("lifecycle"), status.alias("episode_status"))
    done, refused, _ = fm.close_episodes(episodes, m, m)
    reopened, closed = fm.reopen_episodes(done)
    parts = ((closed, "closed"), (reopened, "reopened"), (refused, "refused"))
    out = [df.select("scope", "episode", "episode_status", F.lit(name).alias("outcome")) for df, name in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("frm_31_identities", "SELECT scope, speaker AS speaker_id, count(*) AS n FROM f_msg WHERE seq % 3 = 0 GROUP BY ALL HAVING count(*) > 1")
def frm_31(spark, sf):
    """Speakers that more than one node claims."""
    return fm.repeated_identities(view(spark, sf, "f_msg").where("seq % 3 = 0").select("scope", F.col("speaker").alias("speaker_id"), "id"))
