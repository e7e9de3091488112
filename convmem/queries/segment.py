"""Queries of segmentation, the current state, and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window, functions as F

from convmem.fixtures import sql_with, view
from convmem.functions import hooks
from convmem.functions.text import bigrams, clean_text
from convmem.operators import context, fifo, intake, segment
from convmem.plans.scratch import scratch, shared_dir
from convmem.streaming import dedup, jobs, topics

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ("f_msg",)):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql_with(sql, *views)
        return f

    return register


def _msg(spark, sf) -> DataFrame:
    return view(spark, sf, "f_msg")


@query("seg_1_clean", r"""SELECT id, lower(regexp_replace(regexp_replace(regexp_replace(x, '\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '\[UNKNOWN_\d+消息\]', '', 'g'), '\[回复 [^:\n]*:', '[引用:', 'g')) AS clean
    FROM (SELECT id, concat('[Link ', seq, '](http://x/', seq, ') [UNKNOWN_', seq, '消息][回复 ', speaker, ': ', substr(text, 1, 40)) AS x FROM f_msg)""")
def seg_1(spark, sf):
    """Router text cleanup."""
    x = F.concat(F.lit("[Link "), F.col("seq").cast("string"), F.lit("](http://x/"), F.col("seq").cast("string"), F.lit(") [UNKNOWN_"), F.col("seq").cast("string"), F.lit("消息][回复 "), "speaker", F.lit(": "), F.substring("text", 1, 40))
    return _msg(spark, sf).select("id", clean_text(x, forwarded=True).alias("clean"))


_BIGRAMS = "list_distinct(list_filter(list_transform(range(1, length({0})), lambda i: substr({0}, i, 2)), lambda g: trim(g, ' ') <> ''))"


@query("seg_2_bigrams", f"SELECT id, len({_BIGRAMS.format('lower(text)')}) AS n FROM f_msg")
def seg_2(spark, sf):
    """How many distinct bigrams each message has."""
    return _msg(spark, sf).select("id", F.size(bigrams(clean_text(F.col("text")))).cast("bigint").alias("n"))


_VIEWS = "views AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scope, episode ORDER BY seq) AS a, row_number() OVER (PARTITION BY scope, episode ORDER BY seq DESC) AS z FROM f_msg) WHERE a = 1 OR z <= 3)"


@query("seg_3_views", f"WITH {_VIEWS} SELECT scope, episode, id FROM views")
def seg_3(spark, sf):
    """First and last three messages of each episode."""
    return segment.episode_views(_msg(spark, sf)).select("scope", "episode", "id")


_IDF = f"""{_VIEWS}, gr AS (SELECT DISTINCT scope, episode, unnest({_BIGRAMS.format('lower(text)')}) AS gram FROM views), nn AS (SELECT scope, count(DISTINCT episode) AS n FROM views GROUP BY scope),
    idf AS (SELECT gr.scope, gram, count(*) AS df, ln(1 + min(n) / (1 + count(*))) AS weight FROM gr JOIN nn ON nn.scope = gr.scope GROUP BY gr.scope, gram)"""


@query("seg_4_idf", f"WITH {_IDF} SELECT scope, gram, df, round(weight, 8) AS weight FROM idf")
def seg_4(spark, sf):
    """Bigram weights of each scope."""
    return segment.gram_weights(segment.episode_views(_msg(spark, sf))).select("scope", "gram", "df", F.round("weight", 8).alias("weight"))


#: Longer limits than the defaults, so that topics of several conversations are open at a time.
TTL, SPAN, MOST = 100_000, 200_000, 24
_SCORES = f"""pm AS (SELECT tg.scope, tg.id AS target, tg.seq AS tseq, tg.t AS tt, tg.speaker AS who, tg.reply_to AS rep, m.episode, m.seq, m.id, m.t, m.speaker, m.text,
        row_number() OVER (PARTITION BY tg.id, m.episode ORDER BY m.seq) AS a, row_number() OVER (PARTITION BY tg.id, m.episode ORDER BY m.seq DESC) AS z FROM f_msg tg JOIN f_msg m ON m.scope = tg.scope AND m.seq < tg.seq),
    ep AS (SELECT scope, target, episode, max(seq) AS last_seq, bool_or(id = rep) AS replied, bool_or(speaker = who AND (a = 1 OR z <= 3)) AS author FROM pm GROUP BY ALL HAVING min(tt) - max(t) < {TTL} AND min(tt) - min(t) < {SPAN} AND count(*) < {MOST}),
    nn AS (SELECT target, count(*) AS n FROM ep GROUP BY target), q AS (SELECT id AS target, unnest({_BIGRAMS.format('lower(text)')}) AS gram FROM f_msg),
    vg AS (SELECT pm.target, pm.episode, pm.seq, unnest({_BIGRAMS.format('lower(pm.text)')}) AS gram FROM pm JOIN ep ON ep.target = pm.target AND ep.episode = pm.episode WHERE a = 1 OR z <= 3),
    fr AS (SELECT target, gram, count(DISTINCT episode) AS df FROM vg GROUP BY ALL), wt AS (SELECT q.target, q.gram, ln(1 + n / (1 + coalesce(df, 0))) AS weight FROM q JOIN nn ON nn.target = q.target LEFT JOIN fr ON fr.target = q.target AND fr.gram = q.gram),
    tot AS (SELECT target, sum(weight) AS total FROM wt GROUP BY target), pv AS (SELECT target, episode, max(s) AS s FROM (SELECT vg.target, vg.episode, vg.seq, sum(weight) AS s FROM vg JOIN wt ON wt.target = vg.target AND wt.gram = vg.gram GROUP BY ALL) GROUP BY ALL),
    scores AS (SELECT ep.scope, ep.target, ep.episode, coalesce(s / total, 0) + CASE WHEN author THEN 0.08 ELSE 0 END + CASE WHEN replied THEN 1000 ELSE 0 END AS score, last_seq FROM ep LEFT JOIN pv ON pv.target = ep.target AND pv.episode = ep.episode LEFT JOIN tot ON tot.target = ep.target)"""


def _scores(spark, sf):
    m = _msg(spark, sf)
    return segment.topic_scores(m, m, TTL, SPAN, MOST)


@query("seg_5_scores", f"WITH {_SCORES} SELECT scope, target, episode, round(score, 6) AS score, last_seq FROM scores")
def seg_5(spark, sf):
    """Scores of every message against the topics that are open just before it."""
    return _scores(spark, sf).select("scope", "target", "episode", F.round("score", 6).alias("score"), "last_seq")


_CAND = f"""{_SCORES}, rk AS (SELECT *, row_number() OVER (PARTITION BY scope, target ORDER BY round(score, 12) DESC, last_seq DESC, episode DESC) AS s, row_number() OVER (PARTITION BY scope, target ORDER BY last_seq DESC, episode DESC) AS t FROM scores),
    cand AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY scope, target ORDER BY CASE WHEN s <= 3 THEN 1 WHEN t <= 2 THEN 2 ELSE 3 END, CASE WHEN s > 3 AND t <= 2 THEN t ELSE s END) AS INTEGER) AS position FROM rk) WHERE position <= 4)"""


def _candidates(spark, sf):
    """Half the default numbers, so that some topics are left out."""
    return segment.choose_candidates(_scores(spark, sf), 3, 2, 4)


@query("seg_6_candidates", f"WITH {_CAND} SELECT scope, target, episode, position FROM cand")
def seg_6(spark, sf):
    """The candidates that a router sees."""
    return _candidates(spark, sf).select("scope", "target", "episode", "position")


@query("seg_7_packets", """WITH p AS (SELECT *, row_number() OVER (PARTITION BY scope, episode ORDER BY seq) AS a, row_number() OVER (PARTITION BY scope, episode ORDER BY seq DESC) AS z FROM f_msg)
    SELECT scope, episode, string_agg(id, ',' ORDER BY seq) AS member_ids, max(id) FILTER (a = 1) AS first_id, string_agg(id, ',' ORDER BY seq) FILTER (z <= 2) AS recent_ids, string_agg(left(lower(text), 40), ' ; ' ORDER BY seq) FILTER (z <= 2) AS summary FROM p GROUP BY scope, episode""")
def seg_7(spark, sf):
    """Candidate packets of all episodes."""
    m = _msg(spark, sf)
    p = segment.candidate_packets(m, m)
    return p.select("scope", "episode", F.array_join("member_ids", ",").alias("member_ids"), "first_id", F.array_join("recent_ids", ",").alias("recent_ids"), "summary")


@query("seg_8_packet_audit", """WITH p AS (SELECT a.id AS target, a.t AS target_t, a.seq AS target_seq, b.id, b.t, b.seq, b.text, CASE WHEN b.seq % 5 = 0 THEN 'other' ELSE 'this' END AS conversation FROM f_msg a JOIN f_msg b ON b.scope = a.scope AND b.seq BETWEEN a.seq - CASE WHEN a.seq % 4 = 0 THEN 9 ELSE 5 END AND a.seq - CASE WHEN a.seq % 6 = 0 THEN 0 ELSE 1 END)
    SELECT target, array_to_string(list_filter([CASE WHEN count(DISTINCT id) > 8 THEN 'history_size' END, CASE WHEN bool_or(id = target) THEN 'target_in_packet' END, CASE WHEN bool_or(t > target_t) THEN 'future' END, CASE WHEN bool_or(seq >= target_seq) THEN 'sequence' END, CASE WHEN bool_or(conversation <> 'this') THEN 'conversation' END], lambda x: x IS NOT NULL), ',') AS violations FROM p GROUP BY target""")
def seg_8(spark, sf):
    """Packets that break the router's protocol."""
    m = _msg(spark, sf)
    first = F.col("seq") - F.when(F.col("seq") % 4 == 0, 9).otherwise(5)
    last = F.col("seq") - F.when(F.col("seq") % 6 == 0, 0).otherwise(1)
    a = m.select("scope", F.col("id").alias("target"), F.col("t").alias("target_t"), F.col("seq").alias("target_seq"), F.explode(F.sequence(first, last)).alias("seq"))
    p = a.join(m.select("scope", "seq", "id", "t", "text"), ["scope", "seq"])
    p = p.select("target", F.lit("this").alias("target_conversation"), "target_t", "target_seq", F.lit("history").alias("part"), F.lit(None).cast("int").alias("candidate"), "id", F.when(F.col("seq") % 5 == 0, "other").otherwise("this").alias("conversation"), "t", "seq", "text", F.lit(True).alias("member"))
    return segment.packet_violations(p).select("target", F.array_join("violations", ",").alias("violations"))


_SAID = "concat('P', k, ': ', {0})"
_FEATURES = f"""WITH {_CAND}, cm AS (SELECT pm.*, c.position FROM pm JOIN cand c ON c.target = pm.target AND c.episode = pm.episode),
    ctx AS (SELECT target, seq, id, speaker, text FROM pm WHERE tseq - seq <= 8 AND target IN (SELECT target FROM cand)),
    seen AS (SELECT target, seq AS pos, 0 AS part, id, speaker, text FROM ctx UNION ALL SELECT target, position * 10, 1, id, speaker, text FROM cm WHERE a = 1 UNION ALL SELECT target, position * 10 + 3 - z, 1, id, speaker, text FROM cm WHERE z <= 2
        UNION ALL SELECT id, 0, 2, NULL, speaker, NULL FROM f_msg WHERE id IN (SELECT target FROM cand)),
    al AS (SELECT target, speaker, row_number() OVER (PARTITION BY target ORDER BY min(row(part, pos))) AS k FROM seen GROUP BY target, speaker),
    ln AS (SELECT c.target, string_agg({_SAID.format('text')}, chr(10) ORDER BY seq) AS lines FROM ctx c JOIN al ON al.target = c.target AND al.speaker = c.speaker GROUP BY c.target),
    sn AS (SELECT c.target, position, string_agg({_SAID.format('left(text, 40)')}, ' ; ' ORDER BY seq) AS shown FROM cm c JOIN al ON al.target = c.target AND al.speaker = c.speaker WHERE z <= 2 GROUP BY ALL),
    tp AS (SELECT c.target, c.position, concat(CASE WHEN replied THEN '{segment.REPLY_TAG}' ELSE '' END, ': ', shown) AS x FROM cand c JOIN ep ON ep.target = c.target AND ep.episode = c.episode JOIN sn ON sn.target = c.target AND sn.position = c.position),
    tl AS (SELECT target, string_agg(concat('{segment.TOPIC_LINE}', position, x), chr(10) ORDER BY position) AS topics, string_agg(concat('{segment.TOPIC_CHOICE}', x), '|' ORDER BY position) AS choices FROM tp GROUP BY target),
    rp AS (SELECT DISTINCT s.target, concat('{segment.REPLY_HEAD.strip()} ', {_SAID.format('left(s.text, 80)')}) AS quoted FROM seen s JOIN f_msg m ON m.id = s.target AND s.id = m.reply_to JOIN al ON al.target = s.target AND al.speaker = s.speaker),
    tg AS (SELECT m.id AS target, concat(CASE WHEN reply_to IS NULL THEN '' ELSE concat(chr(10), coalesce(quoted, '{segment.REPLY_MISSING.strip()}')) END, chr(10), '{segment.TARGET_HEAD.strip()} ', {_SAID.format('text')}) AS x FROM f_msg m JOIN al ON al.target = m.id AND al.speaker = m.speaker LEFT JOIN rp ON rp.target = m.id)
    SELECT tl.target, concat('{segment.CONTEXT_HEAD.strip()}', chr(10), lines, chr(10), '{segment.TOPICS_HEAD.strip()}', chr(10), topics, tg.x) AS boundary_state, concat('{segment.CONTEXT_HEAD.strip()}', chr(10), lines, tg.x) AS ranking_state, choices
    FROM tl JOIN tg ON tg.target = tl.target JOIN ln ON ln.target = tl.target"""


def _features(spark, sf):
    m = _msg(spark, sf)
    said = F.struct("id", "speaker", F.substring("text", 1, segment.QUOTE).alias("text"))
    ahead = m.select("scope", "seq", F.struct("id", "speaker", "text").alias("m"))
    lines = m.select("scope", F.col("id").alias("target"), F.explode(F.sequence(F.col("seq") - 8, F.col("seq") - 1)).alias("seq")).join(ahead, ["scope", "seq"]).select("target", F.col("seq").alias("pos"), "m.id", "m.speaker", "m.text")
    own = Window.partitionBy("scope", "episode").orderBy("seq")
    state = m.select("scope", "episode", F.col("seq").alias("last_seq"), F.collect_list("id").over(own).alias("member_ids"), F.array(F.first(said).over(own)).alias("first"), F.array_compact(F.array(F.lag(said).over(own), said)).alias("recent"))
    candidates = _candidates(spark, sf).join(state, ["scope", "episode", "last_seq"])
    return segment.router_features(m.select(F.col("id").alias("target"), "speaker", "text", "reply_to"), lines, candidates)


@query("seg_9_features", _FEATURES)
def seg_9(spark, sf):
    """What a router reads of each message that has candidates."""
    return _features(spark, sf).select("target", "boundary_state", "ranking_state", F.array_join("choices", "|").alias("choices"))


_DECIDE = f"""{_CAND}, best AS (SELECT scope, target, max(score) AS top, count(*) AS n FROM cand GROUP BY ALL), pick AS (SELECT c.scope, c.target, arg_min(c.episode, c.position) AS episode, min(b.top) AS top FROM cand c JOIN best b ON b.target = c.target AND b.scope = c.scope AND round(c.score, 12) = round(b.top, 12) GROUP BY ALL),
    dec AS (SELECT target, CASE WHEN 1 / (1 + exp((top - 0.5) * 8)) >= 0.5 THEN 'NEW' ELSE 'CONTINUE' END AS decision, CASE WHEN NOT 1 / (1 + exp((top - 0.5) * 8)) >= 0.5 THEN episode END AS episode FROM pick)"""


def _decisions(spark, sf):
    """Decisions and candidates; the candidates are written, as they are read two or three times."""
    c = _candidates(spark, sf).select("target", "episode", "position", F.round("score", 12).alias("score"))
    c = scratch(c, "seg-candidates")
    return segment.decide(hooks.route_scores(c), c), c


@query("seg_10_decide", f"WITH {_DECIDE} SELECT * FROM dec")
def seg_10(spark, sf):
    """New topic or which candidate, from scores."""
    return _decisions(spark, sf)[0]


@query("udf_3_route", f"WITH {_CAND} SELECT target, round(1 / (1 + exp((max(round(score, 12)) - 0.5) * 8)), 6) AS p_new, count(*) AS n_scores FROM cand GROUP BY target")
def udf_3(spark, sf):
    """What the default router says of each message: the chance of a new topic, and scores."""
    c = _candidates(spark, sf).withColumn("score", F.round("score", 12))
    return hooks.route_scores(c).select("target", F.round("p_new", 6).alias("p_new"), F.map_keys("scores").alias("_k")).select("target", "p_new", F.size("_k").cast("bigint").alias("n_scores"))


@query("seg_11_decision_check", f"WITH {_DECIDE} SELECT target, 'not_a_candidate' AS problem FROM dec WHERE decision = 'CONTINUE' AND target LIKE '%1'")
def seg_11(spark, sf):
    """Decisions for topics that were no candidates."""
    d, c = _decisions(spark, sf)
    wrong = d.withColumn("episode", F.when(F.col("target").endswith("1") & F.col("episode").isNotNull(), "elsewhere").otherwise(F.col("episode")))
    return segment.decision_errors(wrong, c)


@query("seg_12_assign")
def seg_12(spark, sf):
    """Topics assigned one message after the other within each stretch of a scope."""
    return segment.assign_topics(_msg(spark, sf), segment.default_route, 30_000, SPAN, MOST)


_LIFE = """RECURSIVE WITH w AS (SELECT scope, n, t AS f, t AS l, 1 AS k, 1 AS topic, CAST(NULL AS VARCHAR) AS why FROM f_life WHERE n = 1 UNION ALL
      SELECT o.scope, o.n, CASE WHEN z IS NOT NULL THEN o.t ELSE w.f END, o.t, CASE WHEN z IS NOT NULL THEN 1 ELSE w.k + 1 END, w.topic + CAST(z IS NOT NULL AS INT), z
      FROM w JOIN f_life o ON o.scope = w.scope AND o.n = w.n + 1, LATERAL (SELECT CASE WHEN o.t - w.l >= 60 THEN 'ttl' WHEN o.t - w.f >= 240 THEN 'span' WHEN w.k >= 6 THEN 'count' END AS z))"""


@query("seg_13_lifecycle", _LIFE + " SELECT scope, n, CAST(topic AS BIGINT) AS topic, why AS close_reason FROM w", ("f_life",))
def seg_13(spark, sf):
    """Topics closed by idle time, span and count."""
    return segment.lifecycle(view(spark, sf, "f_life"), 60, 240, 6).select("scope", "n", "topic", "close_reason")


@query("seg_14_due", """WITH g AS (SELECT scope, episode, min(t) AS first_t, max(t) AS last_t, count(*) AS n FROM f_msg GROUP BY ALL), now AS (SELECT (min(t) + max(t)) // 2 AS x FROM f_msg)
    SELECT scope, episode, first_t, last_t, n FROM g, now WHERE x >= last_t AND (x - last_t >= 900 OR x - first_t >= 3600 OR n >= 24) AND scope NOT IN ('g1', 'g2')""")
def seg_14(spark, sf):
    """Open topics that are due at a time."""
    m = _msg(spark, sf)
    r = m.agg(F.min("t"), F.max("t")).first()
    busy = m.where("scope IN ('g1', 'g2')")
    return segment.due_topics(m, (r[0] + r[1]) // 2, unfinished=busy)


@query("seg_15_journal", "SELECT scope, id FROM f_msg WHERE seq % 9 = 0 OR seq % 14 = 0")
def seg_15(spark, sf):
    """Journal rows that differ from the stored event."""
    m = _msg(spark, sf)
    journal = m.withColumn("text", F.when(F.col("seq") % 9 == 0, F.concat("text", F.lit("?"))).otherwise(F.col("text")))
    return segment.journal_mismatches(journal, m.where("seq % 14 <> 0"), ["speaker", "t", "text", "reply_to", "episode"])


_STATE = "st AS (SELECT episode AS qid, scope, turn AS pos, CASE WHEN conv_id % 6 = 0 THEN 'same' ELSE id END AS id, speaker, t - CASE WHEN turn = 1 AND conv_id % 5 = 0 THEN 900 ELSE 0 END AS t, text, CASE WHEN conv_id % 4 = 0 THEN 'nobody' WHEN conv_id % 4 = 1 THEN speaker END AS focus FROM f_msg WHERE conv_id % 3 = 0)"


def _state(spark, sf):
    m = _msg(spark, sf).where("conv_id % 3 = 0")
    focus = F.when(F.col("conv_id") % 4 == 0, "nobody").when(F.col("conv_id") % 4 == 1, F.col("speaker"))
    return m.select(F.col("episode").alias("qid"), "scope", F.col("turn").alias("pos"), F.when(F.col("conv_id") % 6 == 0, "same").otherwise(F.col("id")).alias("id"), "speaker", (F.col("t") - F.when((F.col("turn") == 1) & (F.col("conv_id") % 5 == 0), 900).otherwise(0)).alias("t"), "text", focus.alias("focus"))


@query("ctx_1_state", f"""WITH {_STATE}, b AS (SELECT *, coalesce(t < lag(t) OVER (PARTITION BY qid ORDER BY pos), false) AS back FROM st)
    SELECT qid, array_to_string(list_filter([CASE WHEN count(*) > 8 THEN 'count' END, CASE WHEN count(DISTINCT id) < count(*) THEN 'ids' END, CASE WHEN bool_or(back) THEN 'order' END, CASE WHEN max(length(text)) > 1200 THEN 'text' END, CASE WHEN sum(length(text)) > 2000 THEN 'total' END, CASE WHEN NOT bool_or(focus IS NULL OR speaker = focus) THEN 'focus' END], lambda x: x IS NOT NULL), ',') AS violations FROM b GROUP BY qid""")
def ctx_1(spark, sf):
    """Current states and the rules they break."""
    return context.state_violations(_state(spark, sf)).select("qid", F.array_join("violations", ",").alias("violations"))


@query("ctx_2_past_only", f"WITH {_STATE}, a AS (SELECT qid, scope, min(t) AS f FROM st GROUP BY ALL), z AS (SELECT scope, max(t) AS l FROM f_msg WHERE conv_id % 3 <> 0 GROUP BY scope) SELECT qid, coalesce(l < f, true) AS past_only FROM a LEFT JOIN z ON z.scope = a.scope")
def ctx_2(spark, sf):
    """Whether the log lies before the state."""
    return context.past_only(_state(spark, sf), _msg(spark, sf).where("conv_id % 3 <> 0"))


@query("ctx_3_cues", f"""WITH {_STATE}, l AS (SELECT qid, arg_max(text, pos) AS text, max(focus) AS focus FROM st GROUP BY qid)
    SELECT qid, CAST(1 AS INTEGER) AS cue, focus AS text, 0.35 AS weight FROM l WHERE focus IS NOT NULL UNION ALL SELECT qid, 2, text, 0.65 FROM l WHERE focus IS NOT NULL UNION ALL SELECT qid, 1, text, 1.0 FROM l WHERE focus IS NULL""")
def ctx_3(spark, sf):
    """Default cues of a state."""
    return context.default_cues(_state(spark, sf)).select("qid", "cue", "text", F.col("weight").cast("decimal(3,2)").alias("weight"))


@query("ctx_5_current", "SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 7 = o_custkey % 7", ())
def ctx_5(spark, sf):
    """Results whose scope has not moved on."""
    o = view(spark, sf, "orders")
    results = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("scope"), (F.col("o_orderkey") % 7).alias("revision"))
    scopes = o.select(F.col("o_custkey").alias("scope"), (F.col("o_custkey") % 7).alias("revision")).distinct()
    return context.current_results(results, scopes)[0].select("id")


@query("ctx_6_readable", "SELECT DISTINCT o_custkey AS scope FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')", ())
def ctx_6(spark, sf):
    """Scopes without unfinished work."""
    o = view(spark, sf, "orders").select(F.col("o_custkey").alias("scope"), F.when(F.col("o_orderstatus") == "P", "RUNNING").when(F.col("o_orderstatus") == "F", "DONE").otherwise("ARCHIVED").alias("status"))
    return context.readable_scopes(o.select("scope").distinct(), o)


@query("ctx_7_requests", """SELECT episode AS qid, id AS candidate_id, 'unknown_source' AS problem FROM f_msg WHERE seq % 6 = 0 UNION ALL SELECT episode, id, 'no_source' FROM f_msg WHERE seq % 10 = 1 UNION ALL SELECT episode, id, 'repeated_source' FROM f_msg WHERE seq % 10 = 3""")
def ctx_7(spark, sf):
    """Candidates whose sources do not stand."""
    m = _msg(spark, sf)
    refs = F.when(F.col("seq") % 10 == 1, F.array().cast("array<string>")).when(F.col("seq") % 10 == 3, F.array("id", "id")).when(F.col("seq") % 6 == 0, F.array("id", F.concat(F.lit("x"), "id"))).otherwise(F.array("id"))
    return context.judgment_requests(m.select(F.col("episode").alias("qid"), F.col("id").alias("candidate_id"), refs.alias("refs")).withColumn("refs", F.col("refs")), m.select(F.col("episode").alias("qid"), "id"))[1]


@query("ctx_8_judgments", "SELECT candidate_id, utility IN ('USEFUL_CONTEXT', 'NECESSARY_CONTEXT') AND claim_support = 'SUPPORTED' AND mention_policy <> 'DO_NOT_USE' AS accepted, false AS disclosure_authorized FROM f_judg", ("f_judg",))
def ctx_8(spark, sf):
    """Which judged candidates are accepted."""
    j = view(spark, sf, "f_judg").withColumns({"qid": F.lit("q"), "anchors": F.array(F.lit("a"))})
    return context.apply_judgments(j, j)[0].select("candidate_id", "accepted", "disclosure_authorized")


_JUDGED = "j AS (SELECT *, utility IN ('USEFUL_CONTEXT', 'NECESSARY_CONTEXT') AND claim_support = 'SUPPORTED' AND mention_policy <> 'DO_NOT_USE' AS accepted, concat('q', candidate_id % 50) AS qid, length(CAST(candidate_id AS VARCHAR)) AS size FROM f_judg)"


def _judged(spark, sf):
    j = view(spark, sf, "f_judg").withColumns({"qid": F.concat(F.lit("q"), (F.col("candidate_id") % 50).cast("string")), "anchors": F.array(F.lit("a"))})
    return context.apply_judgments(j, j)[0]


@query("ctx_9_working_context", f"""WITH {_JUDGED} SELECT qid, coalesce(string_agg(CAST(candidate_id AS VARCHAR), ',' ORDER BY candidate_id) FILTER (accepted), '') AS ids, 'JUDGED_INTERNAL_CONTEXT' AS status FROM j GROUP BY qid""", ("f_judg",))
def ctx_9(spark, sf):
    """The working context after judgment."""
    j = _judged(spark, sf)
    selected = j.select("qid", F.lit("formed").alias("arm"), F.col("candidate_id").alias("id"), F.col("candidate_id").alias("position"))
    return context.working_context(selected, j).select("qid", F.array_join("ids", ",").alias("ids"), "status")


@query("ctx_10_pack", f"""RECURSIVE WITH {_JUDGED}, m AS (SELECT qid, candidate_id, 20 + size * 10 AS size, row_number() OVER (PARTITION BY qid ORDER BY candidate_id) AS k FROM j WHERE accepted),
    w AS (SELECT qid, 0 AS k, '' AS ids, 0 AS n, 60 AS used FROM (SELECT DISTINCT qid FROM j) UNION ALL
      SELECT w.qid, m.k, CASE WHEN used + size + CAST(n > 0 AS INT) <= 200 THEN concat(ids, CASE WHEN n > 0 THEN ',' ELSE '' END, candidate_id) ELSE ids END, n + CAST(used + size + CAST(n > 0 AS INT) <= 200 AS INT), used + CASE WHEN used + size + CAST(n > 0 AS INT) <= 200 THEN size + CAST(n > 0 AS INT) ELSE 0 END
      FROM w JOIN m ON m.qid = w.qid AND m.k = w.k + 1)
    SELECT qid, max_by(ids, k) AS ids, CAST(max_by(used, k) AS BIGINT) AS used, false AS over_state FROM w GROUP BY qid""", ("f_judg",))
def ctx_10(spark, sf):
    """Whole memories packed into a bounded context."""
    j = _judged(spark, sf)
    states = j.select("qid").distinct().withColumn("state_length", F.lit(60))
    memories = j.where("accepted").select("qid", F.col("candidate_id").alias("position"), F.col("candidate_id").alias("id"), (20 + F.char_length(F.col("candidate_id").cast("string")) * 10).alias("length"))
    return context.pack_context(states, memories, 200).select("qid", F.array_join("ids", ",").alias("ids"), "used", "over_state")


def _run(spark, rows: DataFrame, job, name: str, parts: int = 3, schema: str = jobs.MESSAGE, base: str | None = None) -> DataFrame:
    """What a stream puts out over rows that arrive in `parts` steps. Two steps are there when it first
    runs, one a micro-batch; the last is read after a restart from the checkpoint."""
    base = base or f"{shared_dir(spark)}/convmem-{name}-{uuid.uuid4().hex}"
    cuts = rows.approxQuantile("arrival", [i / parts for i in range(1, parts)], 0.01)
    step = sum((F.when(F.col("arrival") > c, 1).otherwise(0) for c in cuts), F.lit(0))
    files = 4
    out = None
    for i in range(parts):
        rows.where(step == i).repartition(files, "scope").write.mode("append").json(f"{base}/in")
        if i >= parts - 2:
            out = jobs.collect_now(job(jobs.message_stream(spark, f"{base}/in", schema, files_per_batch=files)), name, base)
    return out


def _rows(spark, sf):
    m = _msg(spark, sf)
    return m.select("scope", "id", F.col("seq").alias("arrival"), "t", "speaker", "text", "episode")


@query("str_1_intake", "SELECT scope, id, seq AS arrival FROM f_msg")
def str_1(spark, sf):
    """Messages taken in from files as they appear."""
    return _run(spark, _rows(spark, sf), lambda m: m.select("scope", "id", "arrival"), "intake")


@query("str_2_dedup", "SELECT scope, id, arrival, CASE WHEN arrival = first_value(arrival) OVER w THEN 'first' WHEN text = first_value(text) OVER w THEN 'duplicate' ELSE 'conflict' END AS outcome FROM f_dup WINDOW w AS (PARTITION BY scope, id ORDER BY arrival)", ("f_dup",))
def str_2(spark, sf):
    """Stateful dedup of a stream, equal to the batch operator."""
    d = view(spark, sf, "f_dup").select("scope", "id", "arrival", F.lit(0).cast("bigint").alias("t"), F.lit("").alias("speaker"), "text", F.lit("").alias("episode"))
    return _run(spark, d, jobs.dedup_stream, "dedup")


@query("str_2_state", "SELECT scope, id, sha256(arg_min(text, arrival)) AS hash FROM f_dup GROUP BY scope, id", ("f_dup",))
def str_2_state(spark, sf):
    """What the dedup's state holds after a restart: every id with its first text's digest."""
    d = view(spark, sf, "f_dup").select("scope", "id", "arrival", F.lit(0).cast("bigint").alias("t"), F.lit("").alias("speaker"), "text", F.lit("").alias("episode"))
    base = f"{shared_dir(spark)}/convmem-first-{uuid.uuid4().hex}"
    _run(spark, d, lambda m: dedup.first_text_stream(m, parts=4), "first", base=base)
    return dedup.stored_ids(spark, f"{base}/first-state")


@query("str_3_late", "SELECT scope, id, arrival, coalesce(t2 < max(t2) OVER (PARTITION BY scope ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS late FROM (SELECT scope, id, seq AS arrival, t - CASE WHEN seq % 7 = 0 THEN 1500 ELSE 0 END AS t2 FROM f_msg)")
def str_3(spark, sf):
    """Late rows of a stream against each scope's clock."""
    r = _rows(spark, sf).withColumn("t", F.col("t") - F.when(F.col("arrival") % 7 == 0, 1500).otherwise(0))
    return _run(spark, r, jobs.late_stream, "late")


_TOPICS = """RECURSIVE WITH e AS (SELECT scope, concat('k', event_id % 4) AS episode, event_id, t, row_number() OVER (PARTITION BY scope, event_id % 4 ORDER BY event_id) AS n FROM f_life),
    w AS (SELECT scope, episode, n, event_id AS fid, t AS f, t AS l, 1 AS k FROM e WHERE n = 1 UNION ALL
      SELECT o.scope, o.episode, o.n, CASE WHEN z THEN o.event_id ELSE w.fid END, CASE WHEN z THEN o.t ELSE w.f END, o.t, CASE WHEN z THEN 1 ELSE w.k + 1 END
      FROM w JOIN e o ON o.scope = w.scope AND o.episode = w.episode AND o.n = w.n + 1, LATERAL (SELECT o.t - w.l >= 240 OR o.t - w.f >= 960 OR w.k >= 6 AS z)),
    g AS (SELECT scope, episode, CAST(fid AS VARCHAR) AS first_id, f AS first_t, max(l) AS last_t, CAST(max(k) AS BIGINT) AS n FROM w GROUP BY scope, episode, fid, f)"""


@query("str_4_lifecycle", _TOPICS + " SELECT *, CASE WHEN n >= 6 THEN 'count' WHEN last_t + 240 <= first_t + 960 THEN 'ttl' ELSE 'span' END AS reason FROM g", ("f_life",))
def str_4(spark, sf):
    """Topics that a stream closes, several a scope, the last ones by timer."""
    r = view(spark, sf, "f_life").select("scope", F.col("event_id").cast("string").alias("id"), F.col("event_id").cast("bigint").alias("arrival"), "t", F.lit("").alias("speaker"), F.lit("").alias("text"), F.concat(F.lit("k"), (F.col("event_id") % 4).cast("string")).alias("episode"))
    # One row of a scope without topics moves the stream's time beyond all deadlines.
    end = r.agg(F.lit("-").alias("scope"), F.lit(None).cast("string").alias("id"), (F.max("arrival") + 1).alias("arrival"), (F.max("t") + 2000).alias("t"), F.lit("").alias("speaker"), F.lit("tick").alias("text"), F.lit(None).cast("string").alias("episode"))
    return _run(spark, r.unionByName(end), lambda m: topics.lifecycle_stream(m, 240, 960, 6), "lifecycle")


@query("seg_12_stream", None)
def seg_12_stream(spark, sf):
    """Messages routed as they come in, equal to the batch assignment."""
    m = _msg(spark, sf).select("scope", "seq", "id", "t", "speaker", "text", "reply_to")
    return _run(spark, m.withColumn("arrival", F.col("t")), lambda s: topics.routing_stream(s, segment.default_route, 30_000, SPAN, MOST), "routing", schema=jobs.LIVE)


@query("str_5_evictions", """WITH p AS (SELECT scope, episode, id, row_number() OVER (PARTITION BY scope, episode ORDER BY seq) AS position, count(*) OVER (PARTITION BY scope, episode) AS n FROM f_msg)
    SELECT scope, episode, (position - 1) // 2 + 1 AS eviction, string_agg(id, ',' ORDER BY position) AS ids FROM p WHERE 4 + ((position - 1) // 2) * 2 <= n GROUP BY ALL""")
def str_5(spark, sf):
    """Evictions that a stream emits, equal to the closed form."""
    out = _run(spark, _rows(spark, sf), lambda m: jobs.eviction_stream(m, 3, 2), "evictions")
    return out.select("scope", "episode", "eviction", F.array_join("ids", ",").alias("ids"))


@query("str_6_vectors", "SELECT scope, count(*) AS n FROM f_msg GROUP BY scope")
def str_6(spark, sf):
    """Vectors appended by a stream, each message once."""
    base = f"{shared_dir(spark)}/convmem-vectors-{uuid.uuid4().hex}"
    r = _rows(spark, sf)
    for part in (r.where("arrival % 2 = 0"), r.where("arrival % 2 = 1 OR arrival % 4 = 0")):
        part.repartition(4, "scope").write.mode("append").json(f"{base}/in")
        jobs.sync_vectors(jobs.message_stream(spark, f"{base}/in", files_per_batch=2), f"{base}/out", hooks.embed, f"{base}/state").awaitTermination()
    return spark.read.parquet(f"{base}/out").groupBy("scope").agg(F.count("*").alias("n"))


@query("flagship", """WITH s AS (SELECT scope, id, seq, episode, text, row_number() OVER (PARTITION BY scope ORDER BY seq) AS p, count(*) OVER (PARTITION BY scope) AS n FROM f_msg WHERE length(trim(text)) > 0 AND length(text) <= 1024)
    SELECT scope, string_agg(id, ',' ORDER BY p) AS context_ids FROM s WHERE 13 + ((p - 1) // 6) * 6 > n GROUP BY scope""")
def flagship(spark, sf):
    """Messages checked, those too long or empty archived, and the FIFO context of each scope."""
    m = intake.with_defaults(_msg(spark, sf).withColumn("media", F.lit(None).cast("string")))
    kept = m.where(intake.archive_class(F.col("text"), F.col("media")).isNull() & (F.trim("text") != ""))
    return fifo.residual_context(kept, key=["scope"]).select("scope", F.array_join("context_ids", ",").alias("context_ids"))
