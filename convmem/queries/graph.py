"""Queries of graph reads and dynamics."""

from __future__ import annotations

from pyspark.sql import functions as F

from convmem.fixtures import sql_with, view
from convmem.operators import graph
from convmem.plans import dynamics

QUERIES: dict = {}
ORACLE_SQL: dict = {}
#: Relation weights, direction and parameters that the graph queries share.
RELATIONS = {"CAUSAL": 0.3, "SIMILARITY": 0.4, "OPPOSITION": 0.3}
CONFIG = dynamics.Dynamics(flow_floor=0.00005, max_outflow=0.8, gamma=1.05, anchor=0.04, threshold=0.004, steps=3)
_SEEDS = [("q1", "s1", 0.5), ("q1", "s2", 0.3), ("q1", "s3", 0.2), ("q2", "s4", 2.0), ("q2", "s5", 1.0)]
_SEED_SQL = "seeds(qid, node, weight) AS (VALUES " + ", ".join(f"('{q}', '{n}', {w})" for q, n, w in _SEEDS) + ")"
_NORM_SQL = "init AS (SELECT qid, node, weight / sum(weight) OVER (PARTITION BY qid) AS w0 FROM seeds)"
_ARC_SQL = """eff AS (SELECT id, source, target, relation, strength * CASE relation WHEN 'SIMILARITY' THEN 0.4 ELSE 0.3 END AS e FROM f_graph),
    arcs AS (SELECT source, target, id AS edge_id, relation, 'forward' AS arc_direction, e FROM eff WHERE e > 0
      UNION ALL SELECT target, source, id, relation, 'reverse', e FROM eff WHERE e > 0 AND relation <> 'CAUSAL')"""


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql_with(sql, *views)
        return f

    return register


def _arcs(spark, sf):
    return graph.arcs(view(spark, sf, "f_graph"), RELATIONS, "forward")


def _seeds(spark, sf):
    """Seeds of two queries, taken from the graph's own nodes."""
    g = view(spark, sf, "f_graph").select(F.col("source").alias("node")).distinct()
    weights = F.create_map(*[F.lit(x) for q, n, w in _SEEDS for x in (n, f"{q}:{w}")])
    named = F.element_at(weights, F.col("node"))
    found = g.where(named.isNotNull()).select(F.split_part(named, F.lit(":"), F.lit(1)).alias("qid"), "node", F.split_part(named, F.lit(":"), F.lit(2)).cast("double").alias("weight"))
    return found


_SEED_SQL = _SEED_SQL.replace("seeds(", "all_seeds(") + ", seeds AS (SELECT * FROM all_seeds WHERE node IN (SELECT source FROM f_graph))"


def diffusion_sql(steps: int) -> str:
    """The diffusion, unrolled: CTEs s0 … sN of (qid, node, a) and r1 … rN of raw sums."""
    c = CONFIG
    parts = [_ARC_SQL, _SEED_SQL, _NORM_SQL, "s0 AS (SELECT qid, node, CAST(w0 AS DOUBLE) AS a FROM init)"]
    for k in range(1, steps + 1):
        parts += [
            f"p{k} AS (SELECT qid, s.node AS source, target, edge_id, arc_direction, a, a * e - {c.flow_floor} AS p FROM s{k - 1} s JOIN arcs ON arcs.source = s.node WHERE a * e - {c.flow_floor} > 0)",
            f"o{k} AS (SELECT qid, source, sum(p) AS total, least(min(a) * {c.max_outflow}, sum(p)) AS outflow FROM p{k} GROUP BY qid, source)",
            f"v{k} AS (SELECT p.qid, target AS node, outflow * p / total AS v FROM p{k} p JOIN o{k} o ON o.qid = p.qid AND o.source = p.source UNION ALL SELECT s.qid, node, a - coalesce(outflow, 0) FROM s{k - 1} s LEFT JOIN o{k} o ON o.qid = s.qid AND o.source = s.node)",
            f"r{k} AS (SELECT qid, node, sum(v) AS raw FROM v{k} GROUP BY qid, node)",
            f"c{k} AS (SELECT qid, node, raw, CASE WHEN raw > 0 THEN pow(raw, {c.gamma}) ELSE 0 END / sum(CASE WHEN raw > 0 THEN pow(raw, {c.gamma}) ELSE 0 END) OVER (PARTITION BY qid) AS competed FROM r{k})",
            f"t{k} AS (SELECT coalesce(c.qid, i.qid) AS qid, coalesce(c.node, i.node) AS node, raw, competed, {1 - c.anchor} * coalesce(competed, 0) + {c.anchor} * coalesce(w0, 0) AS a FROM c{k} c FULL JOIN init i ON i.qid = c.qid AND i.node = c.node)",
            f"s{k} AS (SELECT qid, node, a FROM t{k} WHERE a > 0)",
        ]
    return "WITH " + ", ".join(parts)


def _trace(spark, sf):
    return dynamics.diffuse(_arcs(spark, sf), _seeds(spark, sf), CONFIG)


@query("grf_1_visible_nodes", "SELECT id, stage FROM f_node WHERE stage = 'LONG_TERM' OR (stage = 'TEMPORARY' AND episode = 'e2')", ("f_node",))
def grf_1(spark, sf):
    """Nodes that a caller of episode e2 sees."""
    return graph.visible_nodes(view(spark, sf, "f_node"), "e2").select("id", "stage")


@query("grf_2_mentions", """
    SELECT concat('s', s_suppkey) AS id, array_to_string(list_distinct_ordered, ',') AS evidence FROM (
      SELECT s_suppkey, list_filter(l, lambda x, i: list_position(l, x) = i) AS list_distinct_ordered FROM (
        SELECT s_suppkey, list_concat([concat('n', s_nationkey)], coalesce(m, [])) AS l FROM supplier LEFT JOIN (
          SELECT l_suppkey, list(concat('n', l_orderkey % 25) ORDER BY l_orderkey, l_linenumber) AS m FROM lineitem GROUP BY 1) x ON l_suppkey = s_suppkey))""")
def grf_2(spark, sf):
    """Evidence of nodes with that of their mentions, in order, once each."""
    nodes = view(spark, sf, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"), F.array(F.concat(F.lit("n"), F.col("s_nationkey").cast("string"))).alias("evidence"))
    m = view(spark, sf, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("node_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("run_id"), F.array(F.concat(F.lit("n"), (F.col("l_orderkey") % 25).cast("string"))).alias("evidence"))
    return graph.merge_mentions(nodes, m).select("id", F.array_join("evidence", ",").alias("evidence"))


_EDGE_VIEWS = ("f_edge", "f_write", "f_state", "f_pub")
_VISIBLE = """SELECT e.* FROM f_edge e JOIN f_write w ON w.scope = e.scope AND w.write_id = e.write_id AND w.status = 'COMMITTED' LEFT JOIN f_state s ON s.scope = w.scope AND s.episode = w.episode
    WHERE (s.lifecycle = 'legacy' AND s.episode_status <> 'OPEN') OR w.episode = 'e2' OR w.kind = 'consolidation'
       OR e.id IN (SELECT edge_id FROM f_pub p JOIN f_write c ON c.scope = p.scope AND c.write_id = p.write_id WHERE c.kind = 'consolidation' AND c.status = 'COMMITTED')"""


def _visible(spark, sf):
    return graph.visible_edges(*[view(spark, sf, v) for v in _EDGE_VIEWS], episode="e2")


@query("grf_3_visible_edges", f"SELECT id, source, target, relation FROM ({_VISIBLE})", _EDGE_VIEWS)
def grf_3(spark, sf):
    """Edges that a caller of episode e2 sees."""
    return _visible(spark, sf).select("id", "source", "target", "relation")


_COMBINED = f"""SELECT CASE WHEN relation = 'CAUSAL' THEN source ELSE least(source, target) END AS source,
      CASE WHEN relation = 'CAUSAL' THEN target ELSE greatest(source, target) END AS target, relation,
      max(strength) AS strength, min(id) AS id, count(DISTINCT id) AS n_records, array_to_string(list_sort(list_distinct(flatten(list(evidence)))), ',') AS evidence FROM ({_VISIBLE}) GROUP BY 1, 2, 3"""


@query("grf_4_combined", _COMBINED.replace("max(strength)", "round(max(strength), 6)"), _EDGE_VIEWS)
def grf_4(spark, sf):
    """Parallel edges combined, with their evidence, after the visibility filter."""
    out = graph.combine_parallel(_visible(spark, sf))
    return out.select("source", "target", "relation", F.round("strength", 6).alias("strength"), "id", F.size("record_ids").cast("bigint").alias("n_records"), F.array_join("evidence", ",").alias("evidence"))


@query("grf_5_visible_graph", f"SELECT id, source, target FROM ({_COMBINED}) WHERE CAST(substr(source, 2) AS INT) % 3 <> 0 AND CAST(substr(target, 2) AS INT) % 3 <> 0", _EDGE_VIEWS)
def grf_5(spark, sf):
    """Combined edges with both ends among the visible nodes."""
    e = graph.combine_parallel(_visible(spark, sf))
    nodes = e.select(F.col("source").alias("id")).unionByName(e.select(F.col("target").alias("id"))).distinct().where(F.substring("id", 2, 9).cast("int") % 3 != 0)
    return graph.visible_graph(nodes, e).select("id", "source", "target")


@query("grf_6_touching", "SELECT id, source, target FROM f_edge WHERE source IN ('s1', 's2', 'p3', 'p4') OR target IN ('s1', 's2', 'p3', 'p4')", ("f_edge",))
def grf_6(spark, sf):
    """Edges that touch a set of nodes."""
    e = view(spark, sf, "f_edge")
    ids = e.select(F.explode(F.array("source", "target")).alias("id")).where("id IN ('s1', 's2', 'p3', 'p4')").distinct()
    return graph.touching_edges(e, ids).select("id", "source", "target")


@query("grf_7_arcs", f"WITH {_ARC_SQL} SELECT source, target, edge_id, relation, arc_direction, round(e, 6) AS effective FROM arcs", ("f_graph",))
def grf_7(spark, sf):
    """Directed arcs with their effects."""
    return _arcs(spark, sf).select("source", "target", "edge_id", "relation", "arc_direction", F.round("effective", 6).alias("effective"))


@query("grf_8_normalize", "SELECT scope, id, round(seq / sum(seq) OVER (PARTITION BY scope), 9) AS weight FROM f_msg WHERE seq > 0", ("f_msg",))
def grf_8(spark, sf):
    """Weights of each scope brought to sum 1."""
    m = view(spark, sf, "f_msg").select("scope", "id", F.col("seq").cast("double").alias("weight"))
    return graph.normalize(m, ["scope"]).select("scope", "id", F.round("weight", 9).alias("weight"))


@query("grf_9_frontier", f"""WITH {_ARC_SQL}, {_SEED_SQL}, r AS (SELECT qid, source, target, edge_id, arc_direction FROM seeds JOIN arcs ON arcs.source = seeds.node)
    SELECT r.*, n > 2 OR k > 4000 AS over_limit FROM r JOIN (SELECT qid, count(DISTINCT source) AS n, count(*) AS k FROM r GROUP BY qid) c ON c.qid = r.qid""", ("f_graph",))
def grf_9(spark, sf):
    """All arcs of the seeds, and whether they are more than a read may take."""
    arcs, counts = graph.frontier_arcs(_arcs(spark, sf), _seeds(spark, sf), 2, 4000)
    return arcs.join(counts.select("qid", "over_limit"), "qid").select("qid", "source", "target", "edge_id", "arc_direction", "over_limit")


@query("grf_10_fingerprint", "SELECT write_id, source, count(*) AS n, sha256(concat_ws(':', count(*), " + ", ".join(f"sum(CAST(concat('0x', substr(h, {1 + 8 * i}, 8)) AS BIGINT))" for i in range(4)) + ")) AS fingerprint FROM (SELECT *, sha256(concat_ws(chr(9), id, target, relation)) AS h FROM f_edge) GROUP BY write_id, source", ("f_edge",))
def grf_10(spark, sf):
    """A fingerprint of the edges of each write and source."""
    return graph.fingerprint(view(spark, sf, "f_edge"), ["id", "target", "relation"], ["write_id", "source"])


_EPISODES = "ep AS (SELECT scope, episode, CASE WHEN min(conv_id) % 3 = 0 THEN 'OPEN' WHEN min(conv_id) % 3 = 1 THEN 'CLOSED' ELSE 'CONSOLIDATED' END AS episode_status FROM f_msg GROUP BY ALL)"


def _episodes(m):
    state = F.when(F.min("conv_id") % 3 == 0, "OPEN").when(F.min("conv_id") % 3 == 1, "CLOSED").otherwise("CONSOLIDATED")
    return m.groupBy("scope", "episode").agg(state.alias("episode_status"))


@query("grf_11_visible_events", f"WITH {_EPISODES} SELECT m.scope, m.id FROM f_msg m JOIN ep USING (scope, episode) WHERE episode_status <> 'OPEN' OR episode = 'c3'", ("f_msg",))
def grf_11(spark, sf):
    """Raw events of closed episodes and the caller's own."""
    m = view(spark, sf, "f_msg")
    return graph.visible_events(m, _episodes(m), "c3").select("scope", "id")


@query("grf_12_backfill", f"""WITH {_EPISODES}, vis AS (SELECT m.scope, m.id FROM f_msg m JOIN ep USING (scope, episode) WHERE episode_status <> 'OPEN')
    SELECT scope, id, seq FROM f_msg m WHERE seq % 2 = 0 AND NOT EXISTS (SELECT 1 FROM vis WHERE vis.scope = m.scope AND vis.id = m.id)""", ("f_msg",))
def grf_12(spark, sf):
    """Cited events that are not visible."""
    m = view(spark, sf, "f_msg")
    cited = m.where("seq % 2 = 0").select("scope", F.col("id").alias("event_id"))
    return graph.cited_backfill(cited, graph.visible_events(m, _episodes(m)), m)[0].select("scope", "id", "seq")


@query("rcl_13_diffusion", diffusion_sql(3) + " SELECT qid, node, round(a, 8) AS a FROM s3 WHERE a >= 1e-6", ("f_graph",))
def rcl_13(spark, sf):
    """Attention after three steps of the diffusion."""
    return _trace(spark, sf).where("step = 3 AND a >= 1e-6").select("qid", "node", F.round("a", 8).alias("a"))


@query("rcl_14_trace", diffusion_sql(3) + " SELECT t.*, n_flows, sent FROM (" + " UNION ALL ".join(f"SELECT qid, {k} AS step, count(raw) AS reached, string_agg(node, ',' ORDER BY node) FILTER (a >= 0.004) AS emerged, round(max(competed), 6) AS top FROM t{k} GROUP BY qid" for k in (1, 2, 3))
    + ") t JOIN (" + " UNION ALL ".join(f"SELECT qid, {k} AS step, count(*) AS n_flows, round(sum(d), 6) AS sent FROM (SELECT p.qid, outflow * p / total AS d FROM p{k} p JOIN o{k} o ON o.qid = p.qid AND o.source = p.source) GROUP BY qid" for k in (1, 2, 3)) + ") f ON f.qid = t.qid AND f.step = t.step", ("f_graph",))
def rcl_14(spark, sf):
    """Per step what the diffusion reached, what emerged, and what flowed."""
    trace = _trace(spark, sf)
    t = trace.where("step > 0").groupBy("qid", "step").agg(F.count("raw").alias("reached"), F.round(F.max("competed"), 6).alias("top"))
    names = dynamics.emerged(trace, CONFIG).groupBy("qid", "step").agg(F.array_join(F.array_sort(F.collect_list("node")), ",").alias("emerged"))
    flows = dynamics.diffusion_flows(_arcs(spark, sf), trace, CONFIG).groupBy("qid", "step").agg(F.count("*").alias("n_flows"), F.round(F.sum("amount"), 6).alias("sent"))
    return t.join(names, ["qid", "step"], "left").join(flows, ["qid", "step"])


def _paths_sql() -> str:
    parts = ["k0 AS (SELECT qid, node, 0 AS step, '' AS path FROM s0)"]
    for k in (1, 2, 3):
        parts.append(f"f{k} AS (SELECT p.qid, p.source, p.target AS node, edge_id, row_number() OVER (PARTITION BY p.qid, p.target ORDER BY outflow * p / total DESC, p.source, edge_id, arc_direction) AS r FROM p{k} p JOIN o{k} o ON o.qid = p.qid AND o.source = p.source WHERE NOT EXISTS (SELECT 1 FROM k{k - 1} x WHERE x.qid = p.qid AND x.node = p.target))")
        parts.append(f"k{k} AS (SELECT * FROM k{k - 1} UNION ALL SELECT f.qid, f.node, {k}, concat(x.path, '/', edge_id) FROM f{k} f JOIN k{k - 1} x ON x.qid = f.qid AND x.node = f.source WHERE r = 1)")
    return diffusion_sql(3) + ", " + ", ".join(parts)


@query("rcl_15_paths", _paths_sql() + " SELECT qid, node, CAST(step AS INTEGER) AS step, path FROM k3", ("f_graph",))
def rcl_15(spark, sf):
    """The path by which each node was first reached."""
    p = dynamics.discovery_paths(_arcs(spark, sf), _trace(spark, sf), CONFIG)
    return p.select("qid", "node", "step", F.array_join(F.transform("path", lambda e: F.concat(F.lit("/"), e)), "").alias("path"))


@query("rcl_16_conservation", diffusion_sql(3) + " SELECT * FROM (" + " UNION ALL ".join(f"SELECT qid, {k} AS step, abs(sum(raw) - 1) < 1e-10 AND abs(sum(a) - 1) < 1e-10 AS conserved FROM t{k} GROUP BY qid" for k in (1, 2, 3)) + ")", ("f_graph",))
def rcl_16(spark, sf):
    """Whether attention is conserved at every step."""
    return dynamics.conservation(_trace(spark, sf)).select("qid", "step", "conserved")


_BEST = "WITH " + ", ".join([_ARC_SQL, _SEED_SQL, _NORM_SQL, "b0 AS (SELECT qid, node, CAST(w0 AS DOUBLE) AS score, '' AS path FROM init)"] + [
    f"b{k} AS (SELECT qid, node, score, path FROM (SELECT qid, target AS node, score * e AS score, concat(path, '/', edge_id) AS path, row_number() OVER (PARTITION BY qid, target ORDER BY score * e DESC, b.node, edge_id, arc_direction) AS r FROM b{k - 1} b JOIN arcs ON arcs.source = b.node) WHERE r = 1)" for k in (1, 2, 3)])


@query("rcl_17_best_paths", _BEST + " SELECT qid, node, round(score, 9) AS score, path FROM (SELECT *, row_number() OVER (PARTITION BY qid, node ORDER BY score DESC, layer) AS r FROM (" + " UNION ALL ".join(f"SELECT *, {k} AS layer FROM b{k}" for k in range(4)) + ")) WHERE r = 1", ("f_graph",))
def rcl_17(spark, sf):
    """Best-path scores within three steps, with their paths."""
    best = dynamics.best_paths(_arcs(spark, sf), _seeds(spark, sf), 3)
    return best.select("qid", "node", F.round("score", 9).alias("score"), F.array_join(F.transform("path", lambda e: F.concat(F.lit("/"), e)), "").alias("path"))


@query("rcl_18_counters", diffusion_sql(3) + """, deg AS (SELECT source, count(*) AS d FROM arcs GROUP BY source), act AS (SELECT * FROM s0 UNION ALL SELECT * FROM s1 UNION ALL SELECT * FROM s2)
    SELECT act.qid, CAST(coalesce(sum(d), 0) AS BIGINT) AS checked_arcs, count(DISTINCT node) AS expanded_sources, min(v) AS visited_nodes FROM act LEFT JOIN deg ON deg.source = act.node
    JOIN (SELECT qid, count(*) AS v FROM s3 GROUP BY qid) x ON x.qid = act.qid GROUP BY act.qid""", ("f_graph",))
def rcl_18(spark, sf):
    """Arcs checked, sources expanded and nodes visited."""
    return dynamics.traversal_counters(_arcs(spark, sf), _trace(spark, sf), 3)
