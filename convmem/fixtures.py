"""Views over the given tables in the shape of message logs, graphs, vectors and drafts.

Each view is one SELECT that Spark and DuckDB read alike; `{name}` stands for a table or
another view.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS: dict[str, str] = {
    "f_msg": """
        SELECT concat('g', conv_id % 20) AS scope,
               row_number() OVER (PARTITION BY conv_id % 20 ORDER BY conv_id, turn) AS seq,
               concat('c', conv_id) AS episode, concat(conv_id, '-', turn) AS id,
               concat(role, '_', conv_id % 3) AS speaker,
               1704067200 + conv_id * 1200 + turn * 240 AS t, text,
               CASE WHEN turn > 0 THEN concat(conv_id, '-', turn - 1) END AS reply_to,
               role, conv_id, turn
        FROM {conversations}""",
    "f_dup": """
        SELECT scope, id, seq AS arrival, text FROM {f_msg}
        UNION ALL SELECT scope, id, seq + 100000, text FROM {f_msg} WHERE seq % 7 = 0
        UNION ALL SELECT scope, id, seq + 200000, concat(text, '!') FROM {f_msg} WHERE seq % 11 = 0""",
    "f_life": """
        SELECT concat('u', user_id % 3) AS scope, event_id,
               CAST(event_id * 8 + user_id % 5 AS BIGINT) AS t,
               row_number() OVER (PARTITION BY user_id % 3 ORDER BY event_id) AS n FROM {events}""",
    "f_graph": """
        SELECT concat('s', l_suppkey) AS source, concat('p', l_partkey) AS target,
               CASE l_returnflag WHEN 'A' THEN 'CAUSAL' WHEN 'R' THEN 'OPPOSITION' ELSE 'SIMILARITY' END AS relation,
               CAST(l_quantity AS DOUBLE) / 50 AS strength,
               concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey) AS id
        FROM {lineitem}""",
    "f_edge": """
        SELECT concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey) AS id,
               CASE WHEN l_linenumber % 2 = 0 THEN concat('s', l_suppkey % 20) ELSE concat('p', l_partkey % 50) END AS source,
               CASE WHEN l_linenumber % 2 = 0 THEN concat('p', l_partkey % 50) ELSE concat('s', l_suppkey % 20) END AS target,
               CASE l_returnflag WHEN 'A' THEN 'CAUSAL' WHEN 'R' THEN 'OPPOSITION' ELSE 'SIMILARITY' END AS relation,
               CAST(l_quantity AS DOUBLE) / 50 AS strength, 's' AS scope,
               concat('w', l_orderkey % 7, '-', l_partkey % 5, '-', l_suppkey % 3) AS write_id,
               split(concat('x', l_orderkey % 3, ',', 'y', l_linenumber % 2), ',') AS evidence
        FROM {lineitem}""",
    "f_write": """
        SELECT DISTINCT 's' AS scope, concat('w', l_orderkey % 7, '-', l_partkey % 5, '-', l_suppkey % 3) AS write_id, concat('e', l_partkey % 5) AS episode,
               CASE WHEN l_suppkey % 3 = 0 THEN 'consolidation' ELSE 'formation' END AS kind,
               CASE WHEN l_orderkey % 7 = 0 THEN 'FAILED' ELSE 'COMMITTED' END AS status
        FROM {lineitem}""",
    "f_state": """
        SELECT DISTINCT 's' AS scope, concat('e', l_partkey % 5) AS episode,
               CASE WHEN l_partkey % 5 < 2 THEN 'legacy' ELSE 'episode' END AS lifecycle,
               CASE WHEN l_partkey % 5 = 0 THEN 'OPEN' ELSE 'CLOSED' END AS episode_status
        FROM {lineitem}""",
    "f_pub": """
        SELECT 's' AS scope, concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey) AS edge_id,
               concat('w', l_orderkey % 7, '-', l_partkey % 5, '-0') AS write_id
        FROM {lineitem} WHERE l_linenumber = 5""",
    "f_link": """
        SELECT concat(a.id, '-', b.id) AS id, a.id AS source, b.id AS target,
               CASE a.seq % 3 WHEN 0 THEN 'CAUSAL' WHEN 1 THEN 'OPPOSITION' ELSE 'SIMILARITY' END AS relation,
               CAST(a.seq % 10 + 1 AS DOUBLE) / 10 AS strength
        FROM {f_node} a JOIN {f_node} b ON b.seq = a.seq + 7
        UNION ALL
        SELECT concat(a.id, '-', b.id), a.id, b.id, 'SIMILARITY', CAST(a.seq % 7 + 1 AS DOUBLE) / 7
        FROM {f_node} a JOIN {f_node} b ON b.seq = 2 * a.seq + 1""",
    "f_label": """
        SELECT n.id, concat(substr(d.text, 1, 120), ' ', n.id) AS label, concat('p', n.seq % 9) AS speaker
        FROM {f_node} n JOIN {documents} d ON d.doc_id = n.seq""",
    "f_node": """
        SELECT concat('v', vec_id) AS id, vec_id AS seq, concat('s', label % 2) AS scope,
               CASE WHEN vec_id % 4 = 0 THEN 'PERSON' ELSE 'MEMORY' END AS type,
               CASE WHEN vec_id % 10 = 0 THEN 'TEMPORARY' WHEN vec_id % 17 = 0 THEN 'UNRESOLVED' ELSE 'LONG_TERM' END AS stage,
               CASE WHEN vec_id % 13 = 0 THEN 'SUPERSEDED' ELSE 'CURRENT' END AS status,
               concat('e', label) AS episode, embedding FROM {embeddings}""",
    "f_draft": """
        SELECT scope, concat('m', id) AS key, id AS event_id, speaker AS subject, seq,
               CASE WHEN seq % 5 = 0 THEN concat('#', substr(text, 1, 20)) ELSE substr(text, 3, 20) END AS quote,
               CASE WHEN reply_to IS NOT NULL THEN concat('m', reply_to) END AS used_id
        FROM {f_msg}""",
    "f_judg": """
        SELECT doc_id AS candidate_id,
               CASE doc_id % 4 WHEN 0 THEN 'NONE' WHEN 1 THEN 'ASSOCIATIVE_ONLY' WHEN 2 THEN 'USEFUL_CONTEXT' ELSE 'NECESSARY_CONTEXT' END AS utility,
               CASE WHEN quality = 1 THEN 'SUPPORTED' WHEN toxic = 1 THEN 'UNSUPPORTED' ELSE 'UNCERTAIN' END AS claim_support,
               CASE doc_id % 3 WHEN 0 THEN 'INTERNAL_ONLY' WHEN 1 THEN 'CONTEXTUAL_MENTION' ELSE 'DO_NOT_USE' END AS mention_policy
        FROM {labels}""",
}

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table or a view over them."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = VIEWS[name]
    return spark.sql(sql, **{n: view(spark, sf_dir, n) for n in set(re.findall(r"\{(\w+)\}", sql))})


def sql_with(body: str, *names: str) -> str:
    """DuckDB SQL: body with the named views (and those they need) in front."""
    parts: dict[str, str] = {}

    def add(name: str) -> None:
        if name in VIEWS and name not in parts:
            for n in re.findall(r"\{(\w+)\}", VIEWS[name]):
                add(n)
            parts[name] = re.sub(r"\{(\w+)\}", r"\1", VIEWS[name])

    for name in names:
        add(name)
    recursive = "RECURSIVE " if body.lstrip().startswith("RECURSIVE ") else ""
    body = body.lstrip().removeprefix("RECURSIVE ")
    views = ", ".join(f"{n} AS ({s})" for n, s in parts.items())
    if body.startswith("WITH "):
        return f"WITH {recursive}{views}{', ' * bool(views)}{body[5:]}"
    return f"WITH {recursive}{views} {body}" if views else body
