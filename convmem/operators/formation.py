"""Formation: checks of drafts and what applying them does to nodes, edges and records.

Drafts are tables keyed by run_id. Every check returns (run_id, rule, key) rows; a run is applied
only if it has none (clean_runs). All checks are joins and grouped counts, so any number of
runs is checked in one job.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

EMPTY = "array<string>"


def _found(rows: DataFrame, rule: str, key: str = "key", run: str = "run_id") -> DataFrame:
    return rows.select(F.col(run).alias("run_id"), F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key"))


def clean_runs(runs: DataFrame, violations: list[DataFrame]) -> DataFrame:
    """Runs (run_id) without any violation."""
    bad = violations[0].select("run_id")
    for v in violations[1:]:
        bad = bad.unionByName(v.select("run_id"))
    return runs.join(bad.distinct(), "run_id", "left_anti")


def parse_drafts(raw: DataFrame, schema: str, keys: list[str], text_col: str = "body") -> DataFrame:
    """Adds draft (parsed by the schema) and shape_ok: valid JSON with exactly the given top-level
    keys. Null or malformed text: draft null, shape_ok false."""
    found = F.array_sort(F.json_object_keys(text_col))
    parsed = raw.withColumn("draft", F.from_json(text_col, schema))
    return parsed.withColumn("shape_ok", F.coalesce(found == F.array(*[F.lit(k) for k in sorted(keys)]), F.lit(False)) & F.col("draft").isNotNull())


#: The parts of a formation draft: the exact keys of their items, the texts that must not be blank, and
#: the values that a field may have; fixed values.
DRAFT = {
    "entities": (("key", "type", "label", "speakerId", "evidence"), ("key", "label"), {"type": ("PERSON", "ALIAS", "CONCEPT", "OBJECT", "LOCATION", "ACTIVITY")}),
    "memories": (("key", "kind", "text", "subject", "evidence", "usedMemoryIds", "supersedes"), ("key", "text", "subject"), {"kind": ("EPISODIC", "SEMANTIC", "PROCEDURAL", "GOAL")}),
    "associations": (("source", "target", "relation", "strength", "evidence", "rationale"), ("source", "target", "rationale"), {"relation": ("CAUSAL", "SIMILARITY", "OPPOSITION")}),
    "skipped": (("eventId", "reason"), ("eventId", "reason"), {}),
}
#: The most items of a part, and characters of a text.
MOST_ITEMS, MOST_CHARACTERS = 500, 12_000


def _any_text(names: tuple) -> Callable[[Column], Column]:
    """Whether a JSON item lacks one of the texts, or has it blank or too long."""
    def bad(x: Column) -> Column:
        out = F.lit(False)
        for name in names:
            text = F.get_json_object(x, f"$.{name}")
            out = out | F.coalesce((F.trim(text) == "") | (F.char_length(text) > MOST_CHARACTERS), F.lit(True))
        return out
    return bad


def _any_value(enums: dict) -> Callable[[Column], Column]:
    """Whether a field of a JSON item has none of its allowed values."""
    def bad(x: Column) -> Column:
        out = F.lit(False)
        for name, allowed in enums.items():
            out = out | ~F.coalesce(F.get_json_object(x, f"$.{name}").isin(*allowed), F.lit(False))
        return out
    return bad


def draft_violations(raw: DataFrame, parts: dict = DRAFT, text_col: str = "body") -> DataFrame:
    """(run_id, rule, part) of draft texts (run_id, body) that break the contract: keys (of the draft, part
    '', or of an item), items (no array, or too many), text (missing, blank or too long), value (not
    among those allowed). Each rule is reported once for a part. Null or malformed JSON: keys of ''."""
    schema = ", ".join(f"{p} array<string>" for p in parts)
    top = F.coalesce(F.array_sort(F.json_object_keys(text_col)) == F.array(*[F.lit(p) for p in sorted(parts)]), F.lit(False))
    d = raw.select("run_id", top.alias("_top"), F.from_json(text_col, schema).alias("_d"))
    found = [F.when(~F.col("_top"), F.struct(F.lit("keys").alias("rule"), F.lit("").alias("part")))]
    for part, (keys, texts, enums) in parts.items():
        items = F.col("_d")[part]
        exact = F.array(*[F.lit(k) for k in sorted(keys)])
        checks = {
            "items": items.isNull() | (F.size(items) > MOST_ITEMS), "keys": F.exists(items, lambda x: ~F.coalesce(F.array_sort(F.json_object_keys(x)) == exact, F.lit(False))),  # noqa: B023
            "text": F.exists(items, _any_text(texts)), "value": F.exists(items, _any_value(enums)),
        }
        found += [F.when(F.col("_top") & F.coalesce(c, F.lit(False)), F.struct(F.lit(rule).alias("rule"), F.lit(part).alias("part"))) for rule, c in checks.items()]
    return d.select("run_id", F.explode(F.array_compact(F.array(*found))).alias("x")).select("run_id", "x.rule", "x.part")


def evidence_errors(evidence: DataFrame, events: DataFrame) -> DataFrame:
    """Citations (run_id, key, event_id, quote) of events that are not the run's input
    (events: run_id, event_id, text), or whose quote is no verbatim part of the text."""
    joined = evidence.join(events.select("run_id", "event_id", "text"), ["run_id", "event_id"], "left")
    rule = F.when(F.col("text").isNull(), "unknown_event").when(F.coalesce(F.instr("text", F.col("quote")), F.lit(0)) == 0, "quote")
    return joined.withColumn("rule", rule).where("rule IS NOT NULL").select("run_id", "rule", "key")


def items_without_evidence(items: DataFrame, evidence: DataFrame) -> DataFrame:
    return _found(items.join(evidence.select("run_id", "key").distinct(), ["run_id", "key"], "left_anti"), "no_evidence")


def stale_citations(evidence: DataFrame, pending: DataFrame) -> DataFrame:
    """New memories and associations that cite no pending event (pending: run_id, event_id)."""
    marked = evidence.join(pending.select("run_id", "event_id", F.lit(1).alias("_p")), ["run_id", "event_id"], "left")
    return _found(marked.groupBy("run_id", "key").agg(F.max(F.coalesce("_p", F.lit(0))).alias("p")).where("p = 0"), "not_pending")


def uncovered_events(pending: DataFrame, cited: DataFrame, skipped: DataFrame) -> DataFrame:
    """Pending events neither cited nor skipped, and events skipped twice or not pending."""
    covered = cited.select("run_id", "event_id").unionByName(skipped.select("run_id", "event_id")).distinct()
    open_ = _found(pending.join(covered, ["run_id", "event_id"], "left_anti"), "uncovered", "event_id")
    twice = _found(skipped.groupBy("run_id", "event_id").agg(F.count("*").alias("n")).where("n > 1"), "skipped_twice", "event_id")
    foreign = _found(skipped.join(pending.select("run_id", "event_id"), ["run_id", "event_id"], "left_anti"), "skipped_not_pending", "event_id")
    return open_.unionByName(twice).unionByName(foreign)


def key_errors(items: DataFrame, nodes: DataFrame) -> DataFrame:
    """Local keys that repeat within a run or are ids of existing nodes (nodes: id)."""
    twice = _found(items.groupBy("run_id", "key").agg(F.count("*").alias("n")).where("n > 1"), "repeated_key")
    taken = _found(items.join(nodes.select(F.col("id").alias("key")), "key", "left_semi"), "existing_id")
    return twice.unionByName(taken)


def speaker_errors(entities: DataFrame, evidence: DataFrame, events: DataFrame) -> DataFrame:
    """Speaker bindings (entities: run_id, key, type, label, speaker_id) that are no PERSON named
    by the speaker's id, lack an event of the speaker's own, or bind a speaker twice."""
    bound = entities.where("speaker_id IS NOT NULL")
    form = _found(bound.where((F.col("type") != "PERSON") | (F.col("label") != F.col("speaker_id"))), "speaker_label")
    own = evidence.join(events.select("run_id", "event_id", "speaker"), ["run_id", "event_id"]).select("run_id", "key", F.col("speaker").alias("speaker_id"))
    unsupported = _found(bound.join(own, ["run_id", "key", "speaker_id"], "left_anti"), "speaker_evidence")
    twice = _found(bound.groupBy("run_id", "speaker_id").agg(F.count("*").alias("n")).where("n > 1"), "speaker_twice", "speaker_id")
    return form.unionByName(unsupported).unionByName(twice)


def mint_node(run: Column, key: Column) -> Column:
    """node_ and 24 hex digits of the SHA-256 over [run, key]."""
    return F.concat(F.lit("node_"), F.substring(F.sha2(F.to_json(F.array(run.cast("string"), key.cast("string"))), 256), 1, 24))


def resolve_identity(entities: DataFrame, nodes: DataFrame) -> DataFrame:
    """Adds node_id: the scope's node of the same speaker if there is one, else a minted id."""
    known = nodes.where("speaker_id IS NOT NULL").groupBy("scope", "speaker_id").agg(F.min("id").alias("_known"))
    out = entities.join(known, ["scope", "speaker_id"], "left")
    return out.withColumn("node_id", F.coalesce("_known", mint_node(F.col("run_id"), F.col("key")))).drop("_known")


def repeated_identities(nodes: DataFrame) -> DataFrame:
    """(scope, speaker_id) held by more than one node."""
    return nodes.where("speaker_id IS NOT NULL").groupBy("scope", "speaker_id").agg(F.count("*").alias("n")).where("n > 1")


def reference_errors(memories: DataFrame, entity_keys: DataFrame, known: DataFrame) -> DataFrame:
    """Memories (run_id, key, subject, used array) whose subject is no entity (run_id, key) or whose
    used ids repeat or are no injected memories (run_id, id)."""
    subject = _found(memories.join(entity_keys.select("run_id", F.col("key").alias("subject")).distinct(), ["run_id", "subject"], "left_anti"), "subject")
    twice = _found(memories.where(F.size("used") != F.size(F.array_distinct("used"))), "used_twice")
    used = memories.select("run_id", "key", F.explode("used").alias("id"))
    unknown = _found(used.join(known.select("run_id", "id").distinct(), ["run_id", "id"], "left_anti"), "used_unknown").distinct()
    return subject.unionByName(twice).unionByName(unknown)


def supersede_errors(memories: DataFrame, known: DataFrame) -> DataFrame:
    """Supersedes of (run_id, key, subject, used, supersedes): the target must be a current memory of
    the same subject (known: run_id, id, status, subject), be used too, and be replaced once."""
    s = memories.select("run_id", "key", "subject", "used", F.explode("supersedes").alias("id"))
    target = known.select("run_id", "id", "status", F.col("subject").alias("_subject"))
    joined = s.join(target, ["run_id", "id"], "left")
    rule = F.when(~F.coalesce(F.col("status") == "CURRENT", F.lit(False)), "not_current").when(~F.array_contains("used", F.col("id")), "not_used").when(~F.col("_subject").eqNullSafe(F.col("subject")), "other_subject")
    bad = joined.withColumn("rule", rule).where("rule IS NOT NULL").select("run_id", "rule", "key")
    twice = _found(s.groupBy("run_id", "id").agg(F.count("*").alias("n")).where("n > 1"), "replaced_twice", "id")
    return bad.unionByName(twice)


def association_errors(associations: DataFrame, names: DataFrame) -> DataFrame:
    """Associations (run_id, key, source, target, relation, strength) with an unknown end, equal ends
    after resolution, a strength outside [.01, 1], or repeated (unordered unless CAUSAL).
    names: run_id, key, node_id."""
    s = names.select("run_id", F.col("key").alias("source"), F.col("node_id").alias("_s"))
    t = names.select("run_id", F.col("key").alias("target"), F.col("node_id").alias("_t"))
    a = associations.join(s, ["run_id", "source"], "left").join(t, ["run_id", "target"], "left")
    rule = F.when(F.col("_s").isNull() | F.col("_t").isNull(), "unknown_end").when(F.col("_s") == F.col("_t"), "same_end").when(F.isnan("strength") | ~F.coalesce(F.col("strength").between(0.01, 1), F.lit(False)), "strength")
    bad = a.withColumn("rule", rule).where("rule IS NOT NULL").select("run_id", "rule", "key")
    directed = F.col("relation") == "CAUSAL"
    pair = a.withColumns({"_a": F.when(directed, F.col("_s")).otherwise(F.least("_s", "_t")), "_b": F.when(directed, F.col("_t")).otherwise(F.greatest("_s", "_t"))})
    twice = pair.where("_s IS NOT NULL AND _t IS NOT NULL").groupBy("run_id", "_a", "_b", "relation").agg(F.count("*").alias("n"), F.min("key").alias("key")).where("n > 1")
    return bad.unionByName(_found(twice, "repeated"))


def record_errors(records: DataFrame, readable: DataFrame, injected: DataFrame, active: DataFrame) -> DataFrame:
    """Temporary records (run_id, key, subjects, direct, used, supersedes; arrays) against what the run
    could read (run_id, event_id), was given (run_id, id) and may replace (run_id, id)."""
    def sets(df: DataFrame, c: str, name: str) -> DataFrame:
        return df.groupBy("run_id").agg(F.collect_set(c).alias(name))
    empty = F.array().cast(EMPTY)
    r = records.join(sets(readable, "event_id", "_read"), "run_id", "left").join(sets(injected, "id", "_given"), "run_id", "left").join(sets(active, "id", "_active"), "run_id", "left")
    def beyond(c: str, allowed: str) -> Column:
        return (F.size(c) != F.size(F.array_distinct(c))) | (F.size(F.array_except(c, F.coalesce(allowed, empty))) > 0)
    named = [
        ("subjects", (F.size("subjects") == 0) | (F.size("subjects") != F.size(F.array_distinct("subjects")))), ("direct", beyond("direct", "_read")),
        ("no_source", (F.size("direct") == 0) & (F.size("used") == 0)), ("used", beyond("used", "_given")),
        ("supersedes", beyond("supersedes", "_active") | (F.size(F.array_except("supersedes", "used")) > 0)),
    ]
    rules = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in named]), lambda x: x.isNotNull())
    bad = r.select("run_id", F.explode(rules).alias("rule"), "key")
    ids = _found(records.groupBy("run_id", "key").agg(F.count("*").alias("n")).where("n > 1"), "repeated_id")
    twice = records.select("run_id", F.explode("supersedes").alias("id")).groupBy("run_id", "id").agg(F.count("*").alias("n")).where("n > 1")
    return bad.unionByName(ids).unionByName(_found(twice, "replaced_twice", "id"))


def with_sources(records: DataFrame, sources: DataFrame, key: str = "id") -> DataFrame:
    """Adds inherited (sources of the used records, sorted) and all_sources (with direct ones).
    sources: id, source_ids of what can be used."""
    used = records.select(F.col(key).alias("_k"), F.explode("used").alias("id")).join(sources.select("id", F.explode("source_ids").alias("_s")), "id")
    inherited = used.groupBy("_k").agg(F.array_sort(F.collect_set("_s")).alias("inherited"))
    out = records.join(inherited, records[key] == inherited["_k"], "left").drop("_k")
    out = out.withColumn("inherited", F.coalesce("inherited", F.array().cast(EMPTY)))
    return out.withColumn("all_sources", F.array_sort(F.array_union("direct", "inherited")))


def formed_with(records: DataFrame, key: str = "id") -> DataFrame:
    """(source, target): one provenance link per used id."""
    return records.select(F.col(key).alias("source"), F.explode("used").alias("target"))


def archive_superseded(temporaries: DataFrame, records: DataFrame, closed: DataFrame | None = None) -> DataFrame:
    """Temporaries with status ARCHIVED where a record supersedes them or their episode closed."""
    gone = records.select(F.explode("supersedes").alias("id")).distinct().withColumn("_gone", F.lit(True))
    out = temporaries.join(gone, "id", "left")
    mark = F.coalesce("_gone", F.lit(False))
    if closed is not None:
        out = out.join(closed.select("scope", "episode", F.lit(True).alias("_closed")), ["scope", "episode"], "left")
        mark = mark | F.coalesce("_closed", F.lit(False))
    return out.withColumn("status", F.when(mark, "ARCHIVED").otherwise(F.col("status"))).drop("_gone", "_closed")


def build_nodes(entities: DataFrame, memories: DataFrame, stage: str) -> DataFrame:
    """Node rows of a draft. entities: run_id, key, type, label, node_id; memories: run_id, key, kind, text,
    subject (a local key or a node id)."""
    names = entities.select("run_id", F.col("key").alias("subject"), F.col("node_id").alias("_subject"))
    e = entities.select(F.col("node_id").alias("id"), "run_id", F.lit(stage).alias("stage"), "type", F.lit(None).cast("string").alias("kind"), "label", F.lit(None).cast("string").alias("subject"))
    m = memories.join(names, ["run_id", "subject"], "left").select(mint_node(F.col("run_id"), F.col("key")).alias("id"), "run_id", F.lit(stage).alias("stage"), F.lit("MEMORY").alias("type"), "kind", F.col("text").alias("label"), F.coalesce("_subject", "subject").alias("subject"))
    return e.dropDuplicates(["id"]).unionByName(m)


def build_edges(associations: DataFrame, names: DataFrame) -> DataFrame:
    """Edges with both ends mapped from local keys (names: run_id, key, node_id); ends that are node ids
    already stay."""
    s = names.select("run_id", F.col("key").alias("source"), F.col("node_id").alias("_s"))
    t = names.select("run_id", F.col("key").alias("target"), F.col("node_id").alias("_t"))
    joined = associations.join(s, ["run_id", "source"], "left").join(t, ["run_id", "target"], "left")
    return joined.select("run_id", "key", F.coalesce("_s", "source").alias("source"), F.coalesce("_t", "target").alias("target"), "relation", "strength")


def build_mentions(evidence: DataFrame, events: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node_id, run_id, evidence): citations of a subject; of subjects bound to a speaker only those
    the speaker wrote. evidence: run_id, node_id, event_id, quote; events: event_id, speaker;
    nodes: node_id, speaker_id."""
    e = evidence.join(events, "event_id").join(nodes, "node_id")
    own = e.where(F.col("speaker_id").isNull() | (F.col("speaker_id") == F.col("speaker")))
    return own.groupBy("node_id", "run_id").agg(F.array_sort(F.collect_set(F.concat_ws("|", "event_id", "quote"))).alias("evidence"))


def apply_supersedes(nodes: DataFrame, memories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes with superseded ones marked, revisions old_id, new_id, run_id)."""
    revisions = memories.select("run_id", F.col("node_id").alias("new_id"), F.explode("supersedes").alias("old_id"))
    gone = revisions.select(F.col("old_id").alias("id"), F.lit(True).alias("_gone")).distinct()
    marked = nodes.join(gone, "id", "left").withColumn("status", F.when(F.col("_gone"), "SUPERSEDED").otherwise(F.col("status"))).drop("_gone")
    return marked, revisions.select("old_id", "new_id", "run_id")


def mark_processed(events: DataFrame, sources: DataFrame) -> DataFrame:
    """Events with processed set where they were a committed run's source (scope, event_id)."""
    done = sources.select("scope", F.col("event_id").alias("id"), F.lit(True).alias("_done")).distinct()
    return events.join(done, ["scope", "id"], "left").withColumn("processed", F.coalesce("_done", F.lit(False)) | F.col("processed")).drop("_done")


def final_decision_errors(decisions: DataFrame, temporaries: DataFrame, memories: DataFrame) -> DataFrame:
    """Decisions (run_id, id, action) must cover exactly the archived temporaries (run_id, id, kind);
    USED exactly those that a memory (run_id, used, supersedes) cites; what is pending or in
    conflict and unused is RETAIN_UNRESOLVED; no temporary is superseded."""
    used = memories.select("run_id", F.explode("used").alias("id")).join(temporaries.select("run_id", "id"), ["run_id", "id"], "left_semi").distinct().withColumn("_used", F.lit(True))
    d = decisions.groupBy("run_id", "id").agg(F.count("*").alias("_n"), F.min("action").alias("action"))
    both = temporaries.withColumn("_t", F.lit(True)).join(d, ["run_id", "id"], "full_outer").join(used, ["run_id", "id"], "left")
    is_used = F.coalesce("_used", F.lit(False))
    rule = (F.when(F.col("_t").isNull(), "foreign").when(F.col("_n").isNull(), "undecided").when(F.col("_n") > 1, "decided_twice")
            .when((F.col("action") == "USED") != is_used, "used_mismatch")
            .when(F.col("kind").isin("pending_reference", "conflict") & ~is_used & (F.col("action") != "RETAIN_UNRESOLVED"), "unresolved"))
    bad = both.withColumn("rule", rule).where("rule IS NOT NULL").select("run_id", "rule", F.col("id").alias("key"))
    replaced = memories.select("run_id", F.explode("supersedes").alias("id")).join(temporaries.select("run_id", "id"), ["run_id", "id"], "left_semi")
    return bad.unionByName(_found(replaced, "supersedes_temporary", "id"))


def final_stage(record_kind: Column) -> Column:
    return F.when(record_kind.isin("pending_reference", "conflict"), "UNRESOLVED").otherwise("LONG_TERM")


def formation_packets(events: DataFrame, nodes: DataFrame, edges: DataFrame, explicit: DataFrame | None = None, pending_limit: int = 80, context: int = 6) -> DataFrame:
    """What is formed from next, for each (scope, episode) with pending events: pending_ids, the first
    pending events; context_ids, the last processed ones and those asked for, the newest `context` of
    them; node_ids, the episode's current nodes and the identities of all these events' speakers;
    edge_ids, the edges with both ends among the nodes. All are arrays in log order.

    events: scope, episode, id, seq, speaker, processed; nodes: scope, episode, id, seq, status, stage,
    speaker_id (null unless an identity); edges: scope, id, source, target; explicit: scope, episode, id
    of processed events that the caller sees; those not before the first pending event are left out.
    """
    key = ["scope", "episode"]
    w = Window.partitionBy(*key)
    p = events.where("NOT processed").withColumn("_r", F.row_number().over(w.orderBy("seq"))).where(F.col("_r") <= pending_limit)
    c = events.where("processed").select(*key, "id", "seq", "speaker")
    if explicit is not None:
        first = p.groupBy(*key).agg(F.min("seq").alias("_first"))
        asked = explicit.select("scope", F.col("episode").alias("_for"), "id").join(c.drop("episode"), ["scope", "id"]).withColumnRenamed("_for", "episode")
        asked = asked.join(first, key).where("seq < _first").select(*key, "id", "seq", "speaker")
        latest = c.withColumn("_r", F.row_number().over(w.orderBy(F.desc("seq")))).where(F.col("_r") <= context).drop("_r")
        c = latest.unionByName(asked).dropDuplicates([*key, "id"])
    c = c.withColumn("_r", F.row_number().over(w.orderBy(F.desc("seq")))).where(F.col("_r") <= context)
    heard = p.select(*key, "speaker").unionByName(c.select(*key, "speaker")).join(p.select(*key).distinct(), key, "left_semi").distinct()
    identities = nodes.where("speaker_id IS NOT NULL").select("scope", F.col("speaker_id").alias("speaker"), F.col("episode").alias("_of"), "id", "seq", "stage")
    known = heard.join(identities, ["scope", "speaker"]).where((F.col("stage") == "LONG_TERM") | (F.col("_of") == F.col("episode"))).select(*key, "id", "seq")
    known = known.unionByName(nodes.where("status = 'CURRENT'").select(*key, "id", "seq")).distinct()
    ends = known.select(*key, "id")
    within = edges.select("scope", F.col("id").alias("edge"), "source", "target").join(ends.withColumnRenamed("id", "source"), ["scope", "source"]).join(ends.withColumnRenamed("id", "target"), [*key, "target"])
    within = within.select(*key, F.col("edge").alias("id"), F.lit(0).alias("seq"))

    def ids(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*key).agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "id"))), lambda x: x["id"]).alias(name))
    out, empty = ids(p, "pending_ids"), F.array().cast(EMPTY)
    for df, name in ((c, "context_ids"), (known, "node_ids"), (within, "edge_ids")):
        out = out.join(ids(df, name), key, "left").withColumn(name, F.coalesce(name, empty))
    return out


def consolidation_errors(decisions: DataFrame, temporaries: DataFrame, memories: DataFrame) -> DataFrame:
    """One decision (run_id, id, action, targets) per temporary (run_id, id); MERGE targets exactly the
    memories (run_id, key, used) that use it, others have none; a memory uses some merged one."""
    d = decisions.groupBy("run_id", "id").agg(F.count("*").alias("_n"))
    cover = temporaries.withColumn("_t", F.lit(True)).join(d, ["run_id", "id"], "full_outer")
    rule = F.when(F.col("_t").isNull(), "foreign").when(F.col("_n").isNull(), "undecided").when(F.col("_n") > 1, "decided_twice")
    out = cover.withColumn("rule", rule).where("rule IS NOT NULL").select("run_id", "rule", F.col("id").alias("key"))
    merge = F.col("action") == "MERGE"
    form = decisions.where((merge & (F.size("targets") == 0)) | (~merge & (F.size("targets") > 0)) | (F.size("targets") != F.size(F.array_distinct("targets"))))
    claims = decisions.where(merge).select("run_id", "id", F.explode("targets").alias("key"))
    uses = memories.select("run_id", "key", F.explode("used").alias("id")).join(temporaries.select("run_id", "id"), ["run_id", "id"], "left_semi")
    unclaimed = uses.join(claims, ["run_id", "id", "key"], "left_anti")
    unused = claims.join(uses, ["run_id", "id", "key"], "left_anti")
    rootless = memories.join(uses.select("run_id", "key").distinct(), ["run_id", "key"], "left_anti")
    return out.unionByName(_found(form, "targets", "id")).unionByName(_found(unclaimed, "use_without_merge")).unionByName(_found(unused, "merge_without_use", "id")).unionByName(_found(rootless, "no_temporary"))


def apply_consolidation(nodes: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes with stage and status after KEEP, MERGE, ARCHIVE or DEFER, episodes with their new status:
    SEALED while temporaries remain, else CONSOLIDATED)."""
    out = nodes.join(decisions.select("id", "action"), "id", "left")
    stage = F.when(F.col("action") == "KEEP", "LONG_TERM").when(F.col("action").isin("MERGE", "ARCHIVE"), "ARCHIVED").when((F.col("stage") == "TEMPORARY") & (F.col("status") == "SUPERSEDED"), "ARCHIVED").otherwise(F.col("stage"))
    status = F.when(F.col("action") == "MERGE", "CONSOLIDATED").otherwise(F.col("status"))
    out = out.withColumns({"stage": stage, "status": status}).drop("action")
    left = out.groupBy("scope", "episode").agg(F.count_if(F.col("stage") == "TEMPORARY").alias("temporaries"))
    return out, left.withColumn("episode_status", F.when(F.col("temporaries") > 0, "SEALED").otherwise("CONSOLIDATED"))


def promotion_closure(kept: DataFrame, memories: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Ids to promote: kept memories (id), subjects of new ones (subject), ends of edges, and the
    subjects of all these."""
    ids = kept.select("id").unionByName(memories.select(F.col("subject").alias("id"))).unionByName(edges.select(F.col("source").alias("id"))).unionByName(edges.select(F.col("target").alias("id"))).where("id IS NOT NULL").distinct()
    subjects = nodes.join(ids, "id", "left_semi").where("subject IS NOT NULL").select(F.col("subject").alias("id"))
    return ids.unionByName(subjects).distinct()


def published_edges(retained: DataFrame, edges: DataFrame) -> DataFrame:
    """(edge_id, write_id) of retained record ids (write_id, edge_ids) that exist."""
    r = retained.select("write_id", F.explode("edge_ids").alias("id")).distinct()
    return r.join(edges.select("id"), "id", "left_semi").select(F.col("id").alias("edge_id"), "write_id")


def span_references(evidence: DataFrame, events: DataFrame) -> DataFrame:
    """(key, event_id, start, end): the first occurrence of the quote in its event, in characters."""
    joined = evidence.join(events.select(F.col("id").alias("event_id"), "text"), "event_id").where("instr(text, quote) > 0")
    return joined.select("key", "event_id", (F.instr("text", F.col("quote")) - 1).alias("start"), (F.instr("text", F.col("quote")) - 1 + F.char_length("quote")).alias("end"))


def selective_context(chosen: DataFrame, nodes: DataFrame, edges: DataFrame, evidence: DataFrame, events: DataFrame) -> DataFrame:
    """(id, role): chosen temporaries (id), their subjects, entities one edge away from these, the events
    that the chosen cite, and as context the reply targets of these events and what the other nodes
    cite, wherever it is. nodes: id, type, subject; evidence: key, event_id; events: id, reply_to."""
    c = chosen.select("id").distinct()
    subjects = nodes.join(c, "id", "left_semi").where("subject IS NOT NULL").select(F.col("subject").alias("id")).distinct()
    both = edges.select(F.col("source").alias("id"), F.col("target").alias("other")).unionByName(edges.select(F.col("target").alias("id"), F.col("source").alias("other")))
    entities = nodes.where("type <> 'MEMORY'").select("id")
    near = both.join(subjects.unionByName(c), "id", "left_semi").select(F.col("other").alias("id")).distinct()
    bridges = near.join(entities, "id", "left_semi").join(subjects, "id", "left_anti")
    cites = evidence.select(F.col("key").alias("id"), "event_id")
    cited = cites.join(c, "id", "left_semi").select(F.col("event_id").alias("id")).distinct()
    replied = events.join(cited, "id", "left_semi").where("reply_to IS NOT NULL").select(F.col("reply_to").alias("id"))
    foreign = cites.join(subjects.unionByName(bridges), "id", "left_semi").select(F.col("event_id").alias("id"))
    context = replied.unionByName(foreign).distinct().join(events.select("id"), "id", "left_semi").join(cited, "id", "left_anti")
    def named(df: DataFrame, role: str) -> DataFrame:
        return df.select("id", F.lit(role).alias("role"))
    return named(c, "temporary").unionByName(named(subjects, "subject")).unionByName(named(bridges, "bridge")).unionByName(named(cited, "event")).unionByName(named(context, "context"))


def changed_sources(before: DataFrame, now: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Keys of `before` whose row is gone or has another content now; null equals null."""
    def hashed(df: DataFrame, name: str) -> DataFrame:
        return df.select(*key, F.sha2(F.to_json(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in columns])), 256).alias(name))
    joined = hashed(before, "_a").join(hashed(now, "_b"), key, "left")
    return joined.where(~F.col("_a").eqNullSafe(F.col("_b"))).select(*key, F.when(F.col("_b").isNull(), "gone").otherwise("changed").alias("change"))


def close_episodes(episodes: DataFrame, events: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(episodes with their new status, refused because of unprocessed events, nodes promoted).

    An OPEN episode becomes CLOSED if its lifecycle is legacy, and its nodes LONG_TERM; SEALED if they
    await consolidation. Others stay as they are. episodes: scope, episode, lifecycle, episode_status."""
    key = ["scope", "episode"]
    busy = events.where("NOT processed").select(*key).distinct()
    refused = episodes.where("episode_status = 'OPEN'").join(busy, key, "left_semi")
    done = F.when(F.col("episode_status") != "OPEN", F.col("episode_status")).when(F.col("lifecycle") == "legacy", "CLOSED").otherwise("SEALED")
    ready = episodes.join(refused.select(*key), key, "left_anti").withColumn("_was", F.col("episode_status")).withColumn("episode_status", done)
    legacy = ready.where("lifecycle = 'legacy' AND _was = 'OPEN'").select(*key)
    return ready.drop("_was"), refused, nodes.join(legacy, key, "left_semi").withColumn("stage", F.lit("LONG_TERM"))


def reopen_episodes(episodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(episodes open again, refused): only SEALED episodes that await consolidation take events again."""
    sealed = (F.col("lifecycle") == "consolidate") & (F.col("episode_status") == "SEALED")
    may = F.coalesce(sealed, F.lit(False))
    return episodes.where(may).withColumn("episode_status", F.lit("OPEN")), episodes.where(~may)
