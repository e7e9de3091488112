"""Reading for a current state: state checks, gates, judgments and bounded packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

UTILITIES = ("NONE", "ASSOCIATIVE_ONLY", "USEFUL_CONTEXT", "NECESSARY_CONTEXT")


def state_violations(states: DataFrame) -> DataFrame:
    """(qid, violations) of state messages (qid, pos, id, speaker, t, text, focus): 1 to 8 messages,
    unique ids, times that do not decrease, texts of at most 1200 characters and 2000 in all,
    and a focus among the speakers."""
    w = Window.partitionBy("qid").orderBy("pos")
    m = states.withColumn("_back", F.coalesce(F.col("t") < F.lag("t").over(w), F.lit(False)))
    g = m.groupBy("qid").agg(
        F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.max("_back").alias("back"), F.max(F.char_length("text")).alias("longest"),
        F.sum(F.char_length("text")).alias("total"), F.max(F.col("focus").isNull() | (F.col("speaker") == F.col("focus"))).alias("focused"),
    )
    named = [("count", F.col("n") > 8), ("ids", F.col("ids") < F.col("n")), ("order", F.col("back")), ("text", F.col("longest") > 1200), ("total", F.col("total") > 2000), ("focus", ~F.col("focused"))]
    return g.select("qid", F.filter(F.array(*[F.when(c, F.lit(x)) for x, c in named]), lambda x: x.isNotNull()).alias("violations"))


def past_only(states: DataFrame, events: DataFrame) -> DataFrame:
    """(qid, past_only): false if an event of the scope is at or after the state's earliest time.
    states: qid, scope, t."""
    first = states.groupBy("qid", "scope").agg(F.min("t").alias("_first"))
    last = events.groupBy("scope").agg(F.max("t").alias("_last"))
    return first.join(last, "scope", "left").select("qid", F.coalesce(F.col("_last") < F.col("_first"), F.lit(True)).alias("past_only"))


def default_cues(states: DataFrame) -> DataFrame:
    """(qid, cue, text, weight): the focus speaker .35 and the last message's text .65; without a
    focus the text alone."""
    last = states.groupBy("qid").agg(F.max_by("text", "pos").alias("text"), F.max("focus").alias("focus"))
    two = F.array(F.struct(F.lit(1).alias("cue"), F.col("focus").alias("text"), F.lit(0.35).alias("weight")), F.struct(F.lit(2).alias("cue"), F.col("text"), F.lit(0.65).alias("weight")))
    one = F.array(F.struct(F.lit(1).alias("cue"), F.col("text"), F.lit(1.0).alias("weight")))
    return last.select("qid", F.explode(F.when(F.col("focus").isNotNull(), two).otherwise(one)).alias("c")).select("qid", "c.*")


def cue_sums(cues: DataFrame) -> DataFrame:
    """(qid, ok): 1 to 3 cues whose weights sum to 1 within 1e-6."""
    g = cues.groupBy("qid").agg(F.count("*").alias("n"), F.sum("weight").alias("s"))
    return g.select("qid", (F.col("n").between(1, 3) & (F.abs(F.col("s") - 1) <= 1e-6)).alias("ok"))


def current_results(results: DataFrame, scopes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(results of the scope's present revision, the others)."""
    joined = results.join(scopes.select("scope", F.col("revision").alias("_now")), "scope", "left")
    fresh = F.coalesce(F.col("revision") == F.col("_now"), F.lit(False))
    return joined.where(fresh).drop("_now"), joined.where(~fresh).drop("_now")


def readable_scopes(scopes: DataFrame, intake: DataFrame) -> DataFrame:
    """Scopes without an intake row that is neither DONE nor ARCHIVED."""
    busy = intake.where(~F.col("status").isin("DONE", "ARCHIVED")).select("scope").distinct()
    return scopes.join(busy, "scope", "left_anti")


def judgment_requests(candidates: DataFrame, past: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(candidate sources found, problems). candidates: qid, candidate_id, refs; past: qid, id.
    References must be there, unique, and exist in the past log."""
    refs = candidates.select("qid", "candidate_id", F.explode("refs").alias("id"))
    found = refs.join(past.select("qid", "id"), ["qid", "id"]).select("qid", "candidate_id", "id").distinct()
    missing = refs.join(past.select("qid", "id"), ["qid", "id"], "left_anti").select("qid", "candidate_id", F.lit("unknown_source").alias("problem"))
    empty = candidates.where(F.size("refs") == 0).select("qid", "candidate_id", F.lit("no_source").alias("problem"))
    twice = candidates.where(F.size("refs") != F.size(F.array_distinct("refs"))).select("qid", "candidate_id", F.lit("repeated_source").alias("problem"))
    return found, missing.unionByName(empty).unionByName(twice).distinct()


def accepted(utility: Column, support: Column, policy: Column) -> Column:
    """Useful or necessary, supported, and not excluded from use."""
    return utility.isin("USEFUL_CONTEXT", "NECESSARY_CONTEXT") & (support == "SUPPORTED") & (policy != "DO_NOT_USE")


def apply_judgments(candidates: DataFrame, judgments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(judgments with accepted and disclosure_authorized (always false), problems). Each candidate
    (qid, candidate_id) is judged exactly once; anchors are unique and there where it is useful."""
    n = judgments.groupBy("qid", "candidate_id").agg(F.count("*").alias("_n"))
    cover = candidates.select("qid", "candidate_id", F.lit(True).alias("_c")).join(n, ["qid", "candidate_id"], "full_outer")
    rule = F.when(F.col("_c").isNull(), "foreign").when(F.col("_n").isNull(), "unjudged").when(F.col("_n") > 1, "judged_twice")
    problems = cover.withColumn("problem", rule).where("problem IS NOT NULL").select("qid", "candidate_id", "problem")
    useful = F.col("utility").isin("USEFUL_CONTEXT", "NECESSARY_CONTEXT")
    anchors = F.when(F.size("anchors") != F.size(F.array_distinct("anchors")), "repeated_anchor").when(useful & (F.size("anchors") == 0), "no_anchor")
    problems = problems.unionByName(judgments.withColumn("problem", anchors).where("problem IS NOT NULL").select("qid", "candidate_id", "problem"))
    out = judgments.withColumns({"accepted": accepted(F.col("utility"), F.col("claim_support"), F.col("mention_policy")), "disclosure_authorized": F.lit(False)})
    return out, problems


def working_context(selected: DataFrame, judgments: DataFrame | None) -> DataFrame:
    """(qid, arm, ids, status) of selected (qid, arm, id, position): what was accepted, in order. A
    query that selected nothing must be in selected with a null id."""
    some = selected.groupBy("qid", "arm").agg(F.count("id").alias("_n"))
    if judgments is None:
        return some.select("qid", "arm", F.array().cast("array<string>").alias("ids"), F.when(F.col("_n") == 0, "EMPTY_NO_CANDIDATES").otherwise("PENDING_SIGNIFICANCE").alias("status"))
    kept = selected.join(judgments.where("accepted").select("qid", F.col("candidate_id").alias("id")), ["qid", "id"], "left_semi")
    ids = kept.groupBy("qid", "arm").agg(F.transform(F.sort_array(F.collect_list(F.struct("position", "id"))), lambda x: x["id"].cast("string")).alias("ids"))
    out = some.join(ids, ["qid", "arm"], "left")
    return out.select("qid", "arm", F.coalesce("ids", F.array().cast("array<string>")).alias("ids"), F.when(F.col("_n") == 0, "EMPTY_NO_CANDIDATES").otherwise("JUDGED_INTERNAL_CONTEXT").alias("status"))


def pack_context(states: DataFrame, memories: DataFrame, budget: int) -> DataFrame:
    """(qid, ids, used, over_state): whole memories in order while the canonical JSON stays within
    the budget. states: qid, state_length (characters of the JSON without memories); memories: qid,
    position, id, length (characters of each one's JSON). A comma parts two memories. A state that
    alone passes the budget packs nothing and is flagged."""
    listed = memories.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("position", "id", F.col("length").cast("bigint").alias("length")))).alias("_l"))
    j = states.join(listed, "qid", "left")
    start = F.struct(F.array().cast("array<string>").alias("ids"), F.col("state_length").cast("bigint").alias("used"))

    def add(a: Column, x: Column) -> Column:
        size = a["used"] + x["length"] + F.when(F.size(a["ids"]) > 0, 1).otherwise(0)
        return F.when(size <= budget, F.struct(F.array_append(a["ids"], x["id"].cast("string")).alias("ids"), size.cast("bigint").alias("used"))).otherwise(a)

    packed = F.aggregate(F.coalesce("_l", F.array().cast(listed.schema["_l"].dataType)), start, add)
    return j.select("qid", packed.alias("_r"), (F.col("state_length") > budget).alias("over_state")).select("qid", F.col("_r.ids").alias("ids"), F.col("_r.used").alias("used"), "over_state")
