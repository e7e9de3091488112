"""Quality rules: a decision list learned from labelled statistics, applied as Spark conditions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from convmem.plans.scratch import scratch

_SPACES = " \t\n\x0b\f\r"
_SPLIT = r"[\x20\x09-\x0D]+"
#: Thresholds tried for each feature: quantiles of the labelled rows.
THRESHOLDS = 24


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def base_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and the counts of whole texts that all rules are built from, by built-in functions only.

    n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words are as the query's contract
    has them; n_upper, n_digits, n_marks and n_lines serve further ratios. Repeated 3-word windows
    are found by sorting a text's (window hash, position) pairs, so that a long text costs
    n log n; their words are the union of the intervals of three words.

    Null text counts as empty: all counts are 0.
    """
    t = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    t = t.withColumn("_w", F.filter(F.split("_t", _SPLIT), lambda w: w != "")).withColumn("n_words", F.size("_w").cast("bigint"))
    # Each word is hashed once; a window is the hash of three of these.
    t = t.withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w)))
    later = lambda k: F.slice("_h", F.lit(k), F.greatest(F.size("_h") - (k - 1), F.lit(0)))
    pairs = F.zip_with("_h", later(2), lambda a, b: F.xxhash64(a, b))
    threes = F.zip_with(pairs, later(3), lambda p, c: F.xxhash64(p, c))
    windows = F.transform(F.slice(threes, F.lit(1), F.greatest(F.size("_h") - 2, F.lit(0))), lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    t = t.withColumn("_s", F.sort_array(windows))
    same = lambda x, i: F.coalesce((F.get("_s", i - 1)["h"] == x["h"]) | (F.get("_s", i + 1)["h"] == x["h"]), F.get("_s", i - 1)["h"] == x["h"], F.get("_s", i + 1)["h"] == x["h"], F.lit(False))
    t = t.withColumn("_p", F.sort_array(F.transform(F.filter("_s", same), lambda x: x["i"])))
    covered = F.aggregate(
        "_p", F.struct(F.lit(-3).alias("last"), F.lit(0).cast("bigint").alias("n")),
        lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")), lambda a: a["n"],
    )
    t = t.withColumn("_l", F.filter(F.split("_t", "\n"), lambda x: _without(x, _SPACES) != ""))
    whole = F.char_length("_t")
    return t.select(
        "_id", "n_words", F.char_length(_without(F.col("_t"), _SPACES)).cast("bigint").alias("word_chars"),
        (whole - F.char_length(_without(F.col("_t"), "#*$%&|<>"))).cast("bigint").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("bigint").alias("n_dup_lines"), covered.alias("n_repeat_words"),
        (whole - F.char_length(_without(F.col("_t"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))).cast("bigint").alias("n_upper"),
        (whole - F.char_length(_without(F.col("_t"), "0123456789"))).cast("bigint").alias("n_digits"),
        (whole - F.char_length(_without(F.col("_t"), "!?"))).cast("bigint").alias("n_marks"), F.size("_l").cast("bigint").alias("n_lines"),
    )


def ratios() -> dict[str, Column]:
    """Features of the rules, from the counts: mostly shares, so that length alone decides little."""
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return {
        "words": F.col("n_words").cast("double"), "word_length": F.col("word_chars") / words, "symbol_share": F.col("n_symbols") / chars,
        "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)), "repeat_share": F.col("n_repeat_words") / words,
        "upper_share": F.col("n_upper") / chars, "digit_share": F.col("n_digits") / chars, "mark_share": F.col("n_marks") / words,
        "words_per_line": F.col("n_words") / F.greatest(F.col("n_lines"), F.lit(1)),
    }


@dataclass(frozen=True)
class Condition:
    """feature >= threshold, or feature < threshold. bin is the threshold's number among those tried."""

    feature: str
    above: bool
    threshold: float
    bin: int = 0

    def column(self) -> Column:
        return F.col(self.feature) >= self.threshold if self.above else F.col(self.feature) < self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.threshold!r}"


Rule = tuple[Condition, ...]


def _all(rule: Rule) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & c.column()
    return out


def _any(rules: list[Rule]) -> Column:
    out = F.lit(False)
    for rule in rules:
        out = out | _all(rule)
    return out


def _value(bad: float, good: float) -> float:
    """Precision, smoothed and weighed down where few rows are covered."""
    return (bad + 0.5) / (bad + good + 1) * (bad / (bad + 5))


def _histogram(rows: DataFrame, features: list[str]) -> dict[tuple[str, int], tuple[int, int]]:
    """(low-quality, high-quality) rows by feature and bin, in one aggregation."""
    named = F.array(*[F.struct(F.lit(f).alias("f"), F.col(f"_bin_{f}").alias("b")) for f in features])
    counts = rows.select(F.explode(named).alias("_x"), "_bad").groupBy("_x.f", "_x.b").agg(F.sum("_bad").alias("bad"), F.count("*").alias("n"))
    return {(r["f"], r["b"]): (r["bad"], r["n"] - r["bad"]) for r in counts.collect()}


def _best(rows: DataFrame, cuts: dict[str, list[float]], used: Rule) -> tuple[float, Condition] | None:
    """The condition that gives the highest value on rows, from running sums over the bins."""
    counts = _histogram(rows, list(cuts))
    best: tuple[float, int, Condition] | None = None
    for i, (feature, thresholds) in enumerate(cuts.items()):
        bins = [counts.get((feature, b), (0, 0)) for b in range(len(thresholds) + 1)]
        total = (sum(b for b, _ in bins), sum(g for _, g in bins))
        below = (0, 0)
        for b, t in enumerate(thresholds):
            below = (below[0] + bins[b][0], below[1] + bins[b][1])
            for above, (bad, good) in ((True, (total[0] - below[0], total[1] - below[1])), (False, below)):
                c = Condition(feature, above, t, b)
                if c not in used and (best is None or (_value(bad, good), -i) > best[:2]):
                    best = (_value(bad, good), -i, c)
    return (best[0], best[2]) if best else None


def learn(labelled: DataFrame, features: list[str], max_rules: int = 6, max_conditions: int = 3, precision: float = 0.9) -> list[Rule]:
    """An ordered list of conjunctions, each of which rejects; what none holds for is kept.

    labelled has the features, _bad (1: low quality) and _prune (true for the third of the rows
    on which rules are pruned). Sequential covering: a rule grows by the condition that raises its
    value most, loses its last conditions as long as that does not hurt on the pruning rows, and is
    taken if it keeps the asked precision there; then the rows it covers are set aside. All
    statistics are aggregations over the labelled rows by feature and bin: the driver sees a few
    hundred counts a step, however many rows there are.
    """
    spots = [i / THRESHOLDS for i in range(1, THRESHOLDS)]
    found = labelled.agg(*[F.percentile_approx(f, spots, 2000).alias(f) for f in features], *[F.percentile_approx(F.when(F.col("_bad") == 1, F.col(f)), spots, 2000).alias(f"_bad_{f}") for f in features]).first()
    if found[features[0]] is None:
        return []
    cuts = {f: sorted({*map(float, found[f]), *map(float, found[f"_bad_{f}"] or [])}) for f in features}
    bins = [sum((F.when(F.col(f) >= t, 1).otherwise(0) for t in ts), F.lit(0)).alias(f"_bin_{f}") for f, ts in cuts.items()]
    binned = scratch(labelled.select(*features, "_bad", "_prune", *bins), "quality-binned")
    rules: list[Rule] = []
    while len(rules) < max_rules:
        left = binned.where(~_any(rules))
        growing, pruning = left.where("NOT _prune"), left.where("_prune")
        rule: Rule = ()
        value = 0.0
        while len(rule) < max_conditions and (found := _best(growing.where(_all(rule)), cuts, rule)):
            if found[0] <= value + 1e-3:
                break
            value, rule = found[0], (*rule, found[1])
        if not rule:
            break
        held = [_all(rule[:n]) for n in range(1, len(rule) + 1)]
        sums = pruning.agg(*[F.sum(F.when(h, F.col("_bad"))).alias(f"b{i}") for i, h in enumerate(held)], *[F.count_if(h).alias(f"n{i}") for i, h in enumerate(held)]).first()
        kept = [(sums[f"b{i}"] or 0, (sums[f"n{i}"] or 0) - (sums[f"b{i}"] or 0)) for i in range(len(held))]
        chosen = max(range(len(kept)), key=lambda i: (_value(*kept[i]), -i))
        bad, good = kept[chosen]
        if bad < 3 or bad < precision * (bad + good):
            break
        rules.append(rule[: chosen + 1])
    return rules


def verdicts(rules: list[Rule]) -> Column:
    """The ordered conditional expression: the number of the first rule that rejects, else null."""
    out = F.when(F.lit(False), F.lit(0))
    for i, rule in enumerate(rules, 1):
        out = out.when(_all(rule), F.lit(i))
    return out


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, rule.

    base_failed: fewer than 50 words, or more than half the words in repeated 3-word windows.
    Other rows are rejected by the first rule of the learned list that holds (rule is its
    number), and kept if none does.

    The counts of all texts are written once as a narrow table; learning reads those of labelled
    rows (quality 0 or 1) that pass the base. Without labels, or without a rule that is precise
    enough, every row that passes the base is kept. Null text counts as empty. Null ids and ids
    without a label are judged but not learned from; an id labelled twice counts twice. Repeated
    rows are judged alike. Empty table: no rows. Further columns are ignored.
    """
    counted = scratch(base_features(docs, id_col, text_col), "quality-counts")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    named = counted.withColumn("base_failed", failed).withColumns(ratios())
    known = labels.where("quality IN (0, 1)").select(F.col(id_col).alias("_id"), (1 - F.col("quality")).alias("_bad"))
    features = list(ratios())
    rows = named.where("NOT base_failed").join(known, "_id").select(*features, "_bad", (F.crc32(F.col("_id").cast("string")) % 3 == 0).alias("_prune"))
    rules = learn(scratch(rows, "quality-labelled"), features)
    rule = F.when(F.col("base_failed"), F.lit(0)).otherwise(verdicts(rules))
    return named.withColumn("rule", rule).select(
        F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.col("rule").isNull().alias("kept"), "rule",
    )
