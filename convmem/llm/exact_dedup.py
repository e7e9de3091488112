"""Exact deduplication over an extendible-hash index kept in shared files."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window, functions as F

from convmem.plans.joins import join_checked, own_names
from convmem.plans.scratch import ScratchTables, scratch

#: Directory entries are at most 2 ** MAX_DEPTH, whatever the input's size. Where BUCKET_KEYS would
#: need more, buckets may hold more keys: twice the keys a directory entry has on average.
MAX_DEPTH = 12
#: A bucket with more distinct keys than this is split.
BUCKET_KEYS = 4_096


def directory(histogram: list[int], capacity: int) -> list[int]:
    """The directory after all splits: entry i is the bucket that owns hash prefix i.

    histogram has the number of distinct keys for each prefix of MAX_DEPTH bits. Starting from
    one bucket of depth 0, an overfull bucket is split by its next bit (the directory doubles
    when its depth is the global one) until every bucket fits or has used all bits; buckets
    are numbered in key order, so each is a contiguous key range.
    """
    total = [0]
    for n in histogram:
        total.append(total[-1] + n)
    entries: list[int] = []
    todo, bucket = [(0, len(histogram))], 0
    while todo:
        low, high = todo.pop()
        if high - low > 1 and total[high] - total[low] > capacity:
            middle = (low + high) // 2
            todo += [(middle, high), (low, middle)]
            continue
        entries += [bucket] * (high - low)
        bucket += 1
    return entries


def _prefix(h: str) -> Column:
    return F.shiftrightunsigned(h, 64 - MAX_DEPTH).cast("int")


def owners(buckets: list[int], rows: list[int], most: int) -> tuple[list[int], list[int]]:
    """(first owner, number of owners) of each bucket: one owner task for each `most` rows, so that a
    bucket with a hot key has several."""
    held = [0] * (buckets[-1] + 1)
    for bucket, n in zip(buckets, rows, strict=True):
        held[bucket] += n
    number = [max(1, -(-n // most)) for n in held]
    return [0, *accumulate(number)][:-1], number


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalised: Column | None = None, capacity: int = BUCKET_KEYS) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    normalised is the text that must be equal byte for byte (default: the text itself). The
    row with the largest id of each group is kept.

    1. Entries (id, 64-bit hash, SHA-256, row number) are written to the shared folder.
    2. Keys (hash, SHA-256) are pre-aggregated in the reading tasks. Counts of keys and rows by hash
       prefix (at most 2 ** 12 numbers) give the directory: prefix -> bucket, doubled and split
       until buckets fit. A bucket with many rows, as one with a hot key, gets several owners.
    3. Texts whose 64-bit hash occurs more than once are compared byte for byte (grouped on the
       bytes, combined in the reading tasks); the different texts of one hash are chained: each
       has a number, and (hash, SHA-256) must name one of them only.
    4. The index (bucket, hash, chain number -> row to keep, rows) is written in key order.
    5. Entries are dealt to the owners of their bucket, and so is the bucket's part of the index; in
       each owner task, in key order, an entry takes what its chain has in the index.

    Null text counts as empty; a null id is smaller than any id (a group of null ids keeps one
    row with a null keep_id). Rows repeated with one id are copies: exactly one stays. Ties do
    not occur otherwise. Empty table: no rows. Further columns are ignored.
    """
    text = F.coalesce(normalised if normalised is not None else F.col(text_col), F.lit(""))
    tables = ScratchTables()
    keyed = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_h"), F.unhex(F.sha2(text, 256)).alias("_sha"), F.monotonically_increasing_id().alias("_row"))
    entries = tables.write(keyed, "dedup-entries")

    keys = tables.write(entries.groupBy("_h", "_sha").agg(F.max(F.struct("_id", "_row")).alias("_keep"), F.count("*").alias("_n")), "dedup-keys")
    counts = {r["p"]: (r["k"], r["n"]) for r in keys.groupBy(_prefix("_h").alias("p")).agg(F.count("*").alias("k"), F.sum("_n").alias("n")).collect()}  # 4096 rows at most
    held = [counts.get(p, (0, 0)) for p in range(2**MAX_DEPTH)]
    capacity = max(capacity, -(-2 * sum(k for k, _ in held) // 2**MAX_DEPTH))
    buckets = directory([k for k, _ in held], capacity)
    first, number = owners(buckets, [n for _, n in held], 2 * capacity)
    bucket = F.element_at(F.lit(buckets), _prefix("_h") + 1)
    first_owner, of = F.element_at(F.lit(first), bucket + 1), F.element_at(F.lit(number), bucket + 1)

    suspects = tables.write(keys.groupBy("_h").agg(F.sum("_n").alias("_all")).where("_all > 1").select("_h"), "dedup-suspects")
    texts = docs.select(text.alias("_t"), F.xxhash64(text).alias("_h"))
    compared = join_checked(texts, suspects, "_h", "left_semi").groupBy("_h", "_t").agg(F.count("*").alias("_same"))
    compared = compared.select("_h", F.unhex(F.sha2("_t", 256)).alias("_sha"), "_same")
    chained = compared.groupBy("_h", "_sha").agg(F.sum("_same").alias("_same"), F.count("*").alias("_texts"))
    chained = chained.withColumn("_chain", F.row_number().over(Window.partitionBy("_h").orderBy("_sha")) - 1)

    index = keys.join(chained, ["_h", "_sha"], "left").select(
        bucket.alias("bucket"), "_h", F.coalesce("_chain", F.lit(0)).alias("_chain"), "_sha", "_keep",
        F.when(F.coalesce("_texts", F.lit(1)) > 1, F.raise_error(F.lit("two texts share a 64-bit hash and a SHA-256")).cast("bigint")).otherwise(F.coalesce("_same", "_n")).alias("_n"),
    )
    index = tables.write(index.repartitionByRange("bucket", "_h").sortWithinPartitions("bucket", "_h", "_chain"), "dedup-index")
    tables.drop_all_but(entries, index)

    held_by = index.select(F.explode(F.sequence(first_owner, first_owner + of - 1)).alias("_owner"), "_h", "_sha", F.struct("_keep", "_n", "_chain").alias("_found"))
    asked = entries.select((first_owner + F.pmod(F.xxhash64("_row"), of).cast("int")).alias("_owner"), "_h", "_sha", "_id", "_row")
    dealt = held_by.unionByName(asked, allowMissingColumns=True).repartition("_owner")
    in_order = Window.partitionBy("_owner", "_h", "_sha").orderBy(F.col("_found").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = dealt.withColumn("_in", F.first("_found", ignorenulls=True).over(in_order)).where("_found IS NULL")
    return found.select(
        F.col("_id").alias(id_col), F.col("_in._keep._id").alias("keep_id"), F.col("_in._n").alias("group_size"),
        (F.col("_in._keep._row") == F.col("_row")).alias("kept"), F.lower(F.hex("_sha")).alias("text_sha256"),
    )


def keep_first_rows(docs: DataFrame, decisions: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalised: Column | None = None) -> DataFrame:
    """The rows of docs that exact_dedup keeps, with all their columns.

    Rows are found by (id, SHA-256), both written out; the dropped minority is taken out by an
    anti-join. Where one id repeats a text, one of those rows stays.
    """
    text = F.coalesce(normalised if normalised is not None else F.col(text_col), F.lit(""))
    (key,) = own_names(docs.columns, "key")
    named = F.when(F.col(id_col).isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col(id_col).cast("string")))
    tagged = docs.withColumn(key, F.concat(F.sha2(text, 256), named))
    decided = decisions.select(F.concat(F.col("text_sha256"), named).alias(key), F.col("kept").alias("_kept"))
    # Kept keys come once each; a key that is kept and dropped belongs to repeated rows.
    state = scratch(decided.groupBy(key).agg(F.max("_kept").alias("_kept"), F.count("*").alias("_n")).where("NOT _kept OR _n > 1"), "dedup-dropped")
    repeated = state.where("_kept AND _n > 1").select(key)
    rest = join_checked(tagged, state.select(key), key, "left_anti")
    once = join_checked(tagged, repeated, key, "left_semi").dropDuplicates([key])
    return rest.unionByName(once).drop(key)
