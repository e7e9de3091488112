"""The queries of this subpackage, as (spark, sf_dir) -> DataFrame, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from convmem.llm.batches import bound_batches


#: Fixed by the queries' contract: blocks and exceptions by host suffix and path.
URL_RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE of every document, and the digest of what the ids decode to."""
    import public_tokenizers

    from convmem.llm.bpe import encode_documents

    return encode_documents(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base verdict and learned verdict of every document."""
    from convmem.llm.quality import quality_rules

    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity score of every document."""
    from convmem.llm.toxicity import toxicity

    return toxicity(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document."""
    from convmem.llm.language_id import identify

    return identify(_documents(spark, sf_dir))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    import public_tokenizers

    from convmem.llm.packing import pack_documents

    return pack_documents(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op6_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the sentences that an earlier repeated span covers."""
    from convmem.llm.spans import span_dedup

    return span_dedup(_documents(spark, sf_dir).select("doc_id", "text"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal documents; the largest id of each group stays."""
    from convmem.llm.exact_dedup import exact_dedup

    return exact_dedup(_documents(spark, sf_dir))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards by a ring with bounded loads."""
    from convmem.llm.sharding import shard_rows

    return shard_rows(_documents(spark, sf_dir), 40)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's URL, by rules and by the decisions on its aliases."""
    from convmem.llm.url_filter import judge_urls

    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), URL_RULES)


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents linked by 3-word shingles at a Jaccard similarity of 0.85 or more."""
    from convmem.llm.near_dedup import near_dedup

    return near_dedup(_documents(spark, sf_dir), k=3, percent=85)


def op11_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in the token files, and the checksum of its ids as read back."""
    import public_tokenizers

    from convmem.llm.token_files import token_id_table

    table = token_id_table(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return table.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights, scores and ranks of all documents against the benchmark's texts."""
    from convmem.llm.resampling import resample

    return resample(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's form, and the digests of the transformed and the restored text."""
    from convmem.llm.fill_in_middle import fill_in_middle, restored

    made = fill_in_middle(_documents(spark, sf_dir))
    digest = lambda text: F.sha2(text, 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


_OPERATORS = (
    op1_byte_bpe, op2_quality_rules, op3_toxicity, op4_language_id, op5_best_fit_packing, op6_span_dedup, op7_exact_dedup,
    op8_sharding, op9_url_filter, op10_near_dedup, op11_token_ids, op12_resampling, op13_fill_in_middle,
)
QUERIES = {f.__name__: f for f in _OPERATORS}

ORACLE_SQL = {
    "op7_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    "op13_fill_in_middle": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
                 regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM documents),
             h AS (SELECT *, len(u) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
                 CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d),
             c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
                 CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM h),
             p AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:n], '') AS s FROM c)
        SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
               sha256(t) AS restored_sha256 FROM p""",
}
