"""A corpus pipeline of five stages: language, exact copies, near copies, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all but
the last return the columns of `documents`.

All stages take docs of any size: an empty table gives an empty one; columns beyond those of `documents`
are dropped at once, so names cannot clash; null ids are documents of their own. What each does with
null or empty texts, ties and repeated rows is said there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from convmem.llm.batches import bound_batches
from convmem.llm.exact_dedup import exact_dedup, keep_first_rows
from convmem.llm.language_id import fit, with_language
from convmem.llm.near_dedup import near_dedup
from convmem.llm.packing import pack_documents
from convmem.llm.spans import span_dedup
from convmem.plans.joins import join_checked
from convmem.plans.scratch import scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose language cannot be told (no text, or no letter in it). `lang`
    stays as given; where it is null the prediction is filled in (of equally likely languages the
    first by name). Repeated rows are judged alike."""
    bound_batches(spark)
    docs = docs.select(*COLUMNS)
    return with_language(docs, fit(docs, "text", "lang"), "text", "lang")


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays, and of rows that repeat it one; null and
    empty texts are equal."""
    docs = docs.select(*COLUMNS)
    return keep_first_rows(docs, exact_dedup(docs)).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8 or more) the document with the
    smallest doc_id stays; rows that share an id are one document. Null and wordless texts, and rows
    without an id, stay."""
    bound_batches(spark)
    docs = docs.select(*COLUMNS)
    decided = near_dedup(docs, k=5, percent=80)
    dropped = scratch(decided.where("NOT kept").select("doc_id").distinct(), "pipeline-near")
    return join_checked(docs, dropped, "doc_id", "left_anti").select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of sentences that an earlier document has are cut out of the text, and n_chars is counted
    anew (null for null). All documents stay, though a text may become empty; rows that repeat id and
    text lose nothing to each other."""
    bound_batches(spark)
    clean = span_dedup(docs.select(*COLUMNS))
    return clean.withColumn("n_chars", F.char_length("text").cast("bigint")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into sequences of at most 2048 tokens; null and empty texts are one token, and
    repeated rows are packed each."""
    bound_batches(spark)
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language", by_language),
    ("exact copies", exact_copies),
    ("near copies", near_copies),
    ("repeated passages", repeated_passages),
    ("packing", packed),
]

#: No SQL: packing and language identification have none. The stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
