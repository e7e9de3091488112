"""Hooks for models: embedding, reranking and routing scores, each with a deterministic default."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from convmem.operators.lexical import cosine

#: Dimension of the default embedding.
DIMENSION = 32


@F.pandas_udf(T.ArrayType(T.FloatType()))
def hashed_vector(text: pd.Series) -> pd.Series:
    """The bytes of the text's SHA-256 less 127, scaled to length 1; null for null."""

    def one(value: str | None):
        if value is None:
            return None
        v = np.frombuffer(hashlib.sha256(value.encode()).digest(), np.uint8).astype(np.float64) - 127
        return (v / np.linalg.norm(v)).astype(np.float32)

    return text.map(one)


def embed(texts: DataFrame, text_col: str = "text", limit: int = 512, function=hashed_vector) -> DataFrame:
    """Adds vector and truncated (the text was longer than limit characters). `function` is any
    column function from text to array<float>."""
    return texts.withColumns({"vector": function(F.substring(F.col(text_col), 1, limit)), "truncated": F.char_length(text_col) > limit})


def rerank(pairs: DataFrame, function=None) -> DataFrame:
    """Adds score to (query, text) pairs; default: the lexical cosine, by joins."""
    if function is None:
        return cosine(pairs)
    return pairs.withColumn("score", function(F.col("query"), F.col("text")))


def route_scores(scored: DataFrame, scale: float = 1.0) -> DataFrame:
    """(target, episode, score) to (target, p_new, scores): the default squashes the best topic
    score into a probability of a new topic."""
    best = scored.groupBy("target").agg(F.max("score").alias("best"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("episode", "score")))).alias("scores"))
    return best.select("target", (1 / (1 + F.exp((F.col("best") - 0.5) * (8 * scale)))).alias("p_new"), "scores")


def is_probability(score: Column) -> Column:
    return score.isNotNull() & ~F.isnan(score) & score.between(0, 1)
