"""Column functions over message texts."""

from __future__ import annotations

import json
import random
from hashlib import sha256
from xml.parsers import expat

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

#: Fixed patterns of the message format.
FORWARDED = "[合并转发: <?xml"
_LINK, _UNKNOWN, _REPLY = r"\[([^\]]*)\]\([^)]*\)", r"\[UNKNOWN_\d+消息\]", r"\[回复 [^:\n]*:"
TOKEN = r"[a-z0-9_]+|[㐀-鿿]"


@F.pandas_udf(T.StringType())
def forwarded_titles(bundle: pd.Series) -> pd.Series:
    """What a forwarded bundle shows of its messages: the text right in each title element, in the
    order of the document, with ' ; ' between; nested titles are shown on their own, after the one that
    holds them. Broken XML shows nothing; null stays null."""

    def shown(message: str) -> str:
        _, _, xml = message.rstrip().rstrip("]").partition("<?xml")
        titles: list[list[str]] = []
        inside: list[list[str] | None] = []
        reader = expat.ParserCreate()

        def opened(name: str, _: dict) -> None:
            inside.append([] if name == "title" else None)
            if name == "title":
                titles.append(inside[-1])

        def ended(_: str) -> None:
            inside.pop()
            if inside and inside[-1] is not None:
                inside[-1] = None  # what follows a child is not the title's own beginning

        reader.StartElementHandler, reader.EndElementHandler = opened, ended
        reader.CharacterDataHandler = lambda text: inside[-1].append(text) if inside and inside[-1] is not None else None
        try:
            reader.Parse("<?xml" + xml, True)
        except expat.ExpatError:
            return ""
        return " ; ".join("".join(t) for t in titles)

    return bundle.map(shown, na_action="ignore")


def clean_text(text: Column, forwarded: bool = False) -> Column:
    """Keeps the label of links, drops unknown-message marks, shortens reply headers, lower-cases.

    With forwarded, bundles are replaced by their titles first (a Python step for those texts).
    Lower-casing differs from full case folding for a few letters, such as the sharp s.
    """
    if forwarded:
        text = F.when(text.startswith(FORWARDED), forwarded_titles(F.when(text.startswith(FORWARDED), text))).otherwise(text)
    return F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, _LINK, "$1"), _UNKNOWN, ""), _REPLY, "[引用:"))


def _neighbours(items: Column) -> Column:
    """The concatenation of each item with the next one; empty for fewer than two."""
    n = F.greatest(F.size(items) - 1, F.lit(0))
    return F.zip_with(F.slice(items, F.lit(1), n), F.slice(items, F.lit(2), n), lambda a, b: F.concat(a, b))


def bigrams(text: Column) -> Column:
    """Distinct pairs of neighbouring characters that are not both blank; empty for short texts."""
    pairs = _neighbours(F.split(text, ""))
    return F.array_distinct(F.filter(pairs, lambda g: (F.char_length(g) == 2) & (F.trim(g) != "")))


def bigram_codes(text: Column) -> Column:
    """The pairs of bigrams() as numbers: the first code point times 2 ** 21 plus the second."""
    points = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("bigint"))

    def pairs(p: Column) -> Column:
        n = F.greatest(F.size(p) - 1, F.lit(0))
        codes = F.zip_with(F.slice(p, F.lit(1), n), F.slice(p, F.lit(2), n), lambda a, b: a * (1 << 21) + b)
        return F.array_distinct(F.filter(codes, lambda g: g != 32 * (1 << 21) + 32))

    return F.get(F.transform(F.array(points), pairs), F.lit(0))  # so the text is split once


def tokens(text: Column) -> Column:
    """Runs of ASCII letters, digits and underscores, single CJK characters, and the concatenation
    of each neighbouring pair of these."""
    single = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))
    return F.concat(single, _neighbours(single))


def clip(text: Column, characters: int) -> Column:
    """A struct (text, clipped)."""
    return F.struct(F.substring(text, 1, characters).alias("text"), (F.char_length(text) > characters).alias("clipped"))


@F.pandas_udf(T.StructType([T.StructField("boundary", T.ArrayType(T.IntegerType())), T.StructField("ranking", T.ArrayType(T.IntegerType()))]))
def option_orders(context: pd.Series, topics: pd.Series, target: pd.Series, choices: pd.Series) -> pd.DataFrame:
    """The orders in which a router's options are shown: of the two boundary options and of the
    topics. Both follow from the first 32 bits of a SHA-256 over the shown texts (a fixed recipe)."""

    def one(*shown) -> tuple[list[int], list[int]]:
        named = {f"C{i + 1}": c for i, c in enumerate(shown[3])}
        content = json.dumps([shown[0], list(shown[1]), shown[2], named], ensure_ascii=False)
        seed = int(sha256(content.encode()).hexdigest()[:8], 16)
        ranking = list(range(len(shown[1])))
        random.Random(seed).shuffle(ranking)
        return ([1, 0] if seed % 2 else [0, 1]), ranking

    return pd.DataFrame([one(*row) for row in zip(context, topics, target, choices, strict=True)], columns=["boundary", "ranking"])
