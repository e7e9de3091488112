"""Joins whose strategy follows a measured size."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Rows up to which a key table of a few fixed-width columns is broadcast (about 50 MB).
BROADCAST_ROWS = 500_000


def join_checked(left: DataFrame, keys: DataFrame, on, how: str, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Joins left with a narrow key table: by broadcast if the counted rows of keys fit the
    limit, else by a shuffled join, which AQE splits where a key is hot.

    keys must be cheap to count (a written table) and narrow (fixed-width columns).
    """
    small = keys.limit(limit + 1).count() <= limit
    return left.join(F.broadcast(keys) if small else keys, on, how)


def own_names(columns: list[str], *names: str) -> list[str]:
    """The names with as many leading underscores as keep them apart from all given columns."""
    marks = 1 + max((len(c) - len(c.lstrip("_")) for c in columns), default=0)
    return ["_" * marks + n for n in names]
