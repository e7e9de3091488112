"""The queries of the library, as (spark, sf_dir) -> DataFrame, and their SQL."""

from __future__ import annotations

from convmem.queries import formation, graph, intake, recall, segment

_MODULES = (intake, segment, graph, recall, formation)
QUERIES: dict = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL: dict = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
FLAGSHIP = QUERIES["flagship"]
