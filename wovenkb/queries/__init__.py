"""Named queries over the test tables and the SQL that states the same."""

from __future__ import annotations

from . import graph_queries, store_queries, text_queries
from .graph_queries import flagship

_MODULES = (store_queries, graph_queries, text_queries)
QUERIES: dict = {name: q for m in _MODULES for name, q in m.Q.items()}
SQL: dict[str, str] = {name: q for m in _MODULES for name, q in m.S.items()}
