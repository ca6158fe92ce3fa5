"""Frames of the model over the test tables, with repeats taken out, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import store
from ..session import table

KEYS = {
    "kb_sources": (["id"], ["created_at", "name"]),
    "kb_documents": (["id"], ["created_at", "status"]),
    "kb_chunks": (["id"], ["created_at"]),
    "kb_events": (["id"], ["created_at"]),
    "kb_entities": (["id"], ["updated_at", "description"]),
    "kb_event_entities": (["event_id", "entity_id"], ["created_at", "id"]),
}


def model(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table with one row per key: the first by the order given above."""
    keys, order = KEYS[name]
    return store.latest(table(spark, sf_dir, name), keys, [F.col(c).asc_nulls_last() for c in order])


def with_sql(*names: str) -> str:
    """WITH clauses of the same frames; the name gets the prefix m_."""
    parts = []
    for n in names:
        keys, order = KEYS[n]
        parts.append(f"m_{n[3:]} AS (SELECT * EXCLUDE (_n) FROM (SELECT *, row_number() OVER (PARTITION BY {', '.join(keys)} ORDER BY {', '.join(f'{c} ASC NULLS LAST' for c in order)}) AS _n FROM {n}) WHERE _n = 1)")
    return "WITH " + ",\n".join(parts)
