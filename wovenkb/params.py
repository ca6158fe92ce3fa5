"""Parameters of ingest and search with their defaults."""

from __future__ import annotations

from dataclasses import dataclass

# Types of entities, collections, and the defaults of all parameters.
ENTITY_TYPES = ("time", "location", "person", "organization", "group", "topic", "work", "product", "action", "metric", "label")
QUERY_ENTITY_TYPES = tuple(t for t in ENTITY_TYPES if t != "action")
COLLECTIONS = ("chunks", "event_titles", "event_contents", "event_summaries", "entities")


@dataclass(frozen=True)
class SearchParams:
    """Of recall, expansion, ranking and fusion."""

    similarity_threshold: float = 0.4
    entity_threshold: float = 0.5
    entity_topk: int = 10
    max_hops: int = 2
    strategy: str = "hopllm"  # or "multi"
    hop_relevance: float = 0.3
    soft_threshold: float = 0.0
    hop_seeds: int = 8
    frontier_budget: int = 100
    frontier_filter: bool = True
    query_weight: float = 0.6
    degree_method: str = "otsu"  # mad, tukey, percentile, none
    degree_most: int = 50
    percentile: float = 95.0
    outlier_k: float = 3.0
    min_batch: int = 10
    seed_entities: int = 200
    coarse_threshold: float = 0.0
    max_events: int = 100
    rerank_candidates: int = 100
    rerank_top: int = 5
    strong: float = 0.7
    weak: float = 0.4
    decay: float = 0.6
    sections: int = 5
    fusion: str = "concat"  # or "supplement"
    history_rounds: int = 5
    seed_recall: str = "mixed"  # title, summary


@dataclass(frozen=True)
class IngestParams:
    """Of cleaning, splitting and extraction."""

    splitter: str = "semantic"
    chunk_size: int = 8192
    overlap: int = 800
    table_chunk_size: int = 0
    semantic_percentile: float = 95.0
    strip_html: bool = False
    collapse_spaces: bool = True
    join_lines: bool = True
    protect_lists: bool = True
    limit_blank_lines: bool = True
    title_chars: int = 100
    summary_chars: int = 500
    embed_summary: bool = True
    strip_roles: bool = True
    genre_detect: bool = True
    parallel: bool = False
    retries: int = 2
