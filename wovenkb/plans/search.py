"""Search, question and chat over the stored tables."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import providers
from ..operators import expand, rank, store
from ..params import SearchParams
from ..session import checkpoint, discard, temporary


@dataclass
class Result:
    """Sections (pos, chunk_id, heading, content, source_id, source_name, score), at most twice as many as are asked for, and
    the trace (stage, pos, id, score), a small table that ``release`` deletes."""

    sections: DataFrame
    trace: DataFrame

    def release(self) -> None:
        discard(self.trace)


SECTIONS = "pos int, chunk_id string, heading string, content string, source_id string, source_name string, score double"


def _numbered(hits: DataFrame, name: str, order: str = "score") -> DataFrame:
    """(name, pos, score) of hits (id, score), the best first."""
    return hits.select(F.col("id").alias(name), "score", (F.row_number().over(Window.orderBy(F.col(order).desc(), "id")) - 1).alias("pos"))


def search(tables: dict[str, DataFrame], query: str, p: SearchParams = SearchParams(), history: list[dict] | None = None, source_ids: list[str] | None = None, document_ids: list[str] | None = None, vector: list[float] | None = None) -> Result:
    """Recall seeds by entities and vectors, expand, rank, map to chunks and fuse with direct hits; with a trace of each stage.

    ``tables`` hold each vector once per (collection, id), as the catalog does. What lies between the stages are small
    tables in the shared folder, which are deleted at the end; the sections are few and come with the result.
    """
    spark = tables["chunks"].sparkSession
    if not query.strip():
        return Result(spark.createDataFrame([], SECTIONS), spark.createDataFrame([], "stage string, pos int, id string, score double"))
    query = providers.rewrite(query, (history or [])[-2 * p.history_rounds :])
    q = F.array(*(F.lit(float(x)).cast("float") for x in (vector or providers.hash_embedding(query))))
    with temporary():
        sections, stages = _stages(tables, query, q, p, source_ids, document_ids)
        rows = sections.orderBy("pos").collect()
        trace = None
        for name, x in stages:
            y = x.select(F.lit(name).alias("stage"), F.col("pos").cast("int").alias("pos"), "id", F.col("score").cast("double").alias("score"))
            trace = y if trace is None else trace.unionByName(y)
        path = checkpoint(trace, lasting=True)
    return Result(spark.createDataFrame([tuple(r) for r in rows], SECTIONS), path)


def _stages(tables: dict[str, DataFrame], query: str, q: Column, p: SearchParams, source_ids: list[str] | None, document_ids: list[str] | None) -> tuple[DataFrame, list[tuple[str, DataFrame]]]:
    v, links, events = tables["vectors"], tables["links"], tables["events"].filter("deleted_at is null")
    top = lambda collection, k, least: rank.top_k(v, collection, q, k, least, source_ids, document_ids, unique=True)

    named = providers.query_entities(query, tables["entities"]).select("entity_id", "pos")
    near = _numbered(top("entities", p.entity_topk, p.entity_threshold), "entity_id").select("entity_id", "pos")
    recalled = expand.reuse(expand.recall_entities(named, near, links, events, p, source_ids))
    kept = recalled.filter("kept").select("entity_id", "pos")
    hits = {k: top(c, p.max_events, p.similarity_threshold) for k, c in (("title", "event_titles"), ("summary", "event_summaries"))}
    seeds_v = rank.merge_hits(hits["title"], hits["summary"]) if p.seed_recall == "mixed" else hits[p.seed_recall]
    by_vector = _numbered(seeds_v, "event_id").select("event_id", "pos")
    of_entities = store.events_of_entities(kept, links, events, source_ids)
    by_entity = of_entities.select("event_id", (F.row_number().over(Window.orderBy("event_id")) - 1).alias("pos"))
    seeds = expand.reuse(rank.ordered_union(by_entity, by_vector, "event_id"))

    e_sim = expand.similarity_of(v, "entities", q, "entity_id")
    s_sim = expand.similarity_of(v, "event_summaries", q, "event_id")
    found = expand.reuse(expand.expand(seeds, links, p, events, source_ids, e_sim, s_sim, recalled.select("entity_id")))
    coarse = expand.reuse(rank.coarse_rank(found.select("event_id").distinct(), v, q, p))
    candidates = coarse.filter(F.col("pos") < p.rerank_candidates)
    counts = rank.signal_counts(rank.question_signals(links, candidates, kept, p))
    texts = events.select(F.col("id").alias("event_id"), "title", "summary").join(F.broadcast(candidates.select("event_id")), "event_id", "left_semi")
    best = expand.reuse(rank.rerank_with(coarse, found, counts, texts, providers.model_order(query), p))
    own = rank.sections_of_events(best, events, tables["chunks"])
    direct = _numbered(top("chunks", 4 * p.sections, p.similarity_threshold), "chunk_id")
    fused = rank.fuse(own, direct.select("chunk_id", "pos"), p)
    scores = own.select("chunk_id", F.lit(0).alias("o"), "score").unionByName(direct.select("chunk_id", F.lit(1).alias("o"), "score")).groupBy("chunk_id").agg(F.min_by("score", "o").alias("score"))
    chunks = tables["chunks"].select(F.col("id").alias("chunk_id"), "heading", "content", "source_id").join(F.broadcast(fused.select("chunk_id")), "chunk_id", "left_semi")
    sections = store.attach_source_names(fused.join(scores, "chunk_id", "left").join(chunks, "chunk_id"), tables["sources"])
    none = F.lit(None).cast("double").alias("score")
    return sections.select("pos", "chunk_id", "heading", "content", "source_id", "source_name", "score"), [
        ("query_entities", named.select("pos", F.col("entity_id").alias("id"), none)),
        ("entities", kept.select("pos", F.col("entity_id").alias("id"), none)),
        ("seeds", seeds.select("pos", F.col("event_id").alias("id"), none)),
        ("expanded", found.select(F.col("depth").alias("pos"), F.col("event_id").alias("id"), none)),
        ("candidates", coarse.select("pos", F.col("event_id").alias("id"), "score")),
        ("reranked", best.select("pos", F.col("event_id").alias("id"), "score")),
        ("fallback", best.agg(F.count("*").alias("_n")).filter("_n = 0").select(F.lit(0).alias("pos"), F.lit("vector_only").alias("id"), none)),
    ]


def ask(tables: dict[str, DataFrame], query: str, history: list[dict] | None = None, **options: object) -> tuple[str, Result]:
    """An answer and what it rests on. The sections are at most a few, so their text may come to the driver."""
    result = search(tables, query, history=history, **options)
    context = rank.context_text(result.sections).first()
    return providers.answer(query, context.context if context else "", history), result


def chat(tables: dict[str, DataFrame], query: str, history: list[dict], **options: object) -> Iterator[tuple[str, str]]:
    """A question in a conversation, answered piece by piece: (event, data) with meta, deltas and done."""
    said = [h for h in history if h.get("role") in ("user", "assistant") and (h.get("content") or "").strip()][-2 * SearchParams().history_rounds :]
    result = search(tables, query, history=said, **options)
    context = rank.context_text(result.sections).first()
    yield from providers.answer_stream(query, context.context if context else "", said)


def sources(tables: dict[str, DataFrame], keyword: str | None = None, archived: bool = False, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of the sources with the number of their chunks and events."""
    page = store.list_sources(tables["sources"], keyword, archived, limit, offset)
    few = F.broadcast(page.select(F.col("id").alias("source_id")))
    count = lambda name: tables[name].join(few, "source_id", "left_semi").groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias(f"n_{name}"))
    x = page.join(count("chunks"), "id", "left").join(count("events"), "id", "left")
    return x.fillna(0, ["n_chunks", "n_events"]).orderBy(F.col("created_at").desc_nulls_last(), "id")


def detail(tables: dict[str, DataFrame], source_id: str) -> dict[str, DataFrame]:
    """One source with its latest document, chunks and live events in their order."""
    own = lambda name: tables[name].filter(F.col("source_id") == source_id)
    return {"source": tables["sources"].filter(F.col("id") == source_id), "document": store.latest_document(tables["documents"], source_id), "chunks": own("chunks").orderBy("document_id", "rank_index", "id"), "events": own("events").filter("deleted_at is null").orderBy("document_id", "rank_index", "id")}


def stats(tables: dict[str, DataFrame]) -> DataFrame:
    """(what, n) of all tables, in one row each."""
    out = None
    for name in ("sources", "documents", "chunks", "events", "entities", "links", "vectors"):
        x = tables[name].agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n")
        out = x if out is None else out.unionByName(x)
    return out
