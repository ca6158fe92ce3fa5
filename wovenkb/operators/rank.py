"""Scoring, ranking and fusion of events and chunks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import vectors as V
from ..params import SearchParams
from . import store


def top_k(vectors: DataFrame, collection: str, query: Column, k: int, threshold: float | None = None, source_ids: list[str] | None = None, document_ids: list[str] | None = None, metric: str = "cosine", unique: bool = False) -> DataFrame:
    """(id, score): the k most similar of a collection, then those over the threshold. Sources and documents filter
    before scoring (so no hit is lost to them, and no over-fetch is needed), never the entities. orderBy + limit is one
    partial top-k per task; where ids are ``unique``, as in the catalog, nothing is shuffled before it."""
    x = vectors.filter(F.col("collection") == collection)
    if collection != "entities":
        if source_ids is not None:
            x = x.filter(F.col("source_id").isin(source_ids))
        if document_ids is not None:
            x = x.filter(F.col("document_id").isin(document_ids))
    score = V.cosine(F.col("embedding"), query) if metric == "cosine" else V.l2_similarity(F.col("embedding"), query)
    hits = x.filter(F.size("embedding") == F.size(query)).select("id", score.alias("score"))
    hits = (hits if unique else hits.groupBy("id").agg(F.max("score").alias("score"))).filter(~F.isnan("score"))
    top = hits.orderBy(F.col("score").desc(), "id").limit(k)
    return top if threshold is None else top.filter(F.col("score") >= threshold)


def top_k_each(vectors: DataFrame, collection: str, queries: DataFrame, k: int, threshold: float) -> DataFrame:
    """(query_id, id, score, rank) for many queries (query_id, query): a handful, which are broadcast."""
    x = vectors.filter((F.col("collection") == collection) & F.col("embedding").isNotNull()).select("id", "embedding").dropDuplicates(["id"])
    pairs = x.crossJoin(F.broadcast(queries)).select("query_id", "id", V.cosine(F.col("embedding"), F.col("query")).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return pairs.withColumn("rank", F.row_number().over(w)).filter((F.col("rank") <= k) & (F.col("score") >= threshold))


def merge_hits(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union of (id, score) with the greater score."""
    return a.select("id", "score").unionByName(b.select("id", "score")).groupBy("id").agg(F.max("score").alias("score"))


def ordered_union(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Rows of (key, pos) of a, then of b, each key once, numbered from 0."""
    x = a.select(key, F.lit(0).alias("_part"), F.col("pos").alias("_pos")).unionByName(b.select(key, F.lit(1).alias("_part"), F.col("pos").alias("_pos")))
    first = x.groupBy(key).agg(F.min(F.struct("_part", "_pos")).alias("_at"))
    return first.select(key, (F.row_number().over(Window.orderBy("_at", key)) - 1).alias("pos"))


def coarse_rank(events: DataFrame, vectors: DataFrame, query: Column, p: SearchParams) -> DataFrame:
    """(event_id, score, pos) by cosine of contents: only scores over 0 (and the threshold), the best ``max_events``.
    If nothing remains, the first expanded with score 0. Only the events' own vectors are scored: they are picked first."""
    own = vectors.filter((F.col("collection") == "event_contents") & F.col("embedding").isNotNull()).select(F.col("id").alias("event_id"), "embedding").join(events.select("event_id"), "event_id", "left_semi")
    sims = own.groupBy("event_id").agg(F.max(V.cosine(F.col("embedding"), query)).alias("score"))
    scored = sims.filter((F.col("score") > 0) & ~F.isnan("score"))
    if p.coarse_threshold > 0:
        scored = scored.filter(F.col("score") >= p.coarse_threshold)
    n = scored.agg(F.count("*").alias("_n"))
    fallback = events.select("event_id").crossJoin(F.broadcast(n)).filter("_n = 0").select("event_id", F.lit(0.0).alias("score"))
    top = scored.unionByName(fallback).orderBy(F.col("score").desc(), "event_id").limit(p.max_events)
    return top.withColumn("pos", F.row_number().over(Window.orderBy(F.col("score").desc(), "event_id")) - 1)


def decayed(score: Column, depth: Column, p: SearchParams) -> Column:
    return score * F.pow(F.lit(p.decay), depth)


def candidate_idf(degrees: DataFrame, candidates: int) -> DataFrame:
    """(entity_id, idf): ln(candidates / degree), degree 0 as ln candidates, divided by the greatest; all 0 if that isn't positive."""
    raw = degrees.select("entity_id", F.log(F.lit(float(candidates)) / F.greatest("degree", F.lit(1))).alias("_raw"))
    top = raw.agg(F.max("_raw").alias("_top"))
    return raw.crossJoin(F.broadcast(top)).select("entity_id", F.when(F.col("_top") > 0, F.col("_raw") / F.col("_top")).otherwise(0.0).alias("idf"))


def question_signals(links: DataFrame, candidates: DataFrame, entity_ids: DataFrame, p: SearchParams) -> DataFrame:
    """(event_id, entity_id, signal, kind) of the candidates' links to the question's entities: N of the idf is the
    number of candidates, degrees are counted over all links."""
    wanted = entity_ids.select("entity_id").distinct()
    n = candidates.select("event_id").distinct().agg(F.count("*").alias("_cand"))
    degrees = store.entity_degrees(links, wanted)
    raw = degrees.crossJoin(F.broadcast(n)).filter("_cand > 0").select("entity_id", F.log(F.col("_cand") / F.greatest("degree", F.lit(1))).alias("_raw"))
    top = raw.agg(F.max("_raw").alias("_top"))
    idf = raw.crossJoin(F.broadcast(top)).select("entity_id", F.when(F.col("_top") > 0, F.col("_raw") / F.col("_top")).otherwise(0.0).alias("idf"))
    own = links.join(candidates.select("event_id"), "event_id", "left_semi").join(wanted, "entity_id", "left_semi")
    return signals(own, idf, p)


def rerank_with(coarse: DataFrame, depths: DataFrame, counts: DataFrame, texts: DataFrame, order: Callable[[list[dict]], list[int]] | None, p: SearchParams) -> DataFrame:
    """(event_id, score, pos) in the order that a model gives for the candidates.

    ``order`` gets the candidates as dicts (event_id, title, summary, score, adjusted, depth, strong, medium, weak) in coarse
    order and gives places in that list. There are at most ``rerank_candidates``, so they may come to the driver. Where it is
    None the offline order holds; where it fails, the coarse one.
    """
    if order is None:
        return rerank(coarse, depths, counts, p)
    few = coarse.filter(F.col("pos") < p.rerank_candidates)
    x = few.join(depths, "event_id", "left").join(counts, "event_id", "left").join(texts.select("event_id", "title", "summary"), "event_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    x = x.select("event_id", "title", "summary", "score", decayed(F.col("score"), F.coalesce("depth", F.lit(0)), p).alias("adjusted"), zero("depth"), zero("strong"), zero("medium"), zero("weak"), "pos")
    rows = [r.asDict() for r in x.orderBy("pos").collect()]
    try:
        told = order(rows)
    except Exception:  # a model that fails leaves the coarse order
        told = []
    places = coarse.sparkSession.createDataFrame([(int(i), k) for k, i in enumerate(told)], "index int, at int")
    ranked = apply_order(few.select(F.col("event_id").alias("id"), "pos"), places, p.rerank_top)
    return ranked.join(few.select(F.col("event_id").alias("id"), "score"), "id").select(F.col("id").alias("event_id"), "score", F.col("rank").alias("pos"))


def signals(links: DataFrame, idf: DataFrame, p: SearchParams) -> DataFrame:
    """(event_id, entity_id, signal, kind): weight times idf as strong, medium or weak."""
    x = links.join(idf, "entity_id", "left").withColumn("signal", F.coalesce("weight", F.lit(0.5)) * F.coalesce("idf", F.lit(0.0)))
    return x.select("event_id", "entity_id", "signal", F.when(F.col("signal") >= p.strong, "strong").when(F.col("signal") >= p.weak, "medium").otherwise("weak").alias("kind"))


def signal_counts(kinds: DataFrame) -> DataFrame:
    return kinds.groupBy("event_id").agg(F.count_if(F.col("kind") == "strong").alias("strong"), F.count_if(F.col("kind") == "medium").alias("medium"), F.count_if(F.col("kind") == "weak").alias("weak"))


def rerank(coarse: DataFrame, depths: DataFrame, counts: DataFrame, p: SearchParams) -> DataFrame:
    """(event_id, score, pos): the offline order by decayed score, strong signals and id; the first ``rerank_top``."""
    x = coarse.filter(F.col("pos") < p.rerank_candidates).drop("pos").join(depths, "event_id", "left").join(counts, "event_id", "left")
    x = x.select("event_id", decayed(F.col("score"), F.coalesce("depth", F.lit(0)), p).alias("score"), F.coalesce("strong", F.lit(0)).alias("strong"))
    order = [F.col("score").desc(), F.col("strong").desc(), F.col("event_id")]
    return x.orderBy(*order).limit(p.rerank_top).withColumn("pos", F.row_number().over(Window.orderBy(*order)) - 1).select("event_id", "score", "pos")


def apply_order(candidates: DataFrame, order: DataFrame, limit: int) -> DataFrame:
    """Candidates (id, pos) in the order of a model's answer (index, at): bad and repeated indices are dropped, what it left out follows."""
    n = candidates.agg(F.count("*").alias("_n"))
    good = order.crossJoin(F.broadcast(n)).filter("index >= 0 and index < _n").groupBy("index").agg(F.min("at").alias("at"))
    x = candidates.join(good, candidates["pos"] == good["index"], "left")
    w = Window.orderBy(F.col("at").asc_nulls_last(), candidates["pos"])
    return x.withColumn("rank", F.row_number().over(w) - 1).filter(F.col("rank") < limit).select("id", "rank")


def sections_of_events(ranked: DataFrame, events: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks (chunk_id, score, pos) of ranked events; a chunk counts at its best event."""
    x = ranked.join(events.select(F.col("id").alias("event_id"), "chunk_id"), "event_id").join(chunks.select(F.col("id").alias("chunk_id")), "chunk_id", "left_semi")
    best = x.groupBy("chunk_id").agg(F.min_by(F.struct("score", "pos"), F.col("pos")).alias("_b"))
    return best.select("chunk_id", F.col("_b.score").alias("score"), (F.row_number().over(Window.orderBy("_b.pos", "chunk_id")) - 1).alias("pos"))


def fuse(events: DataFrame, direct: DataFrame, p: SearchParams) -> DataFrame:
    """(chunk_id, pos): sections of events and direct hits, both (chunk_id, pos).

    concat: the first of both, the direct ones also filling what the events lack, each chunk once. supplement: direct
    hits only fill the gap.
    """
    a = events.filter(F.col("pos") < p.sections).select("chunk_id", "pos")
    n = a.agg(F.count("*").alias("_n"))
    want = 2 * p.sections - F.col("_n") if p.fusion == "concat" else p.sections - F.col("_n")
    if p.fusion == "supplement":
        direct = direct.join(a.select("chunk_id"), "chunk_id", "left_anti")
        direct = direct.withColumn("pos", F.row_number().over(Window.orderBy("pos", "chunk_id")) - 1)
    b = direct.crossJoin(F.broadcast(n)).filter(F.col("pos") < want).select("chunk_id", "pos")
    most = 2 * p.sections if p.fusion == "concat" else p.sections
    return ordered_union(a, b, "chunk_id").filter(F.col("pos") < most)


def history(turns: DataFrame, rounds: int) -> DataFrame:
    """The last 2 * rounds valid messages of each conversation (conv_id, turn, role, text), in order."""
    valid = turns.filter(F.col("role").isin("user", "assistant") & (F.length(F.trim("text")) > 0))
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    return valid.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= 2 * rounds).drop("_n")


def context_text(sections: DataFrame) -> DataFrame:
    """One text of numbered sections (pos, heading, content, source_name, score)."""
    part = F.format_string("[%d] %s (%s, %.2f)\n%s", F.col("pos") + 1, F.coalesce("heading", F.lit("")), F.coalesce("source_name", F.lit("")), F.coalesce("score", F.lit(0.0)), F.coalesce("content", F.lit("")))
    return sections.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", part.alias("t")))), lambda x: x["t"]), "\n\n").alias("context"))
