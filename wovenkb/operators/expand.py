"""Expansion over the event-entity table: hub filters, frontier scores and breadth-first hops.

All of it is one lazy plan: decisions that depend on counts are one-row frames that are joined in, so no hop
needs an action, and hubs are dropped by their degree before the join that they would swell.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import vectors as V
from ..params import SearchParams
from ..session import checkpoint
from . import stats, store


def reuse(rows: DataFrame) -> DataFrame:
    """Write a frontier or a hop's events as a small table: later hops read it instead of repeating the plan before it."""
    return checkpoint(rows)


def _all():
    """The window over a whole (bounded) frontier."""
    return Window.partitionBy()


def _threshold(col: str, keep: str, p: SearchParams) -> tuple[dict[str, Column], Column]:
    """Helper columns and the threshold of a frontier over the rows where ``keep`` holds, as windows over the frontier.

    The frontier is bounded by the parameters (the seed entities times the absolute degree limit, later the hop's
    seeds), so one task holds it and no join or extra job is needed; ``stats`` has the same for frames of any size.
    """
    x = F.when(F.col(keep), F.col(col).cast("double"))
    if p.degree_method == "none":
        return {}, F.lit(float("inf"))
    if p.degree_method == "mad":
        steps = {"_mid": F.percentile(x, F.lit(0.5)).over(_all())}
        mad = F.percentile(F.abs(x - F.col("_mid")), F.lit(0.5)).over(_all())
        return steps | {"_mad": mad}, F.when(F.col("_mad") <= 0, F.col("_mid") * 2).otherwise(F.col("_mid") + p.outlier_k * F.col("_mad") / 0.6745)
    if p.degree_method == "tukey":
        q = {"_q1": F.percentile(x, F.lit(0.25)).over(_all()), "_q3": F.percentile(x, F.lit(0.75)).over(_all())}
        gap = F.col("_q3") - F.col("_q1")
        return q, F.when(gap <= 0, F.col("_q3") * 2).otherwise(F.col("_q3") + p.outlier_k * gap)
    if p.degree_method == "otsu":
        n, lo, hi = F.col("_n"), F.col("_lo"), F.col("_hi")
        wide = (hi - lo) / F.col("_bins")
        upto = Window.partitionBy().orderBy("_bin").rangeBetween(Window.unboundedPreceding, 0)
        kept = F.col("_bin").isNotNull()
        var = F.when(kept & (n > F.col("_wb")), F.col("_wb") * (n - F.col("_wb")) * F.pow(F.col("_sb") / F.col("_wb") - (F.col("_total") - F.col("_sb")) / (n - F.col("_wb")), F.lit(2.0)))
        steps = {"_n": F.count(x).over(_all()), "_lo": F.min(x).over(_all()), "_hi": F.max(x).over(_all()), "_total": F.sum(x).over(_all())}
        more = {"_bins": F.least(F.lit(20), n)}, {"_bin": F.when(F.col(keep) & (hi > lo), F.least(F.floor((F.col(col) - lo) / wide), F.col("_bins") - 1).cast("int"))}, {"_centre": lo + (F.col("_bin") + 0.5) * wide}
        for m in more:
            steps |= m
        steps |= {"_wb": F.count("_bin").over(upto), "_sb": F.sum("_centre").over(upto), "_var": var, "_cut": F.max(F.when(F.col("_var") > 0, F.struct("_var", (-F.col("_bin")).alias("b"), "_centre"))).over(_all())["_centre"]}
        return steps, F.coalesce("_cut", hi)
    return {"_p": F.percentile(x, F.lit(p.percentile / 100)).over(_all())}, F.col("_p")


def degree_filter(frontier: DataFrame, p: SearchParams, seeds: bool = False) -> DataFrame:
    """(entity_id, degree, kept, rejected) of a frontier with degrees.

    The outlier method counts only among at least ``min_batch`` entities; if it leaves too few and the absolute
    limit has removed some, the absolute limit alone decides; if nothing is left, all are kept. ``rejected`` marks
    what never comes back: for seeds all that is dropped, for later frontiers what is over the absolute limit.
    """
    if seeds and p.degree_most <= 0:
        return frontier.select("entity_id", "degree", F.lit(True).alias("kept"), F.lit(False).alias("rejected"))
    x = frontier.withColumn("_abs", F.lit(True) if p.degree_most <= 0 else F.col("degree") <= p.degree_most)
    x = x.withColumns({"_all": F.count(F.lit(1)).over(_all()), "_n_abs": F.count_if("_abs").over(_all())})
    steps, cut = _threshold("degree", "_abs", p)
    for name, c in steps.items():
        x = x.withColumn(name, c)
    used = F.lit(p.degree_method != "none") & (F.col("_n_abs") >= p.min_batch)
    x = x.withColumn("_method", F.col("_abs") & (~used | (F.col("degree") <= cut))).withColumn("_n_method", F.count_if("_method").over(_all()))
    floor = F.lit(max(p.min_batch, 5)) if seeds else F.greatest(F.floor(F.col("_all") / 2), F.lit(5))
    relaxed = (F.col("_n_method") < floor) & (F.col("_n_abs") < F.col("_all")) & (used | F.lit(not seeds))
    left = F.when(relaxed, F.col("_n_abs")).otherwise(F.col("_n_method"))
    kept = F.when(left == 0, True).when(relaxed, F.col("_abs")).otherwise(F.col("_method"))
    rejected = ~F.col("kept") if seeds else ~F.col("kept") & (F.col("degree") > p.degree_most) & F.lit(p.degree_most > 0)
    return x.withColumn("kept", kept).select("entity_id", "degree", "kept", rejected.alias("rejected"))


def _scaled(x: DataFrame, col: str) -> DataFrame:
    """With the column between its winsorised bounds; null values (not in the frontier any more) don't count."""
    n, at = F.count(col).over(_all()), F.row_number().over(Window.partitionBy().orderBy(F.col(col).asc_nulls_last()))
    place = lambda share: F.when(F.col("_n") < 4, 1 if share < 0.5 else F.col("_n")).otherwise(F.floor(F.col("_n") * share) + 1)
    y = x.withColumns({"_n": n, "_at": at})
    y = y.withColumns({"_lo": F.max(F.when(F.col("_at") == place(0.1), F.col(col))).over(_all()), "_hi": F.max(F.when(F.col("_at") == place(0.9), F.col(col))).over(_all())})
    return y.withColumn(col, stats.winsor_scale(F.col(col), F.col("_lo"), F.col("_hi"))).drop("_n", "_at", "_lo", "_hi")


def frontier_scores(frontier: DataFrame, similarity: DataFrame | None, p: SearchParams) -> DataFrame:
    """(entity_id, score and the columns of the frontier): (1 - a) idf + a similarity, both scaled between their winsorised bounds."""
    similarity = similarity(frontier) if callable(similarity) else similarity
    sim = frontier.withColumn("sim", F.lit(0.0)) if similarity is None else frontier.join(similarity, "entity_id", "left")
    x = sim.withColumn("idf", 1.0 / (1.0 + F.col("degree"))).withColumn("sim", F.greatest(F.coalesce("sim", F.lit(0.0)), F.lit(0.0)))
    x = _scaled(_scaled(x, "idf"), "sim")
    return x.withColumn("score", (1.0 - p.query_weight) * F.col("idf") + p.query_weight * F.col("sim")).drop("idf", "sim")


def filter_frontier(entities: DataFrame, links: DataFrame, similarity: DataFrame | None, p: SearchParams) -> DataFrame:
    """(entity_id, rejected): the entities over which the next hop goes (rejected false), and those that never return.

    Over the budget the best by frontier score remain (without similarities the score falls with the degree);
    without a filter the first by id.
    """
    budget = max(p.frontier_budget, 1)
    if not p.frontier_filter:
        return entities.select("entity_id").orderBy("entity_id").limit(budget).withColumn("rejected", F.lit(False))
    marked = degree_filter(store.entity_degrees(links, entities), p)
    scores = frontier_scores(marked.filter("kept"), similarity, p).unionByName(marked.filter("rejected").withColumn("score", F.lit(0.0))) if similarity is not None else marked.withColumn("score", -F.col("degree"))
    at = F.row_number().over(Window.orderBy(F.col("kept").desc(), F.col("score").desc(), "entity_id"))
    return scores.withColumn("_at", at).filter((F.col("kept") & (F.col("_at") <= budget)) | F.col("rejected")).select("entity_id", "rejected")


def expand(seeds: DataFrame, links: DataFrame, p: SearchParams, events: DataFrame | None = None, source_ids: list[str] | None = None, entity_similarity: DataFrame | None = None, event_similarity: DataFrame | None = None, visited_entities: DataFrame | None = None) -> DataFrame:
    """(event_id, depth): breadth-first hops from seed events (depth 0).

    ``event_similarity`` (event_id, sim) steers: a soft threshold drops events for good; "hopllm" takes the most
    similar as the next seeds and stops after a hop whose best is under ``hop_relevance``; "multi" takes the first by id.
    A missing similarity is 0. A visited entity or event never counts again. A similarity is a frame, or a function from
    the ids that are asked for to a frame (``similarity_of``), so that no others are computed.
    """
    frames = [reuse(seeds.select("event_id").distinct()).withColumn("depth", F.lit(0))]
    seen_events = frames[0].select("event_id")
    seen_entities = visited_entities.select("entity_id").distinct() if visited_entities is not None else seeds.sparkSession.createDataFrame([], "entity_id string")
    now = seen_events
    for hop in range(p.max_hops):
        new = reuse(links.join(now, "event_id", "left_semi").select("entity_id").distinct().join(seen_entities, "entity_id", "left_anti"))
        frontier = reuse(filter_frontier(new, links, entity_similarity, p))
        seen_entities = seen_entities.unionByName(frontier.select("entity_id"))
        found = reuse(store.events_of_entities(frontier.filter("not rejected"), links, events, source_ids, seen_events))
        seen_events = seen_events.unionByName(found)
        own = event_similarity(found) if callable(event_similarity) else event_similarity
        scored = found.withColumn("sim", F.lit(0.0)) if own is None else found.join(own, "event_id", "left").withColumn("sim", F.coalesce("sim", F.lit(0.0)))
        if p.soft_threshold > 0 and event_similarity is not None:
            scored = scored.filter(F.col("sim") >= p.soft_threshold)
        frames.append(scored.select("event_id", F.lit(hop + 1).alias("depth")))
        if hop + 1 == p.max_hops:
            break
        if p.strategy == "hopllm":
            best = scored.agg(F.max("sim").alias("_best"))
            top = scored.orderBy(F.col("sim").desc(), "event_id").limit(p.hop_seeds)
            now = reuse(top.crossJoin(F.broadcast(best)).filter(F.col("_best") >= p.hop_relevance).select("event_id"))
        else:
            now = scored.select("event_id").orderBy("event_id").limit(p.hop_seeds)
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def query_similarity(vectors: DataFrame, collection: str, query: Column, id_name: str) -> DataFrame:
    """(id, sim) of a collection against one query vector, which is a literal of the plan."""
    x = vectors.filter((F.col("collection") == collection) & F.col("embedding").isNotNull())
    return x.groupBy("id").agg(F.max(V.cosine(F.col("embedding"), query)).alias("sim")).select(F.col("id").alias(id_name), "sim")


def similarity_of(vectors: DataFrame, collection: str, query: Column, id_name: str) -> Callable[[DataFrame], DataFrame]:
    """The similarity of given ids to one query vector: their vectors are picked first and no others are compared."""
    x = vectors.filter((F.col("collection") == collection) & F.col("embedding").isNotNull()).select(F.col("id").alias(id_name), "embedding")

    def of(ids: DataFrame) -> DataFrame:
        return x.join(ids.select(id_name), id_name, "left_semi").groupBy(id_name).agg(F.max(V.cosine(F.col("embedding"), query)).alias("sim"))

    return of


def depth_histogram(expanded: DataFrame) -> DataFrame:
    return expanded.groupBy("depth").agg(F.count("*").alias("events"))


def recall_entities(exact: DataFrame, near: DataFrame, links: DataFrame, events: DataFrame, p: SearchParams, source_ids: list[str] | None = None) -> DataFrame:
    """(entity_id, pos, kept): exact matches first, then neighbours (entity_id, pos), each once; scoped, cut, hubs marked."""
    both = exact.select("entity_id", F.lit(0).alias("part"), "pos").unionByName(near.select("entity_id", F.lit(1).alias("part"), "pos"))
    once = both.groupBy("entity_id").agg(F.min(F.struct("part", "pos")).alias("_at"))
    scoped = store.scope_entities(once, links, events, source_ids)
    first = scoped.orderBy("_at", "entity_id").limit(p.seed_entities).withColumn("pos", (F.row_number().over(Window.orderBy("_at", "entity_id")) - 1))
    marks = degree_filter(store.entity_degrees(links, first), p, seeds=True)
    return first.select("entity_id", "pos").join(marks, "entity_id")
