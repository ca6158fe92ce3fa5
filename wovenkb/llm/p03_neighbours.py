"""Most similar vectors for every vector.

Method: robust-pruned directed graphs. Vectors are divided into shards; each shard gets a graph in which
greedy searches propose a node's neighbours and relaxed distance pruning keeps diverse edges; a beam search
then queries shards. Shards are made by coarse centroids, fitted on a bounded sample: every vector is
stored in one shard, and a query searches the shards of its nearest centroids, merging the hits.
All steps of many nodes or queries run together as array operations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from . import common

DIM = 64
#: Neighbours wanted; edges of a node; width of the beam when building and when searching; slack of the pruning.
K, DEGREE, BUILD_BEAM, SEARCH_BEAM, ALPHA = 5, 32, 32, 32, 1.1
#: Vectors of a shard on average, and at most (a larger one is divided at random); centroids of a collection at most.
SHARD, SHARD_MOST, CENTROIDS_MOST = 4096, 16_384, 4096
#: Questions to a shard that one task answers; more are spread over several tasks, each of which gets the graph.
ASKS = 40_000
#: Nodes of a graph at whose nearest a search starts: each is as far as can be from those before.
ENTRIES = 256
#: Shards that a query searches at most: those whose centroid is as similar as the nearest one's, but for MARGIN.
PROBES, MARGIN = 6, 0.3
#: Rows of the sample on which the centroids of a collection are fitted.
SAMPLE = 20_000
#: Queries of one task and one array operation.
QUERY_BLOCK = 2048


def _top(scores: np.ndarray, n: int) -> np.ndarray:
    """Columns of the n highest scores of each row, in descending order."""
    n = min(n, scores.shape[1])
    part = np.argpartition(-scores, n - 1, axis=1)[:, :n] if n < scores.shape[1] else np.broadcast_to(np.arange(n), scores.shape).copy()
    return np.take_along_axis(part, np.argsort(-np.take_along_axis(scores, part, 1), axis=1, kind="stable"), 1)


def beam_search(x: np.ndarray, graph: np.ndarray, queries: np.ndarray, beam: int, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Greedy beam search of all queries together over a graph (rows of neighbour numbers, -1 for none).

    Gives for each query the ``beam`` best nodes found and their similarity (-2 where there is none).
    """
    m = len(queries)
    ids = np.full((m, beam), -1, dtype=np.int32)
    sims = np.full((m, beam), -2, dtype=np.float32)
    near = queries @ x[entries].T
    best = _top(near, beam)  # the search begins at the entries nearest to the query
    ids[:, : best.shape[1]] = entries[best]
    sims[:, : best.shape[1]] = np.take_along_axis(near, best, 1)
    done = ids < 0
    active = np.arange(m)
    while len(active):
        open_ = ~done[active]
        active = active[open_.any(axis=1)]
        if not len(active):
            break
        pick = np.argmax(~done[active], axis=1)
        done[active, pick] = True
        near = graph[ids[active, pick]]
        new = np.einsum("mrd,md->mr", x[near], queries[active])
        known = (near[:, :, None] == ids[active][:, None, :]).any(axis=2) | (near < 0)
        new[known] = -2
        all_ids = np.concatenate([ids[active], near], axis=1)
        all_sims = np.concatenate([sims[active], new], axis=1)
        all_done = np.concatenate([done[active], known], axis=1)
        order = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
        s = np.take_along_axis(all_sims, order, 1)
        order = np.take_along_axis(order, np.argsort(-s, axis=1, kind="stable"), 1)
        ids[active] = np.take_along_axis(all_ids, order, 1)
        sims[active] = np.take_along_axis(all_sims, order, 1)
        done[active] = np.take_along_axis(all_done, order, 1) | (sims[active] <= -2)
    return ids, sims


def robust_prune(x: np.ndarray, nodes: np.ndarray, cand: np.ndarray, sims: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """For each node at most ``degree`` of its candidates: the nearest is kept and all candidates that are nearer,
    by the factor alpha, to it than to the node are dropped; and so on. Distances are 2 - 2 cosine."""
    sims = np.where((cand < 0) | (cand == nodes[:, None]), -2, sims)
    order = np.argsort(-sims, axis=1, kind="stable")
    cand, sims = np.take_along_axis(cand, order, 1), np.take_along_axis(sims, order, 1)
    same = np.zeros_like(cand, dtype=bool)
    same[:, 1:] = cand[:, 1:] == cand[:, :-1]
    alive = (sims > -2) & ~same
    dist = 2 - 2 * sims
    out = np.full((len(nodes), degree), -1, dtype=np.int32)
    vectors = x[cand]
    rows = np.arange(len(nodes))
    for k in range(degree):
        pick = np.argmax(alive, axis=1)
        ok = alive[rows, pick]
        if not ok.any():
            break
        out[ok, k] = cand[rows[ok], pick[ok]]
        between = 2 - 2 * np.einsum("mcd,md->mc", vectors, vectors[rows, pick])
        alive &= ~((alpha * between <= dist) & ok[:, None])
        alive[rows, pick] = False
    return out


def spread(x: np.ndarray, count: int) -> np.ndarray:
    """Nodes spread over all regions: the one nearest to the mean, then each the farthest from those that are chosen."""
    chosen = [int(np.argmax(x @ x.mean(axis=0)))]
    near = x @ x[chosen[0]]
    while len(chosen) < count:
        chosen.append(int(np.argmin(near)))
        near = np.maximum(near, x @ x[chosen[-1]])
    return np.unique(np.array(chosen, dtype=np.int32))


def build_graph(x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Graph and entry nodes over unit vectors, inserted in batches that double in size; two insertions of a batch
    don't see each other, but a second pass over all nodes does."""
    n = len(x)
    rng = np.random.default_rng(seed)
    graph = np.full((n, degree), -1, dtype=np.int32)
    perm = rng.permutation(n).astype(np.int32)
    entries = spread(x, min(ENTRIES, n))
    first = perm[: min(n, 64)]
    graph[first] = robust_prune(x, first, np.broadcast_to(first, (len(first), len(first))), x[first] @ x[first].T, degree, alpha)
    known = np.isin(entries, first)

    def insert(nodes: np.ndarray, starts: np.ndarray) -> None:
        ids, sims = beam_search(x, graph, x[nodes], beam, starts)
        own = graph[nodes]
        own_sims = np.where(own >= 0, np.einsum("mrd,md->mr", x[own], x[nodes]), -2)
        graph[nodes] = robust_prune(x, nodes, np.concatenate([ids, own], axis=1), np.concatenate([sims, own_sims], axis=1), degree, alpha)
        src = np.repeat(nodes, degree)
        dst = graph[nodes].ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        back, first_at, many = np.unique(dst, return_index=True, return_counts=True)
        width = int(many.max()) if len(many) else 0
        for lo in range(0, len(back), QUERY_BLOCK):  # reverse edges, pruned where there are too many
            b, f, c = back[lo : lo + QUERY_BLOCK], first_at[lo : lo + QUERY_BLOCK], many[lo : lo + QUERY_BLOCK]
            width = min(int(c.max()), 4 * degree)
            at = np.arange(width)[None, :]
            new = np.where(at < c[:, None], src[np.minimum(f[:, None] + at, len(src) - 1)], -1)
            cand = np.concatenate([graph[b], new], axis=1)
            s = np.where(cand >= 0, np.einsum("mcd,md->mc", x[cand], x[b]), -2)
            graph[b] = robust_prune(x, b, cand, s, degree, alpha)

    done = len(first)
    starts = entries[known] if known.any() else first[:1]  # of the entries those that are in the graph
    while done < n:
        batch = perm[done : done + min(max(64, done), QUERY_BLOCK)]
        insert(batch, starts)
        done += len(batch)
        starts = entries[np.isin(entries, perm[:done])]
        starts = starts if len(starts) else first[:1]
    for lo in range(0, n, QUERY_BLOCK):
        insert(perm[lo : lo + QUERY_BLOCK], entries)
    return connect(x, graph, entries, beam), entries


def reachable(graph: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Marks of the nodes that a walk from the entries can reach."""
    seen = np.zeros(len(graph), dtype=bool)
    seen[entries] = True
    now = np.unique(entries)
    while len(now):
        near = np.unique(graph[now])
        now = near[near >= 0]
        now = now[~seen[now]]
        seen[now] = True
    return seen


def connect(x: np.ndarray, graph: np.ndarray, entries: np.ndarray, beam: int = BUILD_BEAM) -> np.ndarray:
    """The graph with more edges until every node can be reached: pruning may leave groups of near-equal vectors that only
    point at each other. Each round links the reachable node that a search finds nearest to a lost one to it."""
    while True:
        lost = np.flatnonzero(~reachable(graph, entries))
        if not len(lost):
            return graph
        found, sims = beam_search(x, graph, x[lost], beam, entries)
        order = np.argsort(-sims[:, 0], kind="stable")
        sources, first = np.unique(found[order, 0], return_index=True)  # one new edge for each source
        targets = lost[order][first]
        free = graph[sources] < 0
        if not free.any(axis=1).all():
            graph = np.concatenate([graph, np.full((len(graph), 1), -1, dtype=np.int32)], axis=1)
            free = graph[sources] < 0
        graph[sources, np.argmax(free, axis=1)] = targets


def _unit(values: pd.Series) -> np.ndarray:
    x = np.stack([np.asarray(v, dtype=np.float64) for v in values]) if len(values) else np.empty((0, DIM))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def valid_vectors(vectors: DataFrame, dim: int = DIM) -> DataFrame:
    """(collection, id, embedding) of the valid rows, one per (collection, id): ``dim`` finite numbers, not all zero.

    Where repeats of an id differ, the one that is first in order of its numbers counts.
    """
    ok = (F.size("embedding") == dim) & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & F.exists("embedding", lambda v: v != 0)
    return vectors.select("collection", "id", "embedding").filter(F.col("id").isNotNull() & F.col("collection").isNotNull() & F.coalesce(ok, F.lit(False))).groupBy("collection", "id").agg(F.min("embedding").alias("embedding"))


def _centroids(x: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Spherical k-means."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = np.concatenate([np.argmax(x[i : i + 8192] @ c.T, axis=1) for i in range(0, len(x), 8192)])
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 0, sums / np.maximum(norm, 1e-9), c)
    return c.astype(np.float32)


def fit_shards(valid: DataFrame, shard: int = SHARD, sample: int = SAMPLE) -> dict[str, np.ndarray]:
    """Centroids of each collection, fitted on at most ``sample`` of its vectors; one for about ``shard`` vectors."""
    sizes = {r.collection: r["count"] for r in valid.groupBy("collection").count().collect()}
    pick = Window.partitionBy("collection").orderBy("_h")
    hashed = valid.withColumn("_h", F.xxhash64("id"))
    # Only a share of the rows, chosen by hash, is ranked, so that no window holds a whole collection.
    share = F.create_map(*[v for c, n in sizes.items() for v in (F.lit(c), F.lit(min(1.0, 1.5 * sample / max(n, 1))))]) if sizes else None
    if share is None:
        return {}
    rows = hashed.filter(F.pmod(F.col("_h"), F.lit(1 << 20)) <= share[F.col("collection")] * (1 << 20)).withColumn("_n", F.row_number().over(pick)).filter(F.col("_n") <= sample).select("collection", "embedding").toPandas()
    return {c: _centroids(_unit(g.embedding), min(CENTROIDS_MOST, max(1, round(sizes[c] / shard)))) for c, g in rows.groupby("collection")}


def nearest(vectors: DataFrame, k: int = K, dim: int = DIM, shard: int = SHARD, probes: int = PROBES, beam: int = SEARCH_BEAM) -> DataFrame:
    """(collection, id, neighbour, similarity double, rank int): of each valid vector the k most similar other ids
    of its collection by cosine, nearly all of them found (the recall is measured by the tests).

    Null, wrongly sized, all-zero and non-finite embeddings are left out; repeats of (collection, id) count
    once; equal vectors under different ids are neighbours; ties go by id; a collection of n < k + 1 vectors
    gives n - 1 neighbours; other columns are dropped; an empty table gives no rows.
    """
    valid = common.checkpoint(valid_vectors(vectors, dim))
    fitted = fit_shards(valid, shard)
    groups = min(4096, max(12, 2 * sum(map(len, fitted.values()))))  # tasks: shards are few bytes but much work, so they are not coalesced
    centroids = valid.sparkSession.sparkContext.broadcast(fitted)
    columns = ["collection", "shard", "part", "id", "embedding"]

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            for c, g in df.groupby("collection", sort=False):
                sims = _unit(g.embedding) @ centroids.value[c].T
                near = _top(sims, probes).astype("int32")
                close = np.take_along_axis(sims, near, 1) >= sims[np.arange(len(near)), near[:, 0]][:, None] - MARGIN
                yield pd.DataFrame({"collection": c, "shards": [n[k] for n, k in zip(near, close)], "id": g.id.to_numpy(), "embedding": g.embedding.to_numpy()})

    routed = valid.mapInPandas(assign, "collection string, shards array<int>, id string, embedding array<float>")
    routed = common.checkpoint(routed)
    home = routed.withColumn("shard", F.col("shards")[0])
    # As many rows as there are centroids, CENTROIDS_MOST a collection at most.
    parts = home.groupBy("collection", "shard").agg(F.ceil(F.count("*") / F.lit(SHARD_MOST)).cast("int").alias("parts"))
    stored = home.join(F.broadcast(parts), ["collection", "shard"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    asks = routed.withColumn("shard", F.explode("shards"))
    salts = asks.groupBy("collection", "shard").agg(F.ceil(F.count("*") / F.lit(ASKS)).cast("int").alias("salts")).join(parts, ["collection", "shard"])
    asked = asks.join(F.broadcast(salts), ["collection", "shard"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("salt", F.pmod(F.xxhash64("id", F.lit(1)), F.col("salts")).cast("int"))

    def build(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("id", ignore_index=True)
        x = _unit(own.embedding)
        graph, entries = build_graph(x)
        return pd.DataFrame({"collection": [key[0]], "shard": [key[1]], "part": [key[2]], "names": [own.id.tolist()], "vectors": [x.tobytes()], "graph": [graph.tobytes()], "entries": [entries.tobytes()]})

    graphs = stored.select(*columns).repartition(groups, "collection", "shard", "part").groupBy("collection", "shard", "part").applyInPandas(build, "collection string, shard int, part int, names array<string>, vectors binary, graph binary, entries binary")
    graphs = common.checkpoint(graphs).join(F.broadcast(salts), ["collection", "shard"]).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))

    def search(key: tuple, own: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        out = {"id": [], "neighbour": [], "similarity": []}
        if len(own) and len(asks):
            g = own.iloc[0]
            names = np.array(g["names"], dtype=object)
            x = np.frombuffer(g.vectors, dtype=np.float32).reshape(len(names), -1)
            graph = np.frombuffer(g.graph, dtype=np.int32).reshape(len(names), -1)
            entries = np.frombuffer(g.entries, dtype=np.int32)
            for lo in range(0, len(asks), QUERY_BLOCK):
                block = asks.iloc[lo : lo + QUERY_BLOCK]
                ids, sims = beam_search(x, graph, _unit(block.embedding), max(beam, k + 1), entries)
                qid = block.id.to_numpy()
                hit = (ids >= 0) & (sims > -2)
                hit &= names[ids] != qid[:, None]
                hit &= np.cumsum(hit, axis=1) <= k
                r, j = np.nonzero(hit)
                out["id"].append(qid[r])
                out["neighbour"].append(names[ids[r, j]])
                out["similarity"].append(sims[r, j].astype(np.float64))
        flat = {n: np.concatenate(v) if v else np.array([], dtype=object) for n, v in out.items()}
        return pd.DataFrame(flat).assign(collection=key[0])[["collection", "id", "neighbour", "similarity"]]

    a = graphs.repartition(groups, "collection", "shard", "part", "salt").groupBy("collection", "shard", "part", "salt")
    b = asked.select(*columns, "salt").repartition(groups, "collection", "shard", "part", "salt").groupBy("collection", "shard", "part", "salt")
    hits = a.cogroup(b).applyInPandas(search, "collection string, id string, neighbour string, similarity double")
    best = Window.partitionBy("collection", "id").orderBy(F.col("similarity").desc(), "neighbour")
    return hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def p3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of every valid vector of vectors."""
    return nearest(common.table(spark, sf_dir, "vectors"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p3_found: pairs of at least 0.95, found by the graphs; the similarity is then computed exactly, in double."""
    vectors = common.table(spark, sf_dir, "vectors")
    near = nearest(vectors).filter("similarity >= 0.9499")
    pairs = near.select("collection", F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()
    valid = valid_vectors(vectors)
    a = valid.select("collection", F.col("id").alias("id_a"), F.col("embedding").alias("_a"))
    b = valid.select("collection", F.col("id").alias("id_b"), F.col("embedding").alias("_b"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    both = pairs.join(a, ["collection", "id_a"]).join(b, ["collection", "id_b"])
    return both.filter(dot(F.col("_a"), F.col("_b")) >= 0.95 * F.sqrt(dot(F.col("_a"), F.col("_a")) * dot(F.col("_b"), F.col("_b")))).select("collection", "id_a", "id_b")


QUERIES = {"p3_found": p3_found, "p3_neighbours": p3_neighbours}
SQL: dict[str, str] = {}
