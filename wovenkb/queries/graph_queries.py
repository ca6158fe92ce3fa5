"""Queries of recall, expansion, ranking and fusion."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import expand, rank, stats, store
from ..params import SearchParams
from ..session import checkpoint, table
from .tables import model, with_sql

Q: dict = {}
S: dict[str, str] = {}
P = SearchParams()


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            S[f.__name__] = sql
        return f

    return add


# Orders as events, parts and suppliers as entities


def order_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, entity_id, weight) of orders with their parts and suppliers."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_discount")
    kinds = F.explode(F.array(F.concat(F.lit("p"), F.col("l_partkey").cast("string")), F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))))
    return li.select(F.col("l_orderkey").alias("event_id"), kinds.alias("entity_id"), "l_discount").groupBy("event_id", "entity_id").agg((1 - F.min("l_discount")).alias("weight"))


_BRIDGE = """WITH b AS (SELECT event_id, entity_id, 1 - min(l_discount) AS weight FROM (
SELECT l_orderkey AS event_id, 'p' || l_partkey AS entity_id, l_discount FROM lineitem UNION ALL SELECT l_orderkey, 's' || l_suppkey, l_discount FROM lineitem) GROUP BY 1, 2),
g AS (SELECT entity_id, count(*) AS degree FROM b GROUP BY 1)"""


@query(_BRIDGE + """,
seeds AS (SELECT DISTINCT event_id FROM b ORDER BY event_id LIMIT 5),
n1 AS (SELECT DISTINCT entity_id, degree FROM b JOIN g USING (entity_id) WHERE event_id IN (SELECT event_id FROM seeds)),
k1 AS (SELECT entity_id FROM n1 WHERE degree <= 50 OR (SELECT min(degree) FROM n1) > 50),
seen1 AS (SELECT entity_id FROM n1),
e1 AS (SELECT DISTINCT event_id FROM b WHERE entity_id IN (SELECT entity_id FROM k1) AND event_id NOT IN (SELECT event_id FROM seeds)),
s1 AS (SELECT event_id FROM e1 ORDER BY event_id LIMIT 8),
n2 AS (SELECT DISTINCT entity_id, degree FROM b JOIN g USING (entity_id) WHERE event_id IN (SELECT event_id FROM s1) AND entity_id NOT IN (SELECT entity_id FROM seen1)),
k2 AS (SELECT entity_id FROM n2 WHERE degree <= 50 OR (SELECT min(degree) FROM n2) > 50),
e2 AS (SELECT DISTINCT event_id FROM b WHERE entity_id IN (SELECT entity_id FROM k2) AND event_id NOT IN (SELECT event_id FROM seeds UNION ALL SELECT event_id FROM e1)),
x AS (SELECT event_id, 0 AS depth FROM seeds UNION ALL SELECT event_id, 1 FROM e1 UNION ALL SELECT event_id, 2 FROM e2)
SELECT event_id, depth, round(pow(0.6, depth), 6) AS score, o_orderpriority AS priority FROM x JOIN orders ON o_orderkey = event_id""")
def g3_related_orders(spark, d):
    b = checkpoint(order_bridge(spark, d))  # each hop reads the links
    seeds = b.select("event_id").distinct().orderBy("event_id").limit(5)
    x = expand.expand(seeds, b.select("event_id", "entity_id"), replace(P, degree_method="none", strategy="multi"))
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("event_id"), F.col("o_orderpriority").alias("priority"))
    return x.join(orders, "event_id").select("event_id", "depth", F.round(rank.decayed(F.lit(1.0), F.col("depth"), P), 6).alias("score"), "priority")


flagship = g3_related_orders


def _query_vector(spark: SparkSession, sf_dir: str) -> F.Column:
    """A stored chunk vector stands for the question."""
    v = table(spark, sf_dir, "vectors").filter((F.col("collection") == "chunks") & V.usable(F.col("embedding"), 64)).orderBy("id").select("embedding").first()
    return F.array(*(F.lit(float(x)).cast("float") for x in v.embedding))


_VEC = """q AS (SELECT embedding AS q FROM vectors WHERE collection = 'chunks' AND len(embedding) = 64 AND list_bool_and([coalesce(isfinite(x), false) FOR x IN embedding]) ORDER BY id LIMIT 1),
v AS (SELECT collection, id, source_id, embedding::DOUBLE[] AS e, (SELECT q::DOUBLE[] FROM q) AS qv FROM vectors WHERE len(embedding) = 64),
c AS (SELECT collection, id, any_value(source_id) AS source_id, max(CASE WHEN list_dot_product(e, e) = 0 THEN 0 ELSE list_dot_product(e, qv) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(qv, qv)) + 1e-8) END) AS sim FROM v GROUP BY 1, 2)"""


@query("WITH " + _VEC + " SELECT id, round(sim, 6) AS score FROM c WHERE collection = 'event_titles' AND NOT isnan(sim) ORDER BY sim DESC, id LIMIT 20")
def t1_vector_top_k(spark, d):
    return rank.top_k(table(spark, d, "vectors"), "event_titles", _query_vector(spark, d), 20).withColumn("score", F.round("score", 6))


@query("WITH " + _VEC + " SELECT id, round(sim, 6) AS score FROM (SELECT * FROM c WHERE collection = 'chunks' AND source_id IN (SELECT DISTINCT source_id FROM vectors WHERE source_id IS NOT NULL ORDER BY source_id LIMIT 4) AND NOT isnan(sim) ORDER BY sim DESC, id LIMIT 20) WHERE sim >= 0.1")
def f5_f6_scoped_search(spark, d):
    v = table(spark, d, "vectors")
    own = [r.source_id for r in v.select("source_id").filter("source_id is not null").distinct().orderBy("source_id").limit(4).collect()]
    return rank.top_k(v, "chunks", _query_vector(spark, d), 20, 0.1, own).withColumn("score", F.round("score", 6))


@query("WITH " + _VEC + """, a AS (SELECT id, sim FROM c WHERE collection = 'event_titles' AND NOT isnan(sim) ORDER BY sim DESC, id LIMIT 30), b AS (SELECT id, sim FROM c WHERE collection = 'event_summaries' AND NOT isnan(sim) ORDER BY sim DESC, id LIMIT 30)
SELECT id, round(max(sim), 6) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1""")
def r2_a4_mixed_recall(spark, d):
    q, v = _query_vector(spark, d), table(spark, d, "vectors")
    return rank.merge_hits(rank.top_k(v, "event_titles", q, 30), rank.top_k(v, "event_summaries", q, 30)).withColumn("score", F.round("score", 6))


@query("WITH " + _VEC.replace("CASE WHEN list_dot_product(e, e) = 0 THEN 0 ELSE list_dot_product(e, qv) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(qv, qv)) + 1e-8) END", "1 / (1 + list_dot_product(e, e) - 2 * list_dot_product(e, qv) + list_dot_product(qv, qv))") + " SELECT id, round(sim, 6) AS score FROM c WHERE collection = 'entities' AND NOT isnan(sim) ORDER BY sim DESC, id LIMIT 10")
def r15_l2_top_k(spark, d):
    return rank.top_k(table(spark, d, "vectors"), "entities", _query_vector(spark, d), 10, metric="l2").withColumn("score", F.round("score", 6))


_VALID = "len(embedding) = 64 AND list_bool_and([coalesce(isfinite(x), false) FOR x IN embedding])"


@query(f"""WITH e AS (SELECT id, any_value(embedding)::DOUBLE[] AS e FROM vectors WHERE collection = 'entities' AND {_VALID} GROUP BY 1),
q AS (SELECT id AS query_id, e AS q FROM e ORDER BY id LIMIT 4),
s AS (SELECT query_id, id, CASE WHEN list_dot_product(e, e) = 0 OR list_dot_product(q, q) = 0 THEN 0 ELSE list_dot_product(e, q) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(q, q)) + 1e-8) END AS score FROM e, q),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s)
SELECT query_id, id, round(score, 6) AS score, rank FROM r WHERE rank <= 10 AND score >= 0.5""")
def j10_many_queries(spark, d):
    """The best hits of four entities. Only a handful of searches at once is meant: they are broadcast and compared with every row."""
    v = table(spark, d, "vectors").filter(V.usable(F.col("embedding"), 64))
    queries = v.filter("collection = 'entities'").dropDuplicates(["id"]).orderBy("id").limit(4).select(F.col("id").alias("query_id"), F.col("embedding").alias("query"))
    return rank.top_k_each(v, "entities", queries, P.entity_topk, P.entity_threshold).withColumn("score", F.round("score", 6))


@query("WITH " + _VEC + """, x AS (SELECT id, sim FROM c WHERE collection = 'event_contents' AND sim > 0 AND NOT isnan(sim) AND id IN (SELECT id FROM kb_events WHERE deleted_at IS NULL))
SELECT id AS event_id, round(sim, 6) AS score, row_number() OVER (ORDER BY sim DESC, id) - 1 AS pos FROM x ORDER BY sim DESC, id LIMIT 100""")
def r4_coarse_rank(spark, d):
    events = table(spark, d, "kb_events").filter("deleted_at is null").select(F.col("id").alias("event_id")).distinct()
    v = table(spark, d, "vectors").filter(F.size("embedding") == 64)
    return rank.coarse_rank(events, v, _query_vector(spark, d), P).withColumn("score", F.round("score", 6))


# Degree statistics


_DEG = with_sql("kb_event_entities") + ", g AS (SELECT entity_id, count(*)::DOUBLE AS degree FROM m_event_entities GROUP BY 1)"
_OTSU = """, p AS (SELECT count(*) AS n, min(degree) AS lo, max(degree) AS hi, sum(degree) AS total, least(20, count(*)) AS bins FROM {t}),
h AS (SELECT least(floor((degree - lo) / ((hi - lo) / bins)), bins - 1)::INT AS bin, count(*) AS c FROM {t}, p WHERE hi > lo GROUP BY 1),
a AS (SELECT r.bin, coalesce(h.c, 0) AS c, lo + (r.bin + 0.5) * ((hi - lo) / bins) AS centre, n, total FROM p, (SELECT unnest(range(20))::INT AS bin) r LEFT JOIN h USING (bin) WHERE r.bin < bins AND hi > lo),
w AS (SELECT *, sum(c) OVER (ORDER BY bin) AS wb, sum(c * centre) OVER (ORDER BY bin) AS sb FROM a),
f AS (SELECT bin, centre, wb * (n - wb) * pow(sb / wb - (total - sb) / (n - wb), 2) AS var FROM w WHERE wb > 0 AND wb < n),
otsu AS (SELECT coalesce((SELECT centre FROM f WHERE var > 0 ORDER BY var DESC, bin LIMIT 1), (SELECT hi FROM p)) AS threshold)"""


@query(_DEG + _OTSU.format(t="g") + """, m AS (SELECT quantile_cont(degree, 0.5) AS mid FROM g), d AS (SELECT quantile_cont(abs(degree - (SELECT mid FROM m)), 0.5) AS mad FROM g),
t AS (SELECT quantile_cont(degree, 0.25) AS q1, quantile_cont(degree, 0.75) AS q3 FROM g)
SELECT 'percentile' AS method, round((SELECT quantile_cont(degree, 0.95) FROM g), 6) AS threshold
UNION ALL SELECT 'mad', round(CASE WHEN mad <= 0 THEN 2 * mid ELSE mid + 3 * mad / 0.6745 END, 6) FROM m, d
UNION ALL SELECT 'tukey', round(CASE WHEN q3 - q1 <= 0 THEN 2 * q3 ELSE q3 + 3 * (q3 - q1) END, 6) FROM t
UNION ALL SELECT 'otsu', round(threshold, 6) FROM otsu""")
def g8_g11_thresholds(spark, d):
    deg = store.entity_degrees(model(spark, d, "kb_event_entities"))
    out = None
    for m in ("percentile", "mad", "tukey", "otsu"):
        x = stats.degree_threshold(deg, "degree", m).select(F.lit(m).alias("method"), F.round("threshold", 6).alias("threshold"))
        out = x if out is None else out.unionByName(x)
    return out


@query(_DEG + """, i AS (SELECT entity_id, degree, 1 / (1 + degree) AS idf FROM g),
s AS (SELECT list_sort(list(idf)) AS l, count(*) AS n FROM i),
b AS (SELECT CASE WHEN n < 4 THEN l[1] ELSE l[floor(n * 0.1)::INT + 1] END AS lo, CASE WHEN n < 4 THEN l[n] ELSE l[floor(n * 0.9)::INT + 1] END AS hi FROM s)
SELECT entity_id, round(CASE WHEN hi - lo < 1e-8 THEN 1 ELSE least(greatest((idf - lo) / (hi - lo), 0), 1) END, 6) AS scaled FROM i, b""")
def g7_winsor(spark, d):
    x = store.entity_degrees(model(spark, d, "kb_event_entities")).select("entity_id", (1.0 / (1.0 + F.col("degree"))).alias("idf"))
    return x.crossJoin(F.broadcast(stats.winsor_bounds(x, "idf"))).select("entity_id", F.round(stats.winsor_scale(F.col("idf"), F.col("lo"), F.col("hi")), 6).alias("scaled"))


_FRONTIER = """, fr AS (SELECT e.id AS entity_id, coalesce(g.degree, 0) AS degree FROM (SELECT DISTINCT id FROM kb_entities WHERE entity_type IN ('organization', 'work', 'topic')) e LEFT JOIN g ON g.entity_id = e.id),
ab AS (SELECT * FROM fr WHERE degree <= 50)""" + _OTSU.format(t="ab") + """,
mk AS (SELECT fr.*, degree <= 50 AS by_abs, degree <= 50 AND ((SELECT count(*) FROM ab) < 10 OR degree <= (SELECT threshold FROM otsu)) AS by_method FROM fr),
nn AS (SELECT count(*) AS n, count(*) FILTER (by_abs) AS n_abs, count(*) FILTER (by_method) AS n_method FROM mk),
rl AS (SELECT *, {relaxed} AS relaxed FROM nn), lf AS (SELECT *, CASE WHEN relaxed THEN n_abs ELSE n_method END AS remaining FROM rl),
kp AS (SELECT entity_id, degree, CASE WHEN remaining = 0 THEN true WHEN relaxed THEN by_abs ELSE by_method END AS kept FROM mk, lf)"""


@query(_DEG + _FRONTIER.format(relaxed="n_method < greatest(10, 5) AND n_abs < n AND n_abs >= 10") + " SELECT entity_id, degree::BIGINT AS degree, kept, NOT kept AS rejected FROM kp")
def g2_seed_filter(spark, d):
    return expand.degree_filter(_entity_frontier(spark, d), P, seeds=True)


@query(_DEG + _FRONTIER.format(relaxed="n_method < greatest(floor(n / 2), 5) AND n_abs < n") + " SELECT entity_id, degree::BIGINT AS degree, kept, NOT kept AND degree > 50 AS rejected FROM kp")
def g4_g5_frontier_filter(spark, d):
    return expand.degree_filter(_entity_frontier(spark, d), P)


def _entity_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "kb_entities").filter("entity_type in ('organization', 'work', 'topic')").select(F.col("id").alias("entity_id")).distinct()
    return store.entity_degrees(model(spark, sf_dir, "kb_event_entities"), ids)


@query(_DEG + ", " + _VEC + """, fr AS (SELECT e.id AS entity_id, coalesce(g.degree, 0) AS degree FROM (SELECT DISTINCT id FROM kb_entities WHERE entity_type IN ('organization', 'work', 'topic')) e LEFT JOIN g ON g.entity_id = e.id),
x AS (SELECT fr.entity_id, 1 / (1 + degree) AS idf, greatest(coalesce(c.sim, 0), 0) AS s FROM fr LEFT JOIN (SELECT * FROM c WHERE collection = 'entities' AND NOT isnan(sim)) c ON c.id = fr.entity_id),
o AS (SELECT list_sort(list(idf)) AS a, list_sort(list(s)) AS b, count(*) AS n FROM x),
bd AS (SELECT CASE WHEN n < 4 THEN a[1] ELSE a[floor(n * 0.1)::INT + 1] END AS il, CASE WHEN n < 4 THEN a[n] ELSE a[floor(n * 0.9)::INT + 1] END AS ih, CASE WHEN n < 4 THEN b[1] ELSE b[floor(n * 0.1)::INT + 1] END AS sl, CASE WHEN n < 4 THEN b[n] ELSE b[floor(n * 0.9)::INT + 1] END AS sh FROM o)
SELECT entity_id, round(0.4 * CASE WHEN ih - il < 1e-8 THEN 1 ELSE least(greatest((idf - il) / (ih - il), 0), 1) END + 0.6 * CASE WHEN sh - sl < 1e-8 THEN 1 ELSE least(greatest((s - sl) / (sh - sl), 0), 1) END, 5) AS score FROM x, bd""")
def g6_frontier_scores(spark, d):
    sims = expand.query_similarity(table(spark, d, "vectors").filter(F.size("embedding") == 64), "entities", _query_vector(spark, d), "entity_id").filter(~F.isnan("sim"))
    return expand.frontier_scores(_entity_frontier(spark, d), sims, P).select("entity_id", F.round("score", 5).alias("score"))


def _kb_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model(spark, sf_dir, "kb_event_entities").select("event_id").distinct().orderBy("event_id").limit(5)


_KB_BFS = _DEG.replace("count(*)::DOUBLE", "count(*)") + """, seeds AS (SELECT DISTINCT event_id FROM m_event_entities ORDER BY event_id LIMIT 5),
n1 AS (SELECT DISTINCT entity_id, degree FROM m_event_entities JOIN g USING (entity_id) WHERE event_id IN (SELECT event_id FROM seeds)),
k1 AS (SELECT entity_id FROM n1 WHERE degree <= 50 OR (SELECT min(degree) FROM n1) > 50),
e1 AS (SELECT DISTINCT event_id FROM m_event_entities WHERE entity_id IN (SELECT entity_id FROM k1) AND event_id NOT IN (SELECT event_id FROM seeds))"""


@query(_KB_BFS + " SELECT event_id, 0 AS depth FROM seeds UNION ALL SELECT event_id, 1 FROM e1")
def g3_one_hop(spark, d):
    links = model(spark, d, "kb_event_entities").select("event_id", "entity_id")
    return expand.expand(_kb_seeds(spark, d), links, replace(P, max_hops=1, degree_method="none"))


@query("WITH " + _VEC + ", " + with_sql("kb_event_entities")[5:] + """, sm AS (SELECT id AS event_id, sim FROM c WHERE collection = 'event_summaries' AND NOT isnan(sim)),
seeds AS (SELECT DISTINCT event_id FROM m_event_entities ORDER BY event_id LIMIT 5),
f1 AS (SELECT DISTINCT entity_id FROM m_event_entities WHERE event_id IN (SELECT event_id FROM seeds) ORDER BY entity_id LIMIT 100),
r1 AS (SELECT DISTINCT event_id FROM m_event_entities WHERE entity_id IN (SELECT entity_id FROM f1) AND event_id NOT IN (SELECT event_id FROM seeds)),
e1 AS (SELECT event_id, coalesce(sim, 0) AS sim FROM r1 LEFT JOIN sm USING (event_id) WHERE coalesce(sim, 0) >= 0.05),
s1 AS (SELECT event_id FROM e1 WHERE (SELECT max(sim) FROM e1) >= 0.1 ORDER BY sim DESC, event_id LIMIT 8),
f2 AS (SELECT DISTINCT entity_id FROM m_event_entities WHERE event_id IN (SELECT event_id FROM s1) AND entity_id NOT IN (SELECT entity_id FROM f1) ORDER BY entity_id LIMIT 100),
e2 AS (SELECT DISTINCT event_id FROM m_event_entities LEFT JOIN sm USING (event_id) WHERE entity_id IN (SELECT entity_id FROM f2) AND event_id NOT IN (SELECT event_id FROM seeds UNION ALL SELECT event_id FROM r1) AND coalesce(sim, 0) >= 0.05)
SELECT event_id, 0 AS depth FROM seeds UNION ALL SELECT event_id, 1 FROM e1 UNION ALL SELECT event_id, 2 FROM e2""")
def g13_g14_steered_expansion(spark, d):
    """Two hops without a frontier filter, steered by summary similarity, with a soft threshold."""
    v = table(spark, d, "vectors").filter(F.size("embedding") == 64)
    of = expand.similarity_of(v, "event_summaries", _query_vector(spark, d), "event_id")
    links = model(spark, d, "kb_event_entities").select("event_id", "entity_id")
    return expand.expand(_kb_seeds(spark, d), links, replace(P, soft_threshold=0.05, hop_relevance=0.1, frontier_filter=False), event_similarity=lambda ids: of(ids).filter(~F.isnan("sim")))


@query(_KB_BFS + ", x AS (SELECT event_id, 0 AS depth FROM seeds UNION ALL SELECT event_id, 1 FROM e1) SELECT depth, count(*) AS events FROM x GROUP BY 1")
def a5_depths(spark, d):
    return expand.depth_histogram(g3_one_hop(spark, d))


@query(with_sql("kb_entities", "kb_event_entities") + """, ex AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS pos FROM m_entities WHERE entity_type = 'topic'),
nr AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS pos FROM m_entities WHERE entity_type IN ('topic', 'metric')),
u AS (SELECT id, min((part, pos)) AS place FROM (SELECT id, 0 AS part, pos FROM ex UNION ALL SELECT id, 1, pos FROM nr) GROUP BY 1)
SELECT id AS entity_id, row_number() OVER (ORDER BY place, id) - 1 AS pos FROM u ORDER BY place, id LIMIT 200""")
def g1_recall_entities(spark, d):
    e = model(spark, d, "kb_entities")
    number = lambda x: x.select(F.col("id").alias("entity_id"), (F.row_number().over(Window.orderBy("id")) - 1).alias("pos"))
    links, events = model(spark, d, "kb_event_entities"), model(spark, d, "kb_events")
    return expand.recall_entities(number(e.filter("entity_type = 'topic'")), number(e.filter("entity_type in ('topic', 'metric')")), links, events, P).select("entity_id", "pos")


# Rerank and fusion


_RERANK = with_sql("kb_events", "kb_event_entities", "kb_chunks") + ", " + _VEC + """,
x AS (SELECT id AS event_id, sim AS score FROM c WHERE collection = 'event_contents' AND sim > 0 AND NOT isnan(sim) AND id IN (SELECT id FROM m_events WHERE deleted_at IS NULL)),
co AS (SELECT event_id, score, row_number() OVER (ORDER BY score DESC, event_id) - 1 AS pos FROM x ORDER BY score DESC, event_id LIMIT 100),
qe AS (SELECT DISTINCT entity_id FROM m_event_entities JOIN co USING (event_id) WHERE pos < 3),
raw AS (SELECT entity_id, ln((SELECT count(*) FROM co)::DOUBLE / count(*)) AS r FROM m_event_entities WHERE entity_id IN (SELECT entity_id FROM qe) GROUP BY 1),
idf AS (SELECT entity_id, CASE WHEN (SELECT max(r) FROM raw) > 0 THEN r / (SELECT max(r) FROM raw) ELSE 0 END AS idf FROM raw),
sg AS (SELECT event_id, entity_id, coalesce(weight, 0.5) * idf AS signal FROM m_event_entities JOIN co USING (event_id) JOIN idf USING (entity_id)),
n AS (SELECT event_id, count(*) FILTER (signal >= 0.7) AS strong, count(*) FILTER (signal >= 0.4 AND signal < 0.7) AS medium, count(*) FILTER (signal < 0.4) AS weak FROM sg GROUP BY 1),
de AS (SELECT event_id, score, score * pow(0.6, CASE WHEN event_id IN (SELECT event_id FROM n) THEN 0 ELSE 1 END) AS adjusted, coalesce(strong, 0) AS strong FROM co LEFT JOIN n USING (event_id)),
rr AS (SELECT event_id, adjusted AS score, row_number() OVER (ORDER BY adjusted DESC, strong DESC, event_id) - 1 AS pos FROM de),
top AS (SELECT * FROM rr WHERE pos < {n}),
sec AS (SELECT c.id AS chunk_id, min(top.pos) AS p, arg_min(score, top.pos) AS score FROM top JOIN m_events e ON e.id = top.event_id JOIN m_chunks c ON c.id = e.chunk_id GROUP BY 1),
sx AS (SELECT chunk_id, score, row_number() OVER (ORDER BY p, chunk_id) - 1 AS pos FROM sec)"""


def _ranked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Candidates by a question's vector, the links, and the entities of the three best as those of the question."""
    e = model(spark, sf_dir, "kb_events").filter("deleted_at is null").select(F.col("id").alias("event_id"))
    coarse = checkpoint(rank.coarse_rank(e, table(spark, sf_dir, "vectors").filter(F.size("embedding") == 64), _query_vector(spark, sf_dir), P))
    links = model(spark, sf_dir, "kb_event_entities")
    return coarse, links, links.join(coarse.filter("pos < 3"), "event_id", "left_semi").select("entity_id").distinct()


def _rerank_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Coarse scores, depths (0 for events of the question's entities, 1 for others) and counts of signals."""
    coarse, links, entities = _ranked(spark, sf_dir)
    counts = rank.signal_counts(rank.question_signals(links, coarse, entities, P))
    depths = coarse.select("event_id").join(counts.select("event_id", F.lit(0).alias("d")), "event_id", "left").select("event_id", F.coalesce("d", F.lit(1)).alias("depth"))
    return coarse, depths, counts


@query(_RERANK.format(n=5) + " SELECT event_id, entity_id, round(signal, 6) AS signal, CASE WHEN signal >= 0.7 THEN 'strong' WHEN signal >= 0.4 THEN 'medium' ELSE 'weak' END AS kind FROM sg")
def r7_r8_signals(spark, d):
    """Signals of the question's entities in the candidates, N being the number of candidates."""
    coarse, links, entities = _ranked(spark, d)
    return rank.question_signals(links, coarse, entities, P).withColumn("signal", F.round("signal", 6))


@query(_RERANK.format(n=5) + " SELECT * FROM n")
def a6_signal_counts(spark, d):
    return _rerank_inputs(spark, d)[2]


@query(_RERANK.format(n=5) + " SELECT event_id, round(score, 6) AS score, pos FROM top")
def r6_r9_rerank(spark, d):
    return rank.rerank(*_rerank_inputs(spark, d), P).withColumn("score", F.round("score", 6))


@query(_RERANK.format(n=5) + """, o AS (SELECT pos, row_number() OVER (ORDER BY strong DESC, pos DESC) - 1 AS place FROM co LEFT JOIN n USING (event_id) WHERE strong > 0),
y AS (SELECT event_id, score, row_number() OVER (ORDER BY place NULLS LAST, co.pos) - 1 AS pos FROM co LEFT JOIN o ON o.pos = co.pos)
SELECT event_id, round(score, 6) AS score, pos FROM y WHERE pos < 5""")
def r9_rerank_with_model(spark, d):
    """A stand-in for a model: events with strong signals first, and it names one place twice and one that isn't there."""
    def order(rows: list[dict]) -> list[int]:
        told = sorted((i for i, r in enumerate(rows) if r["strong"]), key=lambda i: (-rows[i]["strong"], -i))
        return [*told, *told[:1], len(rows) + 7]

    events = model(spark, d, "kb_events").select(F.col("id").alias("event_id"), "title", "summary")
    return rank.rerank_with(*_rerank_inputs(spark, d), events, order, P).withColumn("score", F.round("score", 6))


@query("WITH " + _VEC + ", " + with_sql("kb_events")[5:] + " SELECT id AS event_id, 0.0::DOUBLE AS score, row_number() OVER (ORDER BY id) - 1 AS pos FROM m_events WHERE deleted_at IS NULL ORDER BY id LIMIT 100")
def r5_coarse_fallback(spark, d):
    """No score reaches the threshold: the first events stand with score 0."""
    e = model(spark, d, "kb_events").filter("deleted_at is null").select(F.col("id").alias("event_id"))
    return rank.coarse_rank(e, table(spark, d, "vectors").filter(F.size("embedding") == 64), _query_vector(spark, d), replace(P, coarse_threshold=2.0))


@query("WITH " + _VEC + ", " + with_sql("kb_events", "kb_event_entities")[5:] + """,
ne AS (SELECT id FROM c WHERE collection = 'entities' AND NOT isnan(sim) ORDER BY sim DESC, id LIMIT 10),
be AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS pos FROM (SELECT DISTINCT event_id FROM m_event_entities WHERE entity_id IN (SELECT id FROM ne) AND event_id IN (SELECT id FROM m_events WHERE deleted_at IS NULL))),
bv AS (SELECT id AS event_id, row_number() OVER (ORDER BY sim DESC, id) - 1 AS pos FROM c WHERE collection = 'event_titles' AND NOT isnan(sim) ORDER BY sim DESC, id LIMIT 30),
u AS (SELECT event_id, min((part, pos)) AS place FROM (SELECT event_id, 0 AS part, pos FROM be UNION ALL SELECT event_id, 1, pos FROM bv) GROUP BY 1)
SELECT event_id, row_number() OVER (ORDER BY place, event_id) - 1 AS pos FROM u""")
def r3_seed_merge(spark, d):
    """Seeds by entities first, then those by vectors, each once."""
    q, v, links = _query_vector(spark, d), table(spark, d, "vectors"), model(spark, d, "kb_event_entities")
    live = model(spark, d, "kb_events").filter("deleted_at is null").select(F.col("id").alias("event_id"))
    near = rank.top_k(v, "entities", q, 10).select(F.col("id").alias("entity_id"))
    by_entity = store.events_of_entities(near, links).join(live, "event_id", "left_semi").select("event_id", (F.row_number().over(Window.orderBy("event_id")) - 1).alias("pos"))
    by_vector = rank.top_k(v, "event_titles", q, 30).select(F.col("id").alias("event_id"), (F.row_number().over(Window.orderBy(F.col("score").desc(), "id")) - 1).alias("pos"))
    return rank.ordered_union(by_entity, by_vector, "event_id")


@query(_RERANK.format(n=5) + " SELECT chunk_id, round(score, 6) AS score, pos FROM sx")
def r10_sections(spark, d):
    return rank.sections_of_events(rank.rerank(*_rerank_inputs(spark, d), P), model(spark, d, "kb_events"), model(spark, d, "kb_chunks")).withColumn("score", F.round("score", 6))


_DIRECT = ", dr AS (SELECT id AS chunk_id, row_number() OVER (ORDER BY sim DESC, id) - 1 AS pos FROM c WHERE collection = 'chunks' AND NOT isnan(sim) ORDER BY sim DESC, id LIMIT 20)"


def _direct(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = rank.top_k(table(spark, sf_dir, "vectors"), "chunks", _query_vector(spark, sf_dir), 20)
    return hits.select(F.col("id").alias("chunk_id"), (F.row_number().over(Window.orderBy(F.col("score").desc(), "id")) - 1).alias("pos"))


def _fused(spark: SparkSession, sf_dir: str, how: str) -> DataFrame:
    sections = rank.sections_of_events(rank.rerank(*_rerank_inputs(spark, sf_dir), replace(P, rerank_top=3)), model(spark, sf_dir, "kb_events"), model(spark, sf_dir, "kb_chunks"))
    return rank.fuse(sections, _direct(spark, sf_dir), replace(P, fusion=how))


@query(_RERANK.format(n=3) + _DIRECT + """, u AS (SELECT chunk_id, 0 AS part, pos FROM sx WHERE pos < 5 UNION ALL SELECT chunk_id, 1, pos FROM dr WHERE pos < 10 - (SELECT count(*) FROM sx WHERE pos < 5)),
o AS (SELECT chunk_id, min((part, pos)) AS place FROM u GROUP BY 1), f AS (SELECT chunk_id, row_number() OVER (ORDER BY place, chunk_id) - 1 AS pos FROM o) SELECT * FROM f WHERE pos < 10""")
def r11_fuse_concat(spark, d):
    return _fused(spark, d, "concat")


@query(_RERANK.format(n=3) + _DIRECT + """, dx AS (SELECT chunk_id, row_number() OVER (ORDER BY pos) - 1 AS pos FROM dr WHERE chunk_id NOT IN (SELECT chunk_id FROM sx WHERE pos < 5)),
u AS (SELECT chunk_id, 0 AS part, pos FROM sx WHERE pos < 5 UNION ALL SELECT chunk_id, 1, pos FROM dx WHERE pos < 5 - (SELECT count(*) FROM sx WHERE pos < 5)),
o AS (SELECT chunk_id, min((part, pos)) AS place FROM u GROUP BY 1), f AS (SELECT chunk_id, row_number() OVER (ORDER BY place, chunk_id) - 1 AS pos FROM o) SELECT * FROM f WHERE pos < 5""")
def r12_fuse_supplement(spark, d):
    return _fused(spark, d, "supplement")


@query(with_sql("kb_chunks", "kb_sources") + " SELECT c.id AS chunk_id, coalesce(s.name, '') AS source_name FROM m_chunks c LEFT JOIN m_sources s ON s.id = c.source_id")
def r14_source_names(spark, d):
    return store.attach_source_names(model(spark, d, "kb_chunks").select(F.col("id").alias("chunk_id"), "source_id"), model(spark, d, "kb_sources")).select("chunk_id", "source_name")


@query(with_sql("kb_events") + """, ca AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS pos FROM m_events ORDER BY id LIMIT 6),
o AS (SELECT * FROM (VALUES (4, 0), (9, 1), (1, 2), (4, 3)) t(i, place)), g AS (SELECT i, min(place) AS place FROM o WHERE i < 6 GROUP BY 1)
SELECT * FROM (SELECT id, row_number() OVER (ORDER BY place NULLS LAST, pos) - 1 AS rank FROM ca LEFT JOIN g ON g.i = ca.pos) WHERE rank < 5""")
def r9_model_order(spark, d):
    ids = model(spark, d, "kb_events").select("id").orderBy("id").limit(6)
    cand = ids.withColumn("pos", F.row_number().over(Window.orderBy("id")) - 1)
    return rank.apply_order(cand, spark.createDataFrame([(4, 0), (9, 1), (1, 2), (4, 3)], "index int, at int"), 5)
