"""Queries over the stored tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from ..operators import store
from ..plans import ingest as plan
from ..plans import search
from ..session import shared_folder, table
from ..sources.readers import Catalog
from .tables import model, with_sql

Q: dict = {}
S: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            S[f.__name__] = sql
        return f

    return add


def _first_sources(spark: SparkSession, sf_dir: str, n: int) -> list[str]:
    return [r.id for r in model(spark, sf_dir, "kb_sources").select("id").orderBy("id").limit(n).collect()]


def _frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model(spark, sf_dir, "kb_entities").filter("entity_type = 'work'").select(F.col("id").alias("entity_id"))


_SRC = "(SELECT id FROM m_sources ORDER BY id LIMIT {n})"


@query(with_sql("kb_event_entities") + " SELECT entity_id, count(*) AS degree FROM m_event_entities GROUP BY 1")
def a1_entity_degree(spark, d):
    return store.entity_degrees(model(spark, d, "kb_event_entities"))


@query(with_sql("kb_sources", "kb_chunks", "kb_events") + """
SELECT 'sources' AS what, count(*) AS n FROM m_sources WHERE archived_at IS NULL
UNION ALL SELECT 'chunks', count(*) FROM m_chunks WHERE source_id IN """ + _SRC.format(n=3) + """
UNION ALL SELECT 'events', count(*) FROM m_events WHERE source_id IN """ + _SRC.format(n=3))
def a2_counts(spark, d):
    own = _first_sources(spark, d, 3)
    count = lambda df, what: df.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")
    live = count(model(spark, d, "kb_sources").filter("archived_at is null"), "sources")
    return live.unionByName(count(store.in_sources(model(spark, d, "kb_chunks"), own), "chunks")).unionByName(count(store.in_sources(model(spark, d, "kb_events"), own), "events"))


@query(with_sql("kb_sources") + " SELECT count(*) FILTER (archived_at IS NULL) AS live, count(*) FILTER (archived_at IS NOT NULL) AS archived FROM m_sources")
def a3_stats(spark, d):
    return store.source_stats(model(spark, d, "kb_sources"))


@query(with_sql("kb_event_entities", "kb_entities", "kb_events", "kb_sources") + """
SELECT DISTINCT l.event_id FROM m_event_entities l JOIN m_entities e ON l.entity_id = e.id JOIN m_events v ON v.id = l.event_id
WHERE e.entity_type = 'work' AND v.source_id IN """ + _SRC.format(n=10) + " AND l.event_id NOT IN (SELECT id FROM m_events ORDER BY id LIMIT 50)")
def j1_events_of_entities(spark, d):
    events = model(spark, d, "kb_events")
    exclude = events.select(F.col("id").alias("event_id")).orderBy("event_id").limit(50)
    return store.events_of_entities(_frontier(spark, d), model(spark, d, "kb_event_entities"), events, _first_sources(spark, d, 10), exclude)


@query(with_sql("kb_event_entities", "kb_entities", "kb_events", "kb_sources") + """
SELECT id, entity_type, normalized_name FROM m_entities e WHERE normalized_name IN ('approval', 'highrisk', 'creditreview', '2024-q3', 'overdueratio', '撤回')
AND EXISTS (SELECT 1 FROM m_event_entities l JOIN m_events v ON v.id = l.event_id WHERE l.entity_id = e.id AND v.source_id IN """ + _SRC.format(n=20) + ")")
def j2_exact_entities(spark, d):
    names = ["Approval", "High  risk", "credit review", "2024-Q3", "overdue ratio", "撤回"]
    x = store.exact_entities(model(spark, d, "kb_entities"), model(spark, d, "kb_event_entities"), model(spark, d, "kb_events"), names, _first_sources(spark, d, 20))
    return x.select("id", "entity_type", "normalized_name")


@query(with_sql("kb_event_entities", "kb_events") + """,
w AS (SELECT id AS event_id, row_number() OVER (ORDER BY rank_index DESC NULLS LAST, id) - 1 AS pos FROM m_events ORDER BY pos LIMIT 200)
SELECT w.event_id, w.pos, v.title, count(l.entity_id) AS n_entities, coalesce(string_agg(l.entity_id, ',' ORDER BY l.entity_id), '') AS entities,
round(coalesce(sum(coalesce(l.weight, 0.5)) FILTER (l.entity_id IS NOT NULL), 0), 6) AS weights
FROM w JOIN m_events v ON v.id = w.event_id LEFT JOIN m_event_entities l ON l.event_id = w.event_id GROUP BY ALL""")
def j3_events_with_roles(spark, d):
    from pyspark.sql import Window

    events = model(spark, d, "kb_events")
    first = events.orderBy(F.col("rank_index").desc_nulls_last(), "id").limit(200)
    wanted = first.select(F.col("id").alias("event_id"), (F.row_number().over(Window.orderBy(F.col("rank_index").desc_nulls_last(), "id")) - 1).cast("bigint").alias("pos"))
    x = store.events_with_roles(wanted, events, model(spark, d, "kb_event_entities"))
    total = F.aggregate(F.map_values("entity_weights"), F.lit(0.0), lambda s, v: s + v)
    return x.select("event_id", "pos", "title", F.coalesce(F.size("entity_ids"), F.lit(0)).cast("bigint").alias("n_entities"), F.coalesce(F.array_join("entity_ids", ","), F.lit("")).alias("entities"), F.round(F.coalesce(total, F.lit(0.0)), 6).alias("weights"))


@query(with_sql("kb_event_entities", "kb_events", "kb_sources") + """
SELECT l.event_id, l.entity_id, l.description AS role, coalesce(l.weight, 0.5) AS weight FROM m_event_entities l JOIN m_events v ON v.id = l.event_id WHERE v.source_id IN """ + _SRC.format(n=5))
def j4_roles(spark, d):
    ids = store.in_sources(model(spark, d, "kb_events"), _first_sources(spark, d, 5)).select(F.col("id").alias("event_id"))
    return store.roles_of_events(ids, model(spark, d, "kb_event_entities"))


@query(with_sql("kb_events", "kb_chunks") + " SELECT e.id AS event_id, c.id AS chunk_id, c.heading FROM m_events e JOIN m_chunks c ON c.id = e.chunk_id WHERE e.deleted_at IS NULL")
def j5_chunks_of_events(spark, d):
    wanted = model(spark, d, "kb_events").filter("deleted_at is null").select(F.col("id").alias("event_id"), "chunk_id")
    return store.chunks_in_order(wanted, model(spark, d, "kb_chunks").select("id", "heading")).select("event_id", "chunk_id", "heading")


@query(with_sql("kb_sources") + " SELECT id, name FROM m_sources WHERE name = (SELECT name FROM m_sources WHERE md5 <> '' AND archived_at IS NULL ORDER BY id LIMIT 1) AND md5 = (SELECT md5 FROM m_sources WHERE md5 <> '' AND archived_at IS NULL ORDER BY id LIMIT 1) AND md5 <> '' AND archived_at IS NULL")
def f2_duplicates(spark, d):
    s = model(spark, d, "kb_sources")
    r = s.filter("md5 <> '' and archived_at is null").orderBy("id").select("name", "md5").first()
    return store.duplicates_of(s, r.name, r.md5).select("id", "name")


@query(with_sql("kb_sources") + " SELECT id, name FROM m_sources WHERE archived_at IS NULL AND contains(name, 'a') ORDER BY created_at DESC NULLS LAST, id LIMIT 10 OFFSET 5")
def f3_list_sources(spark, d):
    return store.list_sources(model(spark, d, "kb_sources"), "a", limit=10, offset=5).select("id", "name")


@query(with_sql("kb_sources", "kb_documents") + """
SELECT d.id AS document_id, d.source_id, s.name AS source_name, d.title,
CASE WHEN p > 0 THEN (CASE WHEN p > 81 THEN '...' ELSE '' END) || substr(content, greatest(p - 80, 1)::BIGINT, (least(p + 4 + 80, length(content)) - greatest(p - 80, 1) + 1)::BIGINT) || (CASE WHEN p + 84 < length(content) THEN '...' ELSE '' END)
ELSE substr(content, 1, 160) END AS snippet
FROM (SELECT *, instr(lower(content), 'audit') AS p FROM m_documents WHERE contains(content, 'audit')) d JOIN m_sources s ON s.id = d.source_id AND s.archived_at IS NULL
ORDER BY d.created_at DESC NULLS LAST, d.id LIMIT 20""")
def f4_full_text(spark, d):
    return store.full_text_search(model(spark, d, "kb_documents"), model(spark, d, "kb_sources"), "audit").drop("created_at")


@query(with_sql("kb_entities", "kb_event_entities", "kb_events", "kb_sources") + """
SELECT DISTINCT e.id AS entity_id FROM m_entities e WHERE EXISTS (SELECT 1 FROM m_event_entities l JOIN m_events v ON v.id = l.event_id WHERE l.entity_id = e.id AND v.source_id IN """ + _SRC.format(n=2) + ")")
def f7_scope_entities(spark, d):
    ids = model(spark, d, "kb_entities").select(F.col("id").alias("entity_id"))
    return store.scope_entities(ids, model(spark, d, "kb_event_entities"), model(spark, d, "kb_events"), _first_sources(spark, d, 2))


@query(with_sql("kb_documents", "kb_sources") + " SELECT id, title FROM m_documents WHERE source_id = " + _SRC.format(n=1) + " ORDER BY created_at DESC NULLS LAST, id LIMIT 1")
def f8_latest_document(spark, d):
    return store.latest_document(model(spark, d, "kb_documents"), _first_sources(spark, d, 1)[0]).select("id", "title")


@query("""SELECT DISTINCT v, CASE WHEN trim(v) = '' THEN NULL WHEN lower(trim(v)) IN ('true', '1', 'on') THEN true WHEN lower(trim(v)) IN ('false', '0', 'off') THEN false ELSE true END AS flag,
CASE WHEN lower(trim(v)) IN ('completed', 'failed') THEN lower(trim(v)) END AS known FROM (SELECT status AS v FROM kb_documents UNION ALL SELECT * FROM (VALUES ('On'), (' 0 '), (''), ('maybe'), ('yes'), ('No')) t(v)) WHERE v IS NOT NULL""")
def f9_flags(spark, d):
    more = spark.createDataFrame([("On",), (" 0 ",), ("",), ("maybe",), ("yes",), ("No",)], "v string")
    v = table(spark, d, "kb_documents").select(F.col("status").alias("v")).unionByName(more).filter("v is not null").distinct()
    return v.select("v", text.parse_flag(F.col("v"), True).alias("flag"), text.known_or_null(F.col("v"), ("completed", "failed")).alias("known"))


# Mutations, as the state after them


@query(with_sql("kb_sources") + """,
n AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY id) AS r FROM m_sources) WHERE r <= 5)
SELECT id, name, false AS vector_synced, md5 FROM (SELECT id, upper(name) AS name, 'x' AS md5 FROM n UNION ALL SELECT 'new-1', 'New source', 'y')
UNION ALL SELECT id, name, vector_synced, md5 FROM m_sources WHERE id NOT IN (SELECT id FROM n)""")
def k2_upsert_sources(spark, d):
    s = model(spark, d, "kb_sources").select("id", "name", "vector_synced", "md5")
    new = s.orderBy("id").limit(5).select("id", F.upper("name").alias("name"), F.lit(False).alias("vector_synced"), F.lit("x").alias("md5"))
    new = new.unionByName(spark.createDataFrame([("new-1", "New source", False, "y")], new.schema))
    return store.upsert(s, new, ["id"], ["name", "vector_synced", "md5"])


_MENTIONS = """,
t AS (SELECT *, lower(trim(type)) AS entity_type, lower(regexp_replace(name, '[\\s\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{0085}\\x{000B}]+', '', 'g')) AS normalized_name FROM extracted_entities),
i AS (SELECT *  FROM t WHERE normalized_name <> '' AND entity_type <> ''),
n AS (SELECT entity_type, normalized_name, arg_max(name, (mention_id, name)) AS new_name FROM i GROUP BY 1, 2),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_type, normalized_name ORDER BY created_at NULLS LAST, id) AS r FROM m_entities) WHERE r = 1),
u AS (SELECT entity_type, normalized_name, o.id AS old_id, coalesce(new_name, o.name) AS name FROM o FULL JOIN n USING (entity_type, normalized_name))
"""


@query(with_sql("kb_entities") + _MENTIONS + " SELECT entity_type, normalized_name, old_id IS NULL AS is_new, name, CASE WHEN old_id IS NULL THEN sha256(entity_type || chr(31) || normalized_name) ELSE old_id END AS id FROM u")
def k4_upsert_entities(spark, d):
    x = store.upsert_entities(model(spark, d, "kb_entities"), table(spark, d, "extracted_entities"))
    return x.select("entity_type", "normalized_name", (F.length("id") == 64).alias("is_new"), "name", "id")


@query(with_sql("kb_entities", "kb_event_entities") + _MENTIONS + """,
x AS (SELECT t.event_id, t.weight, t.role, t.ordinal, t.mention_id, CASE WHEN old_id IS NULL THEN sha256(entity_type || chr(31) || normalized_name) ELSE old_id END AS entity_id FROM t JOIN u USING (entity_type, normalized_name)),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id, entity_id ORDER BY ordinal NULLS LAST, mention_id) AS r FROM x) WHERE r = 1)
SELECT event_id, entity_id, weight, role FROM f WHERE NOT EXISTS (SELECT 1 FROM m_event_entities l WHERE l.event_id = f.event_id AND l.entity_id = f.entity_id)""")
def k5_new_links(spark, d):
    mentions = table(spark, d, "extracted_entities")
    return store.new_links(mentions, store.upsert_entities(model(spark, d, "kb_entities"), mentions), model(spark, d, "kb_event_entities"))


def _all(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    names = {"sources": "kb_sources", "documents": "kb_documents", "chunks": "kb_chunks", "events": "kb_events", "entities": "kb_entities", "links": "kb_event_entities"}
    return {k: model(spark, sf_dir, v) for k, v in names.items()}


def _counts(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name in ("sources", "documents", "chunks", "events", "entities", "links", "orphans"):
        x = tables[name].agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n")
        out = x if out is None else out.unionByName(x)
    return out


_DELETE = with_sql("kb_sources", "kb_documents", "kb_chunks", "kb_events", "kb_entities", "kb_event_entities") + """,
s AS (SELECT source_id AS id FROM m_documents WHERE source_id IS NOT NULL ORDER BY source_id LIMIT 1), dd AS (SELECT id FROM m_documents WHERE source_id = (SELECT id FROM s) ORDER BY id LIMIT 1),
gone AS (SELECT id FROM m_events WHERE source_id = (SELECT id FROM s) {and_event}),
l AS (SELECT * FROM m_event_entities WHERE event_id NOT IN (SELECT id FROM gone)),
orphans AS (SELECT DISTINCT entity_id FROM m_event_entities WHERE event_id IN (SELECT id FROM gone) AND entity_id NOT IN (SELECT entity_id FROM l))
SELECT 'sources' AS what, count(*) AS n FROM m_sources WHERE {sources}
UNION ALL SELECT 'documents', count(*) FROM m_documents WHERE NOT coalesce(source_id = (SELECT id FROM s) {and_doc}, false)
UNION ALL SELECT 'chunks', count(*) FROM m_chunks WHERE NOT coalesce(source_id = (SELECT id FROM s) {and_event}, false)
UNION ALL SELECT 'events', count(*) FROM m_events WHERE NOT coalesce(source_id = (SELECT id FROM s) {and_event}, false)
UNION ALL SELECT 'entities', count(*) FROM m_entities WHERE id NOT IN (SELECT entity_id FROM orphans)
UNION ALL SELECT 'links', count(*) FROM l UNION ALL SELECT 'orphans', count(*) FROM orphans"""


@query(_DELETE.format(and_event="", and_doc="", sources="id <> (SELECT id FROM s)"))
def k6_delete_source(spark, d):
    t = _all(spark, d)
    own = t["documents"].filter("source_id is not null").agg(F.min("source_id")).first()[0]
    return _counts(store.delete_source(t, own))


@query(_DELETE.format(and_event="AND document_id = (SELECT id FROM dd)", and_doc="AND id = (SELECT id FROM dd)", sources="id <> (SELECT id FROM s) OR EXISTS (SELECT 1 FROM m_documents WHERE source_id = (SELECT id FROM s) AND id <> (SELECT id FROM dd))"))
def k7_delete_document(spark, d):
    t = _all(spark, d)
    own = t["documents"].filter("source_id is not null").agg(F.min(F.struct("source_id", "id"))).first()[0]
    return _counts(store.delete_source(t, own.source_id, own.id))


@query(with_sql("kb_sources") + " SELECT id, CASE WHEN id = " + _SRC.format(n=1) + " THEN 'renamed' ELSE name END AS name, CASE WHEN id = " + _SRC.format(n=1) + " THEN true ELSE vector_synced END AS vector_synced FROM m_sources")
def k8_k9_update_source(spark, d):
    own = _first_sources(spark, d, 1)[0]
    return store.mark_synced(store.update_source(model(spark, d, "kb_sources"), own, name="renamed", description=None), own).select("id", "name", "vector_synced")


@query("""WITH v AS (SELECT collection, id, min(coalesce(text, '')) AS text FROM vectors GROUP BY 1, 2)
SELECT * FROM v UNION ALL SELECT 'entities', 'new-' || id, 'again' FROM v WHERE collection = 'entities'""")
def k10_skip_vectors(spark, d):
    """Present ids are left as they are, new ones added."""
    v = table(spark, d, "vectors").select("collection", "id", F.coalesce("text", F.lit("")).alias("text"))
    once = v.groupBy("collection", "id").agg(F.min("text").alias("text"))
    own = once.filter("collection = 'entities'")
    batch = own.withColumn("text", F.lit("again")).unionByName(own.select("collection", F.concat(F.lit("new-"), "id").alias("id"), F.lit("again").alias("text"))).withColumn("pos", F.lit(0))
    return store.add_vectors(once, batch, "skip")


@query("""SELECT collection, id, arg_min(text, (coalesce(text, ''))) AS text FROM (SELECT collection, id, 'again' AS text FROM vectors WHERE collection = 'entities' UNION SELECT collection, id, coalesce(text, '') FROM vectors WHERE collection <> 'entities') GROUP BY 1, 2""")
def k10_add_vectors(spark, d):
    v = table(spark, d, "vectors").select("collection", "id", F.coalesce("text", F.lit("")).alias("text"))
    once = v.groupBy("collection", "id").agg(F.min("text").alias("text"))
    batch = v.filter("collection = 'entities'").select("collection", "id", F.lit("again").alias("text"), F.lit(0).alias("pos"))
    return store.add_vectors(once, batch)


@query(with_sql("kb_sources") + """
SELECT collection, count(*) AS n FROM vectors WHERE NOT coalesce(collection <> 'entities' AND source_id = """ + _SRC.format(n=1) + """, false)
AND NOT (collection = 'entities' AND id IN (SELECT id FROM kb_entities WHERE entity_type = 'work')) GROUP BY 1""")
def k11_k12_delete_vectors(spark, d):
    drop = table(spark, d, "kb_entities").filter("entity_type = 'work'").select("id").distinct()
    return store.delete_vectors(table(spark, d, "vectors"), _first_sources(spark, d, 1)[0], None, drop).groupBy("collection").agg(F.count("*").alias("n"))


@query("""WITH v AS (SELECT DISTINCT id FROM vectors WHERE collection = 'chunks'), c AS (SELECT DISTINCT id FROM kb_chunks)
SELECT (SELECT count(*) FROM v JOIN c USING (id)) AS matched, (SELECT count(*) FROM v WHERE id NOT IN (SELECT id FROM c)) AS orphans, (SELECT count(*) FROM c WHERE id NOT IN (SELECT id FROM v)) AS missing""")
def set_reconcile(spark, d):
    return store.reconcile(table(spark, d, "vectors").filter("collection = 'chunks'"), table(spark, d, "kb_chunks"))


@query("SELECT DISTINCT collection, id FROM vectors WHERE collection = 'event_titles' AND id NOT IN (SELECT id FROM kb_events WHERE deleted_at IS NULL)")
def set_orphans(spark, d):
    return store.repair_orphans(table(spark, d, "vectors"), table(spark, d, "kb_events").filter("deleted_at is null"), "event_titles")


@query("""WITH v AS (SELECT DISTINCT id FROM vectors WHERE collection = 'chunks'), c AS (SELECT DISTINCT id FROM kb_chunks WHERE id > 'c')
SELECT * FROM (SELECT 'orphan' AS kind, id FROM v WHERE id NOT IN (SELECT id FROM c) ORDER BY id LIMIT 10) UNION ALL SELECT * FROM (SELECT 'missing', id FROM c WHERE id NOT IN (SELECT id FROM v) ORDER BY id LIMIT 10)""")
def set_reconcile_samples(spark, d):
    return store.reconcile_samples(table(spark, d, "vectors").filter("collection = 'chunks'"), table(spark, d, "kb_chunks").filter("id > 'c'"))


@query(with_sql("kb_events") + " SELECT id, title FROM m_events WHERE deleted_at IS NULL AND id IN (SELECT id FROM vectors WHERE collection = 'event_titles')")
def j8_rows_of_hashes(spark, d):
    """Live events by the numeric ids of an index of their titles."""
    hashes = table(spark, d, "vectors").filter("collection = 'event_titles'").select(store.numeric_id(F.col("id")).alias("numeric_id"))
    return store.rows_of_hashes(hashes, model(spark, d, "kb_events"), live=True).select("id", "title")


_NAMES = {"sources": "kb_sources", "documents": "kb_documents", "chunks": "kb_chunks", "events": "kb_events", "entities": "kb_entities", "links": "kb_event_entities"}


@query(with_sql("kb_sources", "kb_documents", "kb_chunks", "kb_events") + """, s AS (SELECT min(source_id) AS id FROM m_documents)
SELECT 'sources' AS what, id, name AS text FROM m_sources WHERE id <> (SELECT id FROM s) UNION ALL SELECT 'documents', id, md5(content) FROM m_documents WHERE coalesce(source_id <> (SELECT id FROM s), true)
UNION ALL SELECT 'chunks', id, md5(content) FROM m_chunks WHERE coalesce(source_id <> (SELECT id FROM s), true) UNION ALL SELECT 'events', id, title FROM m_events WHERE coalesce(source_id <> (SELECT id FROM s), true)""")
def k1_persist(spark, d):
    """The tables as the catalog gives them back: published in two versions, documents in two parts, then a source deleted."""
    catalog = Catalog(spark, f"{shared_folder(spark)}/wovenkb/{uuid.uuid4().hex}")
    t = {k: _as_stored(model(spark, d, v), Catalog.TABLES[k]) for k, v in _NAMES.items()}
    halves = [t["documents"].filter(F.pmod(F.xxhash64("id"), F.lit(2)) == k) for k in (0, 1)]
    catalog.publish(t | {"documents": halves[0]})
    catalog.publish(added={"documents": halves[1]})
    plan.delete(catalog, t["documents"].agg(F.min("source_id")).first()[0])
    now = catalog.all()
    md5 = F.md5(F.encode("content", "UTF-8"))
    out = now["sources"].select(F.lit("sources").alias("what"), "id", F.col("name").alias("text"))
    for name, value in (("documents", md5), ("chunks", md5), ("events", F.col("title"))):
        out = out.unionByName(now[name].select(F.lit(name).alias("what"), "id", value.alias("text")))
    return out


def _as_stored(df: DataFrame, ddl: str) -> DataFrame:
    return df.select(*(F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(ddl).fields))


@query(with_sql("kb_sources", "kb_chunks", "kb_events") + """ SELECT s.id, name, (SELECT count(*) FROM m_chunks c WHERE c.source_id = s.id) AS n_chunks, (SELECT count(*) FROM m_events e WHERE e.source_id = s.id) AS n_events
FROM m_sources s WHERE archived_at IS NULL ORDER BY created_at DESC NULLS LAST, s.id LIMIT 20""")
def api_sources(spark, d):
    tables = {k: model(spark, d, v) for k, v in _NAMES.items()}
    return search.sources(tables, limit=20).select("id", "name", "n_chunks", "n_events")


@query(with_sql("kb_sources", "kb_documents", "kb_chunks", "kb_events", "kb_entities", "kb_event_entities") + "".join(f"{' UNION ALL' if i else ''} SELECT '{k}' AS what, count(*) AS n FROM m_{v[3:]}" for i, (k, v) in enumerate(_NAMES.items())) + " UNION ALL SELECT 'vectors', count(*) FROM vectors")
def api_stats(spark, d):
    return search.stats({k: model(spark, d, v) for k, v in _NAMES.items()} | {"vectors": table(spark, d, "vectors")})


@query()
def set_numeric_ids(spark, d):
    return model(spark, d, "kb_chunks").select("id", store.numeric_id(F.col("id")).alias("numeric_id"))
