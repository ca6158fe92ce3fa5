"""The stored tables: lookups, joins, counts, and mutations as new versions of tables.

Parquet has no updates, so each mutation takes the present frames and gives new ones; ``plans.ingest.publish``
writes them as a version and moves the pointer last. Lists of ids that come from the caller are literals or
frames; frames are joined, with Catalyst choosing how.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import text


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first by ``order``; which of equal rows doesn't matter."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def unique_links(links: DataFrame) -> DataFrame:
    """One link per (event, entity): the first by time and id keeps its role and weight."""
    return latest(links, ["event_id", "entity_id"], [F.col("created_at").asc_nulls_last(), F.col("id").asc_nulls_last()])


# Lookups


def duplicates_of(sources: DataFrame, name: str, md5: str) -> DataFrame:
    """Live sources with the same name and checksum; an empty checksum is never a duplicate."""
    return sources.filter((F.col("name") == name) & (F.col("md5") == md5) & (F.col("md5") != "") & F.col("archived_at").isNull())


#: Least and greatest size of a page by what is listed.
PAGES = {"list": (1, 500), "search": (1, 100), "context": (10, 500)}


def checked_page(limit: int, offset: int = 0, kind: str = "list") -> tuple[int, int]:
    """Limit and offset, or an error where they are out of range."""
    least, most = PAGES[kind]
    if not least <= limit <= most or offset < 0:
        raise ValueError(f"a page of {kind} has {least} to {most} rows from a place of 0 on")
    return limit, offset


def list_sources(sources: DataFrame, keyword: str | None = None, archived: bool = False, limit: int = 50, offset: int = 0) -> DataFrame:
    """Newest first, by page; the keyword is taken literally."""
    limit, offset = checked_page(limit, offset)
    x = sources if archived else sources.filter("archived_at is null")
    if keyword:
        x = x.filter(F.contains("name", F.lit(keyword)))
    return x.orderBy(F.col("created_at").desc_nulls_last(), "id").offset(offset).limit(limit)


def full_text_search(documents: DataFrame, sources: DataFrame, keyword: str, source_ids: list[str] | None = None, limit: int = 20, around: int = 80) -> DataFrame:
    """Documents of live sources that contain the keyword, newest first, with a snippet."""
    checked_page(limit, 0, "search")
    checked_page(around, 0, "context")
    live = sources.filter("archived_at is null").select(F.col("id").alias("source_id"), F.col("name").alias("source_name"))
    x = documents.filter(F.contains("content", F.lit(keyword)))
    if source_ids is not None:
        x = x.filter(F.col("source_id").isin(source_ids))
    top = x.join(live, "source_id").orderBy(F.col("created_at").desc_nulls_last(), F.col("id")).limit(limit)
    return top.select(F.col("id").alias("document_id"), "source_id", "source_name", "title", "created_at", text.snippet(F.col("content"), keyword, around).alias("snippet"))


def in_sources(events: DataFrame, source_ids: list[str] | None) -> DataFrame:
    """Events of the sources; no list lets all pass."""
    return events if source_ids is None else events.filter(F.col("source_id").isin(source_ids))


def scope_entities(entity_ids: DataFrame, links: DataFrame, events: DataFrame, source_ids: list[str] | None) -> DataFrame:
    """Of (entity_id) those with an event in the sources."""
    if source_ids is None:
        return entity_ids
    inside = links.join(in_sources(events, source_ids).select(F.col("id").alias("event_id")), "event_id", "left_semi")
    return entity_ids.join(inside, "entity_id", "left_semi")


def latest_document(documents: DataFrame, source_id: str) -> DataFrame:
    return documents.filter(F.col("source_id") == source_id).orderBy(F.col("created_at").desc_nulls_last(), "id").limit(1)


# Joins


def events_of_entities(entity_ids: DataFrame, links: DataFrame, events: DataFrame | None = None, source_ids: list[str] | None = None, exclude: DataFrame | None = None) -> DataFrame:
    """Distinct (event_id) linked to (entity_id), in the sources if named, without the excluded ones."""
    x = links.join(entity_ids.select("entity_id").distinct(), "entity_id", "left_semi").select("event_id").distinct()
    if source_ids is not None and events is not None:
        x = x.join(in_sources(events, source_ids).select(F.col("id").alias("event_id")), "event_id", "left_semi")
    return x if exclude is None else x.join(exclude.select("event_id"), "event_id", "left_anti")


def exact_entities(entities: DataFrame, links: DataFrame, events: DataFrame, names: list[str], source_ids: list[str] | None = None) -> DataFrame:
    """Entities whose normalised name is one of the names' and that have a link (in the sources)."""
    wanted = entities.sparkSession.createDataFrame([(n,) for n in names], "_name string").select(text.normalize_name(F.col("_name")).alias("normalized_name")).distinct()
    linked = links if source_ids is None else links.join(in_sources(events, source_ids).select(F.col("id").alias("event_id")), "event_id", "left_semi")
    return entities.join(F.broadcast(wanted), "normalized_name", "left_semi").join(linked, entities["id"] == linked["entity_id"], "left_semi")


def events_with_roles(wanted: DataFrame, events: DataFrame, links: DataFrame) -> DataFrame:
    """Events of (event_id, pos) with their entities, roles and weights as maps."""
    few = links.join(wanted, "event_id", "left_semi")
    maps = few.groupBy("event_id").agg(
        F.sort_array(F.collect_set("entity_id")).alias("entity_ids"),
        F.map_from_entries(F.collect_set(F.struct("entity_id", F.coalesce("description", F.lit(""))))).alias("entity_roles"),
        F.map_from_entries(F.collect_set(F.struct("entity_id", F.coalesce("weight", F.lit(0.5))))).alias("entity_weights"),
    )
    return wanted.join(events, wanted["event_id"] == events["id"]).drop(events["id"]).join(maps, "event_id", "left")


def roles_of_events(event_ids: DataFrame, links: DataFrame) -> DataFrame:
    """(event_id, entity_id, role, weight) with 0.5 for a missing weight."""
    return links.join(event_ids, "event_id", "left_semi").select("event_id", "entity_id", F.col("description").alias("role"), F.coalesce("weight", F.lit(0.5)).alias("weight"))


def chunks_in_order(wanted: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks of (chunk_id, pos)."""
    return wanted.join(chunks, wanted["chunk_id"] == chunks["id"]).drop(chunks["id"])


def attach_source_names(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """With source_name, empty where the source is unknown."""
    names = sources.select(F.col("id").alias("source_id"), F.col("name").alias("_name"))
    return rows.join(names, "source_id", "left").withColumn("source_name", F.coalesce("_name", F.lit(""))).drop("_name")


# Counts


def entity_degrees(links: DataFrame, entity_ids: DataFrame | None = None) -> DataFrame:
    """(entity_id, degree), over all sources; entities that are asked for but have no link get 0."""
    x = links if entity_ids is None else links.join(entity_ids, "entity_id", "left_semi")
    d = x.groupBy("entity_id").agg(F.count("*").alias("degree"))
    return d if entity_ids is None else entity_ids.select("entity_id").distinct().join(d, "entity_id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def source_stats(sources: DataFrame) -> DataFrame:
    return sources.agg(F.count_if(F.col("archived_at").isNull()).alias("live"), F.count_if(F.col("archived_at").isNotNull()).alias("archived"))


# Mutations


def upsert(present: DataFrame, new: DataFrame, key: list[str], update: list[str]) -> DataFrame:
    """Rows with equal keys take the named columns of the new row, other new rows are added. One row per key on both sides."""
    fresh = new.select(*[F.col(k) for k in key], *[F.col(c).alias(f"_{c}") for c in new.columns if c not in key], F.lit(True).alias("_new"))
    old = present.withColumn("_old", F.lit(True))
    both = old.join(fresh, key, "full_outer")
    cols = [
        F.col(c) if c in key else F.when(F.col("_new") & (F.col("_old").isNull() | F.lit(c in update)), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if f"_{c}" in both.columns else F.col(c)
        for c in present.columns
    ]
    return both.select(*cols)


def upsert_entities(entities: DataFrame, mentions: DataFrame) -> DataFrame:
    """(entity_type, normalized_name, id, name, description): one entity per identity. A present one keeps its id and
    description and takes the last name; a new one gets an id from its identity."""
    identity = ["entity_type", "normalized_name"]
    seen = mentions.withColumn("entity_type", F.lower(F.trim("type"))).withColumn("normalized_name", text.normalize_name(F.col("name"))).filter("normalized_name != '' and entity_type != ''")
    new = seen.groupBy(*identity).agg(F.min_by("description", F.struct("mention_id", F.coalesce("description", F.lit("")))).alias("_description"), F.max_by("name", F.struct("mention_id", "name")).alias("_name"))
    old = latest(entities, identity, [F.col("created_at").asc_nulls_last(), F.col("id")]).select(*identity, "id", "name", "description")
    return old.join(new, identity, "full_outer").select(
        *identity,
        F.coalesce("id", F.sha2(F.concat_ws("\x1f", *identity), 256)).alias("id"),
        F.coalesce("_name", "name").alias("name"),
        F.when(F.col("id").isNotNull(), F.col("description")).otherwise(F.col("_description")).alias("description"),
    )


def new_links(mentions: DataFrame, entities: DataFrame, links: DataFrame) -> DataFrame:
    """(event_id, entity_id, weight, role) of mentions: the first of a pair by ordinal, without pairs that are linked already."""
    ids = entities.select("entity_type", "normalized_name", F.col("id").alias("entity_id"))
    x = mentions.withColumn("entity_type", F.lower(F.trim("type"))).withColumn("normalized_name", text.normalize_name(F.col("name"))).join(ids, ["entity_type", "normalized_name"])
    first = latest(x, ["event_id", "entity_id"], [F.col("ordinal").asc_nulls_last(), F.col("mention_id")])
    return first.join(links, ["event_id", "entity_id"], "left_anti").select("event_id", "entity_id", "weight", "role")


def delete_source(tables: dict[str, DataFrame], source_id: str, document_id: str | None = None) -> dict[str, DataFrame]:
    """The tables without a source (or one of its documents), its links, and the entities that only it had."""
    gone = tables["events"].filter((F.col("source_id") == source_id) & (F.lit(document_id is None) | (F.col("document_id") == document_id))).select(F.col("id").alias("event_id")).distinct()
    mine = lambda t: (F.col("source_id") == source_id) & (F.lit(document_id is None) | (F.col("id" if t == "documents" else "document_id") == document_id))
    links = tables["links"].join(gone, "event_id", "left_anti")
    affected = tables["links"].join(gone, "event_id", "left_semi").select("entity_id").distinct()
    orphans = affected.join(links, "entity_id", "left_anti").select(F.col("entity_id").alias("id"))
    kept = lambda t: tables[t].filter(F.coalesce(~mine(t), F.lit(True)))
    out = {"events": kept("events"), "chunks": kept("chunks"), "documents": kept("documents"), "links": links, "entities": tables["entities"].join(orphans, "id", "left_anti"), "orphans": orphans, "gone_events": gone}
    out["sources"] = tables["sources"].filter(F.coalesce(F.col("id") != source_id, F.lit(True))) if document_id is None else tables["sources"].join(
        out["documents"].filter(F.col("source_id") == source_id).select(F.col("source_id").alias("id")).unionByName(tables["sources"].filter(F.col("id") != source_id).select("id")).distinct(), "id", "left_semi"
    )
    return out


def changes(**fields: object) -> dict[str, object]:
    """The fields that are to be set; empty, hence false, where nothing is."""
    return {k: v for k, v in fields.items() if v is not None}


def update_source(sources: DataFrame, source_id: str, **fields: object) -> DataFrame:
    """Set the fields that aren't None; with none of them the frame stays as it is (``changes`` tells beforehand)."""
    given = changes(**fields)
    return sources.withColumns({k: F.when(F.col("id") == source_id, F.lit(v)).otherwise(F.col(k)) for k, v in given.items()}) if given else sources


def mark_synced(sources: DataFrame, source_id: str, synced: bool = True) -> DataFrame:
    return update_source(sources, source_id, vector_synced=synced)


def new_vectors(present: DataFrame, batch: DataFrame, present_ids: str = "replace") -> DataFrame:
    """The first of a batch per (collection, id); with "skip" only those that aren't present. ``batch`` has a column pos for its order."""
    if present_ids not in ("replace", "skip"):
        raise ValueError(f"unknown way {present_ids}")
    first = latest(batch, ["collection", "id"], [F.col("pos")]).drop("pos")
    return first.join(present, ["collection", "id"], "left_anti") if present_ids == "skip" else first


def add_vectors(present: DataFrame, batch: DataFrame, present_ids: str = "replace") -> DataFrame:
    """What is present with a batch: rows of the batch replace those with their ids, or ("skip") leave them as they are."""
    first = new_vectors(present, batch, present_ids)
    kept = present if present_ids == "skip" else present.join(first, ["collection", "id"], "left_anti")
    return kept.unionByName(first)


def delete_vectors(vectors: DataFrame, source_id: str, document_id: str | None = None, entity_ids: DataFrame | None = None) -> DataFrame:
    """Without the vectors of a source or document, in all collections but entities; and without those entities."""
    mine = (F.col("collection") != "entities") & (F.col("source_id") == source_id) & (F.lit(document_id is None) | (F.col("document_id") == document_id))
    x = vectors.filter(F.coalesce(~mine, F.lit(True)))
    if entity_ids is None:
        return x
    drop = entity_ids.select("id", F.lit("entities").alias("collection"))
    return x.join(drop, ["collection", "id"], "left_anti")


# Reconciliation


def reconcile(index_ids: DataFrame, table_ids: DataFrame) -> DataFrame:
    """(matched, orphans, missing): counts of ids in both, in the index only, and in the table only."""
    a, b = index_ids.select("id").distinct().withColumn("_i", F.lit(1)), table_ids.select("id").distinct().withColumn("_t", F.lit(1))
    both = a.join(b, "id", "full_outer")
    return both.agg(F.count_if(F.col("_i").isNotNull() & F.col("_t").isNotNull()).alias("matched"), F.count_if(F.col("_t").isNull()).alias("orphans"), F.count_if(F.col("_i").isNull()).alias("missing"))


def repair_orphans(vectors: DataFrame, table_ids: DataFrame, collection: str, dry_run: bool = True) -> DataFrame:
    """The orphans of a collection, or (not dry) the vectors without them."""
    ids = table_ids.select("id").distinct()
    if dry_run:
        return vectors.filter(F.col("collection") == collection).join(ids, "id", "left_anti").select("collection", "id").distinct()
    own = vectors.filter(F.col("collection") == collection).join(ids, "id", "left_semi")
    return vectors.filter(F.col("collection") != collection).unionByName(own)


def reconcile_samples(index_ids: DataFrame, table_ids: DataFrame, limit: int = 10) -> DataFrame:
    """(kind, id): the first ids by name of those in the index only ("orphan") and in the table only ("missing")."""
    a, b = index_ids.select("id").distinct(), table_ids.select("id").distinct()
    first = lambda x, kind: x.orderBy("id").limit(limit).select(F.lit(kind).alias("kind"), "id")
    return first(a.join(b, "id", "left_anti"), "orphan").unionByName(first(b.join(a, "id", "left_anti"), "missing"))


def rows_of_hashes(hashes: DataFrame, rows: DataFrame, live: bool = False) -> DataFrame:
    """Rows by the numeric ids (numeric_id) of an index; with ``live`` those that aren't deleted."""
    x = rows.withColumn("numeric_id", numeric_id(F.col("id")))
    return (x.filter("deleted_at is null") if live else x).join(hashes.select("numeric_id").distinct(), "numeric_id", "left_semi")


def numeric_id(column: Column) -> Column:
    """Signed 64-bit id of a string id."""
    return F.xxhash64(column)
