"""Ingest and deletion: lazy frames from loaded documents to a new version of all tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import providers
from ..functions import text
from ..operators import chunking, store
from ..params import IngestParams
from ..session import checkpoint, temporary
from ..sources.readers import Catalog


def make_id(*parts: Column | str) -> Column:
    """Deterministic id over business keys, so that a retried task gives the same rows."""
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def prepare(loaded: DataFrame, catalog: Catalog) -> DataFrame:
    """Loaded documents with checksum and ids, without failures, repeats and what a live source already holds."""
    x = loaded.filter("error is null and content is not null").withColumn("md5", F.md5(F.encode("content", "UTF-8")))
    x = x.dropDuplicates(["title", "md5"]).withColumn("source_id", make_id("title", "md5"))
    live = catalog.read("sources").filter("archived_at is null and md5 != ''").select(F.col("name").alias("title"), "md5")
    return x.join(live, ["title", "md5"], "left_anti").withColumn("document_id", make_id(F.col("source_id"), F.lit("document")))


def ingest(catalog: Catalog, loaded: DataFrame, known: list[tuple[str, str]] = (), p: IngestParams = IngestParams(), extract: Callable[[str], dict] | None = None, embed: Callable | None = None, instead_of: str | None = None) -> int:
    """Clean, split, extract, link, embed and publish; gives the new version.

    Everything becomes visible at once or not at all. New rows stand beside those that are there, which aren't written
    again; entities, whose names may change, are. With ``instead_of`` a source goes in the same version.
    """
    with temporary():
        base = catalog.version()
        present = catalog.all(base)
        gone = _Gone(present, instead_of) if instead_of else None
        left = present if gone is None else present | {k: gone.left[k] for k in ("sources", "entities", "links")}
        now = F.current_timestamp().cast("timestamp_ntz")
        docs = prepare(loaded, catalog).withColumn("content", text.clean_text(F.col("content"), F.col("file_type"), p.strip_html, p.protect_lists, p.collapse_spaces, p.join_lines, p.limit_blank_lines))
        docs = checkpoint(providers.with_genre(docs, p))
        parts = chunking.split_documents(docs.select(F.col("document_id").alias("id"), "source_id", "title", "content", "file_type"), p, p.splitter, embed)
        chunks = checkpoint(parts.withColumn("id", make_id(F.col("document_id"), F.col("rank_index").cast("string"))))
        genres = docs.select("document_id", "genre")
        events = providers.extract_events(chunks.join(genres, "document_id"), list(known), extract, p)
        one = checkpoint(events.select(make_id(F.col("id"), F.lit("event")).alias("id"), "source_id", "document_id", F.col("id").alias("chunk_id"), "rank_index", "event.title", "event.summary", "event.content", "event.entities"))
        mentions = one.select(F.col("id").alias("event_id"), F.posexplode("entities").alias("ordinal", "e")).select("event_id", "ordinal", "e.*", F.xxhash64("event_id", "ordinal").alias("mention_id"))
        merged = checkpoint(store.upsert_entities(left["entities"], mentions))
        entities = merged.join(left["entities"].select("id", "created_at"), "id", "left").select("id", "entity_type", "name", "normalized_name", "description", F.coalesce("created_at", now).alias("created_at"), now.alias("updated_at"))
        links = store.new_links(mentions, merged, left["links"]).select(make_id("event_id", "entity_id").alias("id"), "event_id", "entity_id", F.coalesce("weight", F.lit(1.0)).alias("weight"), F.col("role").alias("description"), now.alias("created_at"))
        stored = docs.withColumn("content", F.when(F.lit(p.strip_roles) & F.lower("file_type").isin("xlsx", "xls"), text.strip_roles(F.col("content"))).otherwise(F.col("content")))
        texts = [("chunks", chunks.select("id", F.col("content").alias("text"), "source_id", "document_id"))]
        texts += [(c, one.select("id", F.col(k).alias("text"), "source_id", "document_id")) for c, k in (("event_titles", "title"), ("event_contents", "content"), *((("event_summaries", "summary"),) if p.embed_summary else ()))]
        none = F.lit(None).cast("string")
        named = (F.lower(F.trim("type")) == F.col("entity_type")) & (text.normalize_name(mentions["name"]) == F.col("normalized_name"))
        texts.append(("entities", mentions.join(merged.select("id", "entity_type", "normalized_name"), named).select("id", F.col("name").alias("text"), none.alias("source_id"), none.alias("document_id"))))
        rows = None
        for c, x in texts:
            y = x.withColumn("collection", F.lit(c)).withColumn("pos", F.lit(0))
            rows = y if rows is None else rows.unionByName(y)
        fresh = store.new_vectors(present["vectors"] if gone is None else gone.vectors(present["vectors"])[1], rows, "skip")
        vectors = providers.embed(fresh, "text", model=embed).select("collection", "id", "text", "embedding", "source_id", "document_id")
        sources = docs.select(F.col("source_id").alias("id"), F.col("title").alias("name"), none.alias("description"), "md5", F.lit(True).alias("vector_synced"), F.lit(None).cast("timestamp_ntz").alias("archived_at"), now.alias("created_at"), now.alias("updated_at"))
        new_docs = stored.select(F.col("document_id").alias("id"), "source_id", "title", "content", "source_path", "file_type", F.lit("COMPLETED").alias("status"), now.alias("created_at"))
        new_events = one.select("id", "source_id", "document_id", "chunk_id", "rank_index", "title", "summary", "content", F.lit(None).cast("timestamp_ntz").alias("deleted_at"), now.alias("created_at"))
        added = {"sources": sources, "documents": new_docs, "chunks": chunks.withColumn("created_at", now), "events": new_events, "links": links, "vectors": vectors}
        return catalog.publish({"entities": entities}, added, gone.rewritten() if gone else None, base)


class _Gone:
    """What goes with a source or one of its documents."""

    def __init__(self, present: dict[str, DataFrame], source_id: str, document_id: str | None = None) -> None:
        self.source_id, self.document_id = source_id, document_id
        self.left = store.delete_source(present, source_id, document_id)
        self.events, self.orphans = checkpoint(self.left["gone_events"]), checkpoint(self.left["orphans"])
        self.kept_sources = checkpoint(self.left["sources"].select("id"))

    def _own(self, part: DataFrame, document: str) -> tuple[DataFrame, DataFrame]:
        mine = (F.col("source_id") == self.source_id) & (F.lit(self.document_id is None) | (F.col(document) == (self.document_id or "")))
        return part.filter(mine), part.filter(F.coalesce(~mine, F.lit(True)))

    def _of(self, part: DataFrame, ids: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
        named = ids.toDF(column)
        return part.join(named, column, "left_semi"), part.join(named, column, "left_anti")

    def vectors(self, part: DataFrame) -> tuple[DataFrame, DataFrame]:
        kept = store.delete_vectors(part, self.source_id, self.document_id, self.orphans)
        mine, _ = self._own(part.filter("collection != 'entities'"), "document_id")
        return mine.unionByName(self._of(part.filter("collection = 'entities'"), self.orphans, "id")[0].select(part.columns)), kept

    def rewritten(self) -> dict[str, Callable[[DataFrame], tuple[DataFrame, DataFrame]]]:
        """For each table the rows of a part that go, and those that stay."""
        return {
            "sources": lambda x: (x.join(self.kept_sources, "id", "left_anti"), x.join(self.kept_sources, "id", "left_semi")),
            "documents": lambda x: self._own(x, "id"), "chunks": lambda x: self._own(x, "document_id"), "events": lambda x: self._own(x, "document_id"),
            "links": lambda x: self._of(x, self.events, "event_id"), "entities": lambda x: self._of(x, self.orphans, "id"), "vectors": self.vectors,
        }


def delete(catalog: Catalog, source_id: str, document_id: str | None = None) -> int:
    """A version without a source or document, its vectors and the entities that only it had. Only the parts of the
    tables that hold rows of it are written again."""
    with temporary():
        base = catalog.version()
        return catalog.publish(rewritten=_Gone(catalog.all(base), source_id, document_id).rewritten(), base=base)


def rebuild(catalog: Catalog, source_id: str, loaded: DataFrame, **options: object) -> int:
    """Replace a source by a new reading of it, under its own title and in one version; the same content changes nothing."""
    old = catalog.read("sources").filter(F.col("id") == source_id).select("name", "md5").first()
    if old is None:
        return ingest(catalog, loaded, **options)
    titled = loaded.withColumn("title", F.lit(old.name))
    if titled.filter(F.md5(F.encode("content", "UTF-8")) == F.lit(old.md5)).limit(1).count():
        return catalog.version()
    return ingest(catalog, titled, instead_of=source_id, **options)
