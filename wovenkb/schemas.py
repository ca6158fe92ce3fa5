"""Schemas of the stored tables."""

from __future__ import annotations

SOURCES = "id string, name string, description string, md5 string, vector_synced boolean, archived_at timestamp_ntz, created_at timestamp_ntz, updated_at timestamp_ntz"
DOCUMENTS = "id string, source_id string, title string, content string, source_path string, file_type string, status string, created_at timestamp_ntz"
CHUNKS = "id string, source_id string, document_id string, rank_index int, heading string, content string, created_at timestamp_ntz"
EVENTS = "id string, source_id string, document_id string, chunk_id string, rank_index int, title string, summary string, content string, deleted_at timestamp_ntz, created_at timestamp_ntz"
ENTITIES = "id string, entity_type string, name string, normalized_name string, description string, created_at timestamp_ntz, updated_at timestamp_ntz"
LINKS = "id string, event_id string, entity_id string, weight double, description string, created_at timestamp_ntz"
VECTORS = "collection string, id string, text string, embedding array<float>, source_id string, document_id string"
EXTRACTED_ENTITY = "struct<type:string,name:string,description:string,role:string,weight:double>"
EXTRACTED_EVENT = f"struct<title:string,summary:string,content:string,entities:array<{EXTRACTED_ENTITY}>>"
