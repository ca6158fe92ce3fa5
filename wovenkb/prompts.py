"""Texts for models, put together from parts: the types of entities are the same for all genres, roles and rules are not."""

from __future__ import annotations

import json
import re

from .params import ENTITY_TYPES, QUERY_ENTITY_TYPES

#: Of each genre the roles that an entity can play in an event, and what to mind in its texts.
GENRE_RULES: dict[str, tuple[tuple[str, ...], str]] = {
    "generic": (("subject", "object", "place", "date", "topic"), "Take what the text states, nothing that it only suggests."),
    "tabular": (("key", "measure", "category", "period"), "Each row is a record: keep its values with the names of their columns; rows marked as totals give no entities of their own."),
    "news": (("actor", "affected", "source", "place", "date"), "Keep who reports apart from who acts."),
    "report": (("author", "subject", "measure", "period", "finding"), "Keep each figure with its unit and its period."),
    "contract": (("party", "counterparty", "obligation", "amount", "deadline"), "Name the party that each obligation binds."),
    "manual": (("component", "step", "tool", "warning"), "Keep the order of the steps."),
    "meeting": (("speaker", "decision", "task", "owner", "due date"), "Tell decisions from opinions."),
    "academic": (("author", "method", "data", "result", "cited work"), "Keep results with the data that they rest on."),
    "legal": (("authority", "provision", "addressee", "sanction", "effective date"), "Quote the numbers of articles as they stand."),
    "finance": (("issuer", "instrument", "amount", "rate", "period"), "Keep amounts with currency and date."),
    "narrative": (("character", "place", "object", "time"), "Follow one name for each character."),
    "dialogue": (("speaker", "addressee", "subject"), "Tell who says what."),
}


def extraction(content: str, genre: str = "generic", heading: str = "", previous: str | None = None, title_chars: int = 100, summary_chars: int = 500) -> str:
    """The request for one event of a chunk, with the summary before it where chunks are read in order."""
    roles, rule = GENRE_RULES.get(genre, GENRE_RULES["generic"])
    parts = [
        f"Describe the text below as one event: a title of at most {title_chars} characters, a summary of at most {summary_chars} characters, and its entities.",
        f"Types of entities: {', '.join(ENTITY_TYPES)}. Roles: {', '.join(roles)}. A weight from 0.1 to 1.0 tells how central an entity is.",
        rule,
        'Answer with JSON: {"title": ..., "summary": ..., "entities": [{"type": ..., "name": ..., "description": ..., "role": ..., "weight": ...}]}',
    ]
    if previous:
        parts.append(f"What came before: {previous}")
    if heading:
        parts.append(f"Heading: {heading}")
    return "\n".join([*parts, "Text:", content])


def question_entities(query: str) -> str:
    """The request for the entities that a question names."""
    return f"Name the entities in the question. Types: {', '.join(QUERY_ENTITY_TYPES)}. Answer with a JSON list of names.\nQuestion: {query}"


def order_of_candidates(query: str, candidates: list[dict]) -> str:
    """The request for an order of events."""
    lines = [f"[{i}] {c['title']} (relevance {c['score']:.3f}, after {c['depth']} hops {c['adjusted']:.3f}; strong {c['strong']}, medium {c['medium']}, weak {c['weak']})\n{c['summary'] or ''}" for i, c in enumerate(candidates)]
    return f"Put the events in the order in which they help to answer the question. Answer with a JSON list of their numbers.\nQuestion: {query}\n\n" + "\n\n".join(lines)


def reply(query: str, context: str, history: list[dict] | None = None) -> str:
    """The request for an answer from numbered sections."""
    said = "\n".join(f"{h['role']}: {h['content']}" for h in history or [])
    return "Answer from the sections alone and cite their numbers; say so if they don't hold the answer.\n\n" + "\n\n".join(x for x in (context, said, f"Question: {query}") if x)


def json_in(text: str) -> object:
    """The first JSON object or list in a model's answer."""
    for m in re.finditer(r"[\[{]", text):
        try:
            return json.JSONDecoder().raw_decode(text[m.start() :])[0]
        except ValueError:
            continue
    raise ValueError("the answer holds no JSON")


def numbers_in(text: str) -> list[int]:
    """The order in a model's answer: a JSON list (or its field order), else the numbers of the first line."""
    try:
        found = json_in(text)
        found = found.get("order", []) if isinstance(found, dict) else found
        return [int(x) for x in found]
    except (ValueError, TypeError):
        return [int(x) for x in re.findall(r"\d+", text.strip().split("\n")[0])]
