"""Models behind one interface, with deterministic offline defaults: embedding, extraction, rewriting and answers."""

from __future__ import annotations

import hashlib
import re
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from . import prompts
from .functions import text
from .params import IngestParams
from .schemas import EXTRACTED_EVENT

GENRES = ("generic", "tabular", "news", "report", "contract", "manual", "meeting", "academic", "legal", "finance", "narrative", "dialogue")
SCENES = ("genre", "extract", "rewrite", "entities", "rerank", "answer")

#: Model call of each scene: (prompt) -> text. Without an entry the offline default works.
REGISTRY: dict[str, Callable[[str], str]] = {}


def register(scene: str, call: Callable[[str], str]) -> None:
    """Use a model for a scene."""
    if scene not in SCENES:
        raise ValueError(f"unknown scene {scene}")
    REGISTRY[scene] = call


def retried(call: Callable[[], object], retries: int = 2, pause: float = 1.0) -> object:
    """A call with retries after 1, 2, ... pauses; the last failure is raised."""
    for k in range(retries + 1):
        try:
            return call()
        except Exception:
            if k == retries:
                raise
            time.sleep(pause * 2**k)
    return None


def hash_embedding(text: str | None, dim: int = 64) -> list[float]:
    """Unit vector of hashed words and character trigrams."""
    x = np.zeros(dim)
    t = (text or "").lower().strip() or "empty"
    for g in re.findall(r"\w+", t) + [t[i : i + 3] for i in range(max(1, len(t) - 2))]:
        h = int.from_bytes(hashlib.blake2b(g.encode(), digest_size=8).digest(), "little")
        x[h % dim] += 1.0 if h >> 63 else -1.0
    n = np.linalg.norm(x)
    return (x / n if n else x).astype(np.float32).tolist()


def embed(rows: DataFrame, text_col: str, out_col: str = "embedding", model: Callable[[list[str]], list[list[float]]] | None = None, dim: int = 64) -> DataFrame:
    """With embeddings, batch by batch; blank texts are embedded as a word."""
    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        safe = [(t or "").strip() or "empty" for t in texts]
        return pd.Series(model(safe) if model else [hash_embedding(t, dim) for t in safe])

    return rows.withColumn(out_col, run(F.col(text_col)))


def detect_genre(title: str | None, content: str | None, file_type: str | None, call: Callable[[str], str] | None = None) -> str:
    """Genre of a document; tables need no call, failures and unknown labels give generic."""
    if (file_type or "").lower() in ("xlsx", "xls", "csv"):
        return "tabular"
    call = call or REGISTRY.get("genre")
    if call is None:
        return "generic"
    body = content or ""
    sample = f"{title or ''}\n{body[:800]}" + (f"\n{body[-500:]}" if len(body) > 800 else "")
    try:
        reply = call(sample).lower()
    except Exception:
        return "generic"
    return next((g for g in GENRES if g in reply), "generic")


def with_genre(docs: DataFrame, p: IngestParams = IngestParams()) -> DataFrame:
    """Documents with their genre. Without a model (or switched off) that is a column expression; a model is asked batch by batch."""
    call = REGISTRY.get("genre")
    if not p.genre_detect:
        return docs.withColumn("genre", F.lit("generic"))
    if call is None:
        return docs.withColumn("genre", F.when(F.lower("file_type").isin("xlsx", "xls", "csv"), "tabular").otherwise("generic"))

    @F.pandas_udf("string")
    def run(titles: pd.Series, contents: pd.Series, types: pd.Series) -> pd.Series:
        return pd.Series([detect_genre(t, c, k, call) for t, c, k in zip(titles, contents, types)])

    return docs.withColumn("genre", run("title", "content", "file_type"))


def extract_offline(content: str, known: list[tuple[str, str]], title_chars: int = 100, summary_chars: int = 500) -> dict:
    """One event of a chunk: its first sentence as title, its beginning as summary, and the known (type, name) that it names."""
    first = re.split(r"(?<=[。！？.!?])\s*|\n", content.strip(), maxsplit=1)[0]
    found = [{"type": t, "name": n, "description": None, "role": "mentioned", "weight": 1.0} for t, n in known if n and n in content]
    return {"title": first[:title_chars], "summary": content.strip()[:summary_chars], "content": content, "entities": found}


def _model_extract(call: Callable[[str], str], p: IngestParams) -> Callable[..., dict]:
    """Extraction by a model that answers with JSON."""

    def run(content: str, genre: str, heading: str, previous: str | None) -> dict:
        told = prompts.json_in(call(prompts.extraction(content, genre, heading, previous, p.title_chars, p.summary_chars)))
        entities = [{k: e.get(k) for k in ("type", "name", "description", "role", "weight")} for e in told.get("entities") or [] if e.get("name")]
        return {"title": (told.get("title") or "")[: p.title_chars], "summary": (told.get("summary") or "")[: p.summary_chars], "content": content, "entities": entities}

    return run


def extract_events(chunks: DataFrame, known: list[tuple[str, str]], call: Callable[[str], dict] | None = None, p: IngestParams = IngestParams()) -> DataFrame:
    """Chunks (with a column genre or without) with one event each.

    ``known`` is a bounded vocabulary of the caller for the offline default; ``call`` or the model of the scene extract
    replace it. With a model and not ``parallel`` the chunks of a document are read in their order and each call gets the
    summary before it; chunks of tables are always read in parallel. Failures are retried, then raised.
    """
    names = chunks.sparkSession.sparkContext.broadcast(known)
    model = REGISTRY.get("extract")
    if call is not None:
        each = lambda content, genre, heading, previous: call(content)
    elif model is not None:
        each = _model_extract(model, p)
    else:
        each = lambda content, genre, heading, previous: extract_offline(content, names.value, p.title_chars, p.summary_chars)
    rows = chunks if "genre" in chunks.columns else chunks.withColumn("genre", F.lit("generic"))
    out = f"{_ddl(chunks.drop('genre'))}, event {EXTRACTED_EVENT}"
    kept = [c for c in chunks.columns if c != "genre"]
    retries = p.retries

    def event(row: tuple, previous: str | None = None) -> dict:
        content, genre, heading = row
        return retried(lambda: each(content or "", genre, heading or "", previous), retries)

    def parallel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            yield df[kept].assign(event=[event(r) for r in df[["content", "genre", "heading"]].itertuples(index=False, name=None)])

    def in_order(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("rank_index", ignore_index=True)
        events, previous = [], None
        for r in df[["content", "genre", "heading"]].itertuples(index=False, name=None):
            events.append(event(r, previous))
            previous = events[-1]["summary"]
        return df[kept].assign(event=events)

    if p.parallel or call is not None or model is None:
        return rows.mapInPandas(parallel, out)
    tables = rows.filter("genre = 'tabular'").mapInPandas(parallel, out)
    return tables.unionByName(rows.filter("genre != 'tabular'").groupBy("document_id").applyInPandas(in_order, out))


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def with_previous_summary(events: DataFrame) -> DataFrame:
    """Events with the summary of the event before in their document, the context of sequential extraction."""
    return events.withColumn("previous_summary", F.lag("summary").over(Window.partitionBy("document_id").orderBy("rank_index", "id")))


def query_entities(query: str, entities: DataFrame) -> DataFrame:
    """(entity_id, name, pos) of the entities that a question names, the longest names first.

    The model of the scene entities gives the names; if it fails there are none. Without a model the known names that
    the question contains are taken.
    """
    if "entities" in REGISTRY:
        try:
            told = prompts.json_in(REGISTRY["entities"](prompts.question_entities(query)))
            names = [str(x).strip() for x in (told.get("entities", []) if isinstance(told, dict) else told) if str(x).strip()]
        except Exception:  # a question without entities is still searched by its vector
            names = []
        wanted = entities.sparkSession.createDataFrame([(n,) for n in names], "_name string").select(text.normalize_name(F.col("_name")).alias("normalized_name")).distinct()
        hit = entities.join(F.broadcast(wanted), "normalized_name", "left_semi")
    else:
        q = F.lit(re.sub(r"\s+", "", query).lower())
        hit = entities.filter((F.length("normalized_name") > 1) & F.contains(q, F.col("normalized_name")))
    w = Window.orderBy(F.length("normalized_name").desc(), "id")
    return hit.select(F.col("id").alias("entity_id"), "name", (F.row_number().over(w) - 1).alias("pos"))


def model_order(query: str) -> Callable[[list[dict]], list[int]] | None:
    """The order of candidates by the model of the scene rerank, if there is one."""
    call = REGISTRY.get("rerank")
    return None if call is None else lambda candidates: prompts.numbers_in(call(prompts.order_of_candidates(query, candidates)))


def rewrite(query: str, history: list[dict]) -> str:
    """The question with what the history tells; without history, without a model or on failure as it is."""
    if not history or "rewrite" not in REGISTRY:
        return query
    try:
        told = "\n".join(f"{h['role']}: {h['content']}" for h in history if h.get("role") in ("user", "assistant") and (h.get("content") or "").strip())
        out = REGISTRY["rewrite"](f"{told}\n\n{query}").strip().strip("\"'“”‘’")
        return re.sub(r"^(?:user|assistant|query|question)\s*[:：]\s*", "", out, flags=re.I) or query
    except Exception:
        return query


NO_ANSWER = "Nothing relevant was found in the knowledge base."


def answer(query: str, context: str, history: list[dict] | None = None) -> str:
    """The answer of a model from the context; offline the beginning of the context; no context, no call."""
    if not context.strip():
        return NO_ANSWER
    if "answer" in REGISTRY:
        return REGISTRY["answer"](prompts.reply(query, context, history))
    return context[:500]


def answer_stream(query: str, context: str, step: int = 64) -> Iterator[tuple[str, str]]:
    """The answer as (event, data): meta, deltas, done; a failure as error."""
    yield "meta", query
    try:
        whole = answer(query, context)
        for i in range(0, len(whole), step):
            yield "delta", whole[i : i + step]
        yield "done", ""
    except Exception as e:  # the stream ends with what went wrong
        yield "error", str(e)
