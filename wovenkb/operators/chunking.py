"""Splitting documents into chunks, headings of chunks, and tables of sheet rows."""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import text
from ..params import IngestParams

CHUNK = "document_id string, source_id string, rank_index int, heading string, content string"
_SHEET = re.compile(r"(?m)^#{2,3}\s*(?:Sheet|工作表)\s*[:：]\s*(.+?)\s*$|^={3,}\s*(.+?)\s*={3,}\s*$")
_ROLE = re.compile(rf"^#({'|'.join(text.ROLES)})#")

# The words of the table form.
TITLE, FORM, SIGNING, HEADER, TOTAL, COLUMN = "标题: ", "表单: ", "签章: ", "表头: ", "[汇总] ", "列"


# Plain text


def sentences(content: str) -> list[str]:
    """Sentences with their ends; blank lines end one too."""
    return [x for x in re.split(r"(?<=[。！？!?])|(?<=[.!?])\s+|\n{2,}", content) if x and x.strip()]


def pack(parts: list[str], size: int, overlap: int, joiner: str = "") -> list[str]:
    """Greedy packing of parts up to the size; the tail of a chunk that fits into the overlap begins the next one; a longer part is cut."""
    out: list[str] = []
    now: list[str] = []
    length = 0
    for p in parts:
        while len(p) > size:
            if now:
                out.append(joiner.join(now))
                now, length = [], 0
            out.append(p[:size])
            p = p[max(1, size - overlap) :]
        if now and length + len(p) > size:
            out.append(joiner.join(now))
            keep: list[str] = []
            kept = 0
            for x in reversed(now):
                if kept + len(x) > overlap or kept + len(x) + len(p) > size:
                    break
                keep.insert(0, x)
                kept += len(x)
            now, length = keep, kept
        now.append(p)
        length += len(p)
    if now:
        out.append(joiner.join(now))
    return out


def markdown_parts(content: str) -> list[tuple[str, str]]:
    """(heading path, section) of a Markdown text; headings inside fences don't count."""
    out: list[tuple[str, str]] = []
    path: list[str] = []
    now: list[str] = []
    fenced = False
    for line in content.split("\n"):
        if re.match(r"^(```|~~~)", line):
            fenced = not fenced
        m = None if fenced else re.match(r"^(#{1,6})\s+(.*\S)", line)
        if m:
            if "".join(now).strip():
                out.append((path[-1] if path else "", "\n".join(now)))
            path = [*path[: len(m[1]) - 1], m[2]]
            now = [line]
        else:
            now.append(line)
    if "".join(now).strip():
        out.append((path[-1] if path else "", "\n".join(now)))
    return out


def semantic_parts(content: str, percentile: float, embed: Callable[[list[str]], list[list[float]]]) -> list[str]:
    """Sentences in parts: a new one begins where the cosine distance to the sentence before is over the document's
    percentile of these distances. The size of a part has no limit."""
    own = sentences(content)
    if len(own) < 3:
        return [content]
    x = np.asarray(embed([s.strip() for s in own]), dtype=np.float64)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    gaps = 1 - (x[1:] * x[:-1]).sum(axis=1)
    edges = [0, *(np.flatnonzero(gaps > np.percentile(gaps, percentile)) + 1).tolist(), len(own)]
    return ["".join(own[a:b]) if any(s[-1:].isspace() for s in own[a:b]) else _joined(own[a:b]) for a, b in zip(edges, edges[1:])]


def _joined(parts: list[str]) -> str:
    """Sentences put together, with a blank where both ends are Latin."""
    out = parts[0]
    for p in parts[1:]:
        out += (" " if out[-1:].isascii() and p[:1].isascii() else "") + p
    return out


def split_documents(documents: DataFrame, p: IngestParams = IngestParams(), mode: str = "auto", embed: Callable[[list[str]], list[list[float]]] | None = None) -> DataFrame:
    """Chunks of (id, source_id, title, content, file_type): tables by rows, Markdown by sections, else by sentences.

    With mode "semantic" texts and Markdown are cut where neighbouring sentences are least alike (``embed`` gives their
    vectors, else hashed words), whatever the chunk size. Blank chunks are left out but keep their number, so rank_index may
    have gaps. The heading of a chunk is its own, else the last one in the document, else the title. One pass, document by document.
    """
    routed = documents.withColumn("_route", text.route_splitter(F.col("file_type"), mode)).select("id", "source_id", "title", "content", "_route")

    from ..providers import hash_embedding

    model = embed or (lambda texts: [hash_embedding(t) for t in texts])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            out = []
            for d in df.itertuples(index=False):
                content = d.content or ""
                if not content.strip():
                    continue
                route = d[4]
                if route == "table":
                    parts = [(h or d.title or "Table", c) for h, c in table_chunks(content, max(512, p.table_chunk_size or p.chunk_size))]
                elif route == "markdown":
                    parts = [(h, c) for h, s in markdown_parts(content) for c in pack(s.splitlines(keepends=True), p.chunk_size, p.overlap)]
                elif route == "semantic":
                    parts = [("", c) for c in semantic_parts(content, p.semantic_percentile, model)]
                elif route == "token":
                    parts = [("", c) for c in pack(re.findall(r"\S+\s*", content), p.chunk_size, p.overlap)]
                else:
                    parts = [("", c) for c in pack(sentences(content), p.chunk_size, p.overlap)]
                out += [(d.id, d.source_id, i, h, c.strip()) for i, (h, c) in enumerate(parts) if c.strip()]
            yield pd.DataFrame(out, columns=["document_id", "source_id", "rank_index", "heading", "content"])

    chunks = routed.mapInPandas(run, CHUNK)
    titles = documents.select(F.col("id").alias("document_id"), F.regexp_replace("title", r"\.[^.]*$", "").alias("_title")).dropDuplicates(["document_id"])
    return carry_headings(chunks, titles)


def carry_headings(chunks: DataFrame, titles: DataFrame) -> DataFrame:
    """Each chunk's heading: its own, one found in its text, the last before it in the document, the title, "Introduction"."""
    own = F.coalesce(F.nullif(F.trim("heading"), F.lit("")), F.nullif(text.heading_from_text(F.col("content")), F.lit("")))
    w = Window.partitionBy("document_id").orderBy("rank_index").rowsBetween(Window.unboundedPreceding, 0)
    x = chunks.withColumn("_own", own).withColumn("_last", F.last("_own", ignorenulls=True).over(w))
    return x.join(titles, "document_id", "left").withColumn("heading", F.substring(F.coalesce("_last", F.nullif(F.trim("_title"), F.lit("")), F.lit("Introduction")), 1, 512)).drop("_own", "_last", "_title")


# Tables


def sheets(content: str) -> list[tuple[str, str]]:
    """(name, rows) between the separator lines of sheets."""
    marks = list(_SHEET.finditer(content))
    if not marks:
        return [("", content)]
    ends = [m.start() for m in marks[1:]] + [len(content)]
    return [((m[1] or m[2]).strip(), content[m.end() : e].strip()) for m, e in zip(marks, ends) if content[m.end() : e].strip()]


def role_rows(rows: str) -> list[tuple[str, list[str]]]:
    """(role, cells) of each row. The mark is taken off before the row is read as CSV, so quoted first cells stay whole; blank rows are skipped."""
    out = []
    roles: list[str] = []
    plain: list[str] = []
    quoted = False
    for line in rows.split("\n"):
        m = None if quoted else _ROLE.match(line)
        if not quoted:
            roles.append(m[1].lower() if m else "data")
            plain.append(line[m.end() :] if m else line)
        else:
            plain[-1] += "\n" + line
        quoted = plain[-1].count('"') % 2 == 1
    for role, line in zip(roles, plain):
        cells = next(csv.reader(io.StringIO(line)), [])
        if any(c.strip() for c in cells):
            out.append((role, [c.strip() for c in cells]))
    return out


def format_row(header: list[str], row: list[str]) -> str:
    """name: value lines; empty values and values equal to their name are left out, unnamed columns get their place as name."""
    named = [(header[i] if i < len(header) and header[i] else f"{COLUMN}{i + 1}", v) for i, v in enumerate(row) if v]
    return "\n".join(f"{n}: {v}" for n, v in named if n != v)


def table_chunks(content: str, size: int) -> list[tuple[str, str]]:
    """(sheet, chunk): rows packed up to the size, never cut, each chunk with title, form, signing and header before it."""
    out = []
    for sheet, rows in sheets(content):
        parsed = role_rows(rows)
        first = next((i for i, (role, _) in enumerate(parsed) if role == "data"), None)
        if first is None:
            continue
        header = parsed[first][1]
        title = next((c for role, cells in parsed if role == "title" for c in cells if c), "")
        join = lambda kind: " | ".join(c for role, cells in parsed if role == kind for c in cells if c)  # noqa: B023, E731
        before = [f"## {sheet}" if sheet else "", TITLE + title if title else "", FORM + join("form") if join("form") else "", SIGNING + join("signing") if join("signing") else "", HEADER + " | ".join(h for h in header if h)]
        prefix = "\n".join(x for x in before if x) + "\n\n"
        bodies = []
        for role, cells in parsed[first + 1 :]:
            body = format_row(header, cells) if role == "data" else ""
            if body:
                total = next((c for c in cells if c), "")
                bodies.append((TOTAL if any(w in total for w in text.SUMMARY_WORDS) else "") + body + "\n\n")
        now, length = [], len(prefix)
        for b in bodies:
            if now and length + len(b) + 1 > size:
                out.append((sheet, prefix + "".join(now)))
                now, length = [], len(prefix)
            now.append(b)
            length += len(b) + 1
        if now:
            out.append((sheet, prefix + "".join(now)))
    return out


def classify_rows(cells: DataFrame) -> DataFrame:
    """(sheet, row, role) of (sheet, row, cells array<string>): title, signing, form, group header, data, in this order.

    A title is one filled cell among the first rows, a signing row names a signature, a form row has label: value
    pairs, a group header has gaps and is followed within four rows by a fuller row.
    """
    filled = F.filter("cells", lambda c: c.isNotNull() & (F.trim(c) != ""))
    w = Window.partitionBy("sheet").orderBy("row")
    n = F.size(filled)
    x = cells.withColumn("_n", n).withColumn("_first", F.row_number().over(w))
    after = F.greatest(*(F.coalesce(F.lead("_n", k).over(w), F.lit(0)) for k in range(1, 5)))
    signing = F.exists(filled, lambda c: c.rlike("签字|签章|盖章|签名|审批人|制表人|Signature|Signed by|Approved by"))
    form = F.exists(filled, lambda c: c.rlike(r"^[^:：]{1,30}[:：]\s*\S*$")) & (n <= 6)
    gaps = (n < F.size("cells")) & (n > 1) & (after > n)
    role = F.when((n == 1) & (F.col("_first") <= 3) & (after > 1), "title").when(signing, "signing").when(form, "form").when(gaps & (F.col("_first") <= 6), "group_header").otherwise("data")
    return x.filter("_n > 0").select("sheet", "row", role.alias("role"))


def fill_merges(cells: DataFrame, merges: DataFrame) -> DataFrame:
    """Cells (sheet, row, col, text) with pure vertical merges (sheet, col, first_row, last_row) filled down from their first cell."""
    origin = cells.select("sheet", F.col("row").alias("first_row"), "col", F.col("text").alias("_text"))
    m = merges.join(origin, ["sheet", "col", "first_row"])
    x = cells.join(m.withColumnRenamed("sheet", "_s").withColumnRenamed("col", "_c"), (F.col("sheet") == F.col("_s")) & (F.col("col") == F.col("_c")) & F.col("row").between(F.col("first_row"), F.col("last_row")), "left")
    return x.select("sheet", "row", "col", F.coalesce(F.nullif("text", F.lit("")), "_text").alias("text"))
