"""Splitting oversized items at natural boundaries.

Method: prefix sums of lengths with a sorted array of boundaries. The last boundary under the limit is found
by binary search, the next piece begins by stepping back by the overlap, again to a boundary, and where there
is no boundary the text is cut hard.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from . import common

#: Characters (code points) of a piece at most, and characters that consecutive pieces share at most.
LIMIT, OVERLAP = 2048, 200

#: Boundaries from the strongest kind to the weakest; a cut falls at the end of a match.
_KINDS = (
    re.compile(r"\n\s*\n+|\f"),
    re.compile(r"\n"),
    re.compile(r"[。！？!?；;]+[”’」』)）]*|\.+[”’\"')]*(?=\s)"),
    re.compile(r"[，、,:：]|\s+"),
)


def _boundaries(text: str) -> list[list[int]]:
    return [[m.end() for m in kind.finditer(text)] for kind in _KINDS]


def _combining_before(text: str, at: int, least: int) -> int:
    """Step back from a hard cut that would part a base character from its marks or joiners."""
    import unicodedata

    back = at
    while back > least and back < len(text) and (unicodedata.combining(text[back]) or text[back] in "‍️" or text[back - 1] == "‍"):
        back -= 1
    return back if back > least else at


Lengths = Callable[[str], np.ndarray]


def byte_lengths(text: str) -> np.ndarray:
    """UTF-8 bytes of each character."""
    cp = common.code_points(text)
    return 1 + (cp > 0x7F).astype(np.int64) + (cp > 0x7FF) + (cp > 0xFFFF)


def token_lengths(vocabulary: str = "byte_bpe_50k", folder: str | None = None) -> Lengths:
    """Tokens of the whole text by a public vocabulary that begin at each character."""

    def lengths(text: str) -> np.ndarray:
        from . import p08_tokenize as p8

        core = p8._encoder(vocabulary, folder or p8.VOCABULARY_DIR)
        sizes = [len(x) for x in core.decode_tokens_bytes(core.encode_ordinary(text))]
        begins = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64) if sizes else np.empty(0, dtype=np.int64)
        ends = np.cumsum(byte_lengths(text))  # of the characters
        return np.bincount(np.searchsorted(ends, begins, side="right"), minlength=len(text))[: len(text)]

    return lengths


def split_spans(text: str, limit: int = LIMIT, overlap: int = OVERLAP, lengths: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Spans (start, end) that cover the text in order, each of at most ``limit`` units.

    A unit is a character unless ``lengths`` gives the units of each character (tokens, bytes); their prefix sums are
    what is searched. The strongest boundary kind that leaves a piece at least half full is taken; else the
    weakest boundary at all; else the cut is hard. The next span begins at the first sentence or weaker
    boundary within the overlap before the cut, or exactly the overlap before it. A single character longer
    than the limit stays one piece. The overlap must be less than the limit.
    """
    if overlap >= limit:
        raise ValueError("the overlap must be less than the limit")
    n = len(text)
    # The prefix sums of ones are the positions themselves, which a range holds without memory.
    total = range(n + 1) if lengths is None else np.concatenate(([0], np.cumsum(lengths))).tolist()
    if total[n] <= limit:
        return [(0, n)]

    def reach(at: int, units: int) -> int:
        return bisect_right(total, total[at] + units) - 1

    def back(at: int, units: int) -> int:
        return bisect_left(total, total[at] - units)

    kinds, spans, start = _boundaries(text), [], 0
    merged = sorted({b for k in kinds[2:] for b in k} | {b for b in kinds[1]})
    while True:
        end = max(start + 1, min(n, reach(start, limit)))
        if end < n:
            least = spans[-1][1] if spans else start
            half, cut = max(reach(start, limit // 2), least), 0
            for kind in kinds:
                i = bisect_right(kind, end) - 1
                if i >= 0 and kind[i] > half:
                    cut = kind[i]
                    break
            if not cut:
                i = bisect_right(merged, end) - 1
                cut = merged[i] if i >= 0 and merged[i] > least else _combining_before(text, end, least)
            end = cut
        spans.append((start, end))
        if end >= n:
            return spans
        earliest = max(start + 1, back(end, overlap)) if overlap else end
        i = bisect_left(merged, earliest)
        start = merged[i] if i < len(merged) and merged[i] < end else earliest


def split_pieces(items: DataFrame, id_col: str = "id", content_col: str = "content", limit: int = LIMIT, overlap: int = OVERLAP, lengths: Lengths | None = None) -> DataFrame:
    """(id, piece int, n_pieces int, start_at int, end_at int, content) for every row; pieces are substrings of the unchanged content.

    ``lengths`` measures each character (``byte_lengths``, ``token_lengths(...)``); else limit and overlap are
    characters. Null content gives one piece with null content, empty content one empty piece. Repeated rows and null
    ids are kept as they come; other columns are dropped; an empty table gives an empty table. No shuffle.
    """
    rows = items.select(F.col(id_col).alias(id_col), F.col(content_col).cast("string").alias("_text"))
    return _cut(rows, limit, overlap, lengths)


def _spans(text: str | None, limit: int, overlap: int, lengths: Lengths | None) -> list[tuple[int, int]]:
    return [(0, 0)] if text is None else split_spans(text, limit, overlap, None if lengths is None else lengths(text))


def _cut(rows: DataFrame, limit: int, overlap: int, lengths: Lengths | None) -> DataFrame:
    """The rows, whose last column is _text, as pieces with the other columns."""
    kept = rows.columns[:-1]
    last = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.text_groups(batches, last):
            at, piece, many, start, end, content = [], [], [], [], [], []
            for i, text in enumerate(batch.column(last).to_pylist()):
                spans = _spans(text, limit, overlap, lengths)
                for k, (a, b) in enumerate(spans):
                    at.append(i)
                    piece.append(k)
                    many.append(len(spans))
                    start.append(a)
                    end.append(b)
                    content.append(None if text is None else text[a:b])
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(take) for i in range(last)), *(pa.array(x, pa.int32()) for x in (piece, many, start, end)), pa.array(content, pa.string())], names=[*kept, "piece", "n_pieces", "start_at", "end_at", "content"])

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{own}, piece int, n_pieces int, start_at int, end_at int, content string")


def first_ranks(counts: DataFrame) -> DataFrame:
    """(id, first bigint) of (id, document_id, old_rank, n): the running number of each item's first piece in its
    document, by old rank (null first) and id. Null documents are one document.

    The rows are sorted into ranges; each task numbers its own range, and what stands before it is a running sum
    over one row for each range and document. So a document of any size is spread, equal and null ranks too.
    """
    order = [F.col("document_id").asc_nulls_first(), F.col("old_rank").asc_nulls_first(), F.col("id")]
    x = common.checkpoint(counts.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sums = x.groupBy("document_id", "_range").agg(F.sum("n").alias("_sum"))
    before = Window.partitionBy("document_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col("document_id").alias("_d"), F.col("_range").alias("_r"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("document_id", "_range").orderBy(F.col("old_rank").asc_nulls_first(), "id").rowsBetween(Window.unboundedPreceding, -1)
    own = x.withColumn("_before", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    joined = own.join(offsets, own["document_id"].eqNullSafe(offsets["_d"]) & (own["_range"] == offsets["_r"]))
    return joined.select("id", (F.col("_offset") + F.col("_before")).alias("first"))


def split_chunks(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, lengths: Lengths | None = None) -> DataFrame:
    """Chunks as pieces: (chunk_id, document_id, heading, piece, n_pieces, start_at, end_at, content, rank_index).

    A chunk that occurs again with the same id counts once (they are equal copies; of differing ones that with the
    least hash of its columns stays); rows without an id are left out. The heading of a chunk goes with each of its
    pieces. Pieces are numbered on small rows (id and number of pieces), so a text is shuffled once, by its id.
    """
    rows = chunks.filter("id is not null").select("id", "document_id", F.col("rank_index").alias("old_rank"), "heading", F.col("content").cast("string").alias("_text"))
    rows = rows.withColumn("_h", F.xxhash64("document_id", "old_rank", "heading", "_text"))

    @F.pandas_udf("bigint")
    def pieces(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: len(_spans(t, limit, overlap, lengths)))

    counted = rows.select("id", "document_id", "old_rank", "_h", pieces("_text").alias("n"))
    one = counted.groupBy("id").agg(F.min(F.struct("_h", "document_id", "old_rank", "n")).alias("_o")).select("id", "_o.*")
    ranks = first_ranks(one.select("id", "document_id", "old_rank", "n"))
    least = Window.partitionBy("id").orderBy("_h")
    once = rows.withColumn("_n", F.row_number().over(least)).filter("_n = 1").join(ranks, "id")
    cut = _cut(once.select(F.col("id").alias("chunk_id"), "document_id", "heading", "first", "_text"), limit, overlap, lengths)
    return cut.withColumn("rank_index", F.col("first") + F.col("piece")).drop("first")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p1_found: chunks of kb_chunks that the splitter cuts."""
    return split_pieces(common.table(spark, sf_dir, "kb_chunks")).filter("n_pieces > 1").select(F.col("id").alias("chunk_id")).distinct()


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces of kb_chunks with heading and new rank."""
    return split_chunks(common.table(spark, sf_dir, "kb_chunks"))


QUERIES = {"p1_found": p1_found, "p1_pieces": p1_pieces}
SQL = {"p1_found": "SELECT DISTINCT id AS chunk_id FROM kb_chunks WHERE length(content) > 2048"}
