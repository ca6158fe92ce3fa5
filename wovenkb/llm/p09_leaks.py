"""Evaluation texts leaking into training text.

Method: a positional inverted index, distributed by document. A first pass counts, over the whole corpus, the
terms that occur in the test items. From the counts every window of a test item gets its rarest terms as
anchors. A second pass builds the positional postings of each block of documents, intersects the
offset-adjusted posting lists of the anchors from the rarest on, and extends what they propose to exact phrase
matches; ``proximity`` relaxes this to anchors that stand near their place. Documents are never shuffled and nothing is collected but the
counts, which are bounded by the terms of the test items; those are handled in blocks of bounded size.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import common

#: Consecutive words (other languages) or letters, digits and Chinese characters (zh) that make a leak.
WORDS, LETTERS = 15, 30
#: Letters of a term of the index for zh items; for other items a term is a word.
GRAM = 8
#: Characters of test items that one block may hold; its index is what is broadcast.
BLOCK_CHARS = 4_000_000


def streams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Word codes and letter codes of a text: letters and digits only, case and full width folded."""
    cp = common.code_points(text)
    at = np.flatnonzero(common.alnum_table()[cp])
    codes = common.letter_codes()[cp]
    return common.word_codes(codes[at], at)[0], codes[at]


class TestItems:
    """The streams and anchors of one block of test items."""

    def __init__(self, items: list[tuple[object, str, bool]]) -> None:
        self.items = []
        for item_id, text, zh in items:
            words, letters = streams(text)
            stream, width, gram = (letters, LETTERS, GRAM) if zh else (words, WORDS, 1)
            if len(stream) >= width:
                self.items.append((item_id, zh, stream, common.window_hashes(stream, gram) if zh else stream, width, width - gram + 1))
        self.anchors: dict[bool, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def terms(self, zh: bool) -> np.ndarray:
        """The distinct terms, sorted."""
        own = [x[3] for x in self.items if x[1] == zh]
        return np.unique(np.concatenate(own)) if own else np.empty(0, dtype=np.uint64)

    def choose(self, df: dict[bool, np.ndarray]) -> None:
        """Anchors: for every window of an item that can be a leak the two rarest terms in it, by corpus counts."""
        for zh in (False, True):
            terms, found = self.terms(zh), []
            for k, (_, kind, _, own, _, span) in enumerate(self.items):
                if kind != zh:
                    continue
                count = df[zh][np.searchsorted(terms, own)]
                rank = count * len(own) + np.arange(len(own))  # distinct, the rarest first
                near = np.lib.stride_tricks.sliding_window_view(rank, span)
                two = np.unique(np.partition(near, min(1, span - 1), axis=1)[:, :2]) % len(own)
                found.append(np.stack([np.searchsorted(terms, own[two]), np.full(len(two), k), two]))
            x = np.concatenate(found, axis=1) if found else np.empty((3, 0), dtype=np.int64)
            x = x[:, np.argsort(x[0], kind="stable")]
            self.anchors[zh] = (terms, np.searchsorted(x[0], np.arange(len(terms) + 1)), x[1:])


def _places(own: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of a stream that hold one of the terms, and the term's number."""
    if not len(terms) or not len(own):
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    slot = np.searchsorted(terms, own)
    slot[slot == len(terms)] = 0
    at = np.flatnonzero(terms[slot] == own)
    return at, slot[at]


def _index(texts: list[str | None], zh: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One long stream over a block of documents (separated, so that no phrase crosses a border), where each begins, and its terms."""
    own, starts, n = [], [], 0
    gap = np.zeros(GRAM, dtype=np.uint64)
    for t in texts:
        starts.append(n)
        if t:
            s = streams(t)[int(zh)]
            own += [s, gap]
            n += len(s) + GRAM
    flat = np.concatenate(own) if own else np.empty(0, dtype=np.uint64)
    return flat, np.array(starts, dtype=np.int64), common.window_hashes(flat, GRAM) if zh else flat


def _search(texts: list[str | None], test: TestItems, zh: bool) -> list[tuple[int, int, int, int]]:
    """(document's place, item's place, longest exact run, anchors found in one diagonal) of a block of documents."""
    terms, bounds, (item, pos) = test.anchors[zh]
    if not len(terms):
        return []
    flat, starts, own = _index(texts, zh)
    at, slot = _places(own, terms)
    many = bounds[slot + 1] - bounds[slot]
    at, slot, many = at[many > 0], slot[many > 0], many[many > 0]
    if not len(at):
        return []
    # Postings of the anchors, offset-adjusted: equal (item, diagonal) means that they stand as in the item.
    where = np.repeat(bounds[slot] - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())
    diag = np.repeat(at, many) - pos[where]
    key = np.stack([item[where], diag])
    key, hits = np.unique(key, axis=1, return_counts=True) if key.shape[1] < 4096 else _unique_pairs(key)
    found: dict[tuple[int, int], list[int]] = {}
    for (k, d), n in zip(key.T.tolist(), hits.tolist()):
        if n < 2:
            continue
        _, _, stream, _, width, _ = test.items[k]
        lo, hi = max(0, -d), min(len(stream), len(flat) - d)
        same = np.concatenate(([False], flat[d + lo : d + hi] == stream[lo:hi], [False]))
        edges = np.flatnonzero(same[1:] != same[:-1])
        runs = edges[1::2] - edges[::2]
        for r in np.flatnonzero(runs >= width):
            doc = int(np.searchsorted(starts, d + lo + edges[2 * r], side="right")) - 1
            best = found.setdefault((doc, k), [0, 0])
            best[0], best[1] = max(best[0], int(runs[r])), max(best[1], n)
    return [(doc, k, run, n) for (doc, k), (run, n) in found.items()]


def _near(texts: list[str | None], test: TestItems, zh: bool, least: float) -> list[tuple[int, int, int, int]]:
    """(document's place, item's place, 0, anchors found) where at least the share ``least`` of an item's anchors stand in
    one document within twice the item's length, in any order: reworded or partly changed leaks."""
    terms, bounds, (item, pos) = test.anchors[zh]
    if not len(terms):
        return []
    flat, starts, own = _index(texts, zh)
    at, slot = _places(own, terms)
    many = bounds[slot + 1] - bounds[slot]
    if not many.sum():
        return []
    where = np.repeat(bounds[slot] - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())
    place, k, p = np.repeat(at, many), item[where], pos[where]
    doc = np.searchsorted(starts, place, side="right") - 1
    order = np.lexsort((place, k, doc))
    doc, k, p, place = doc[order], k[order], p[order], place[order]
    edge = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (k[1:] != k[:-1]), [True])))
    total = np.bincount(item, minlength=len(test.items))
    out = []
    for lo, hi in zip(edge[:-1], edge[1:]):
        want = max(2, math.ceil(least * total[k[lo]]))
        if hi - lo < want:
            continue
        span, seen, left, best = 2 * len(test.items[k[lo]][2]), Counter(), lo, 0
        for r in range(lo, hi):
            seen[p[r]] += 1
            while place[r] - place[left] > span:
                seen[p[left]] -= 1
                if not seen[p[left]]:
                    del seen[p[left]]
                left += 1
            best = max(best, len(seen))
        if best >= want:
            out.append((int(doc[lo]), int(k[lo]), 0, best))
    return out


def _unique_pairs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((key[1], key[0]))
    key = key[:, order]
    edge = np.flatnonzero(np.concatenate(([True], (key[:, 1:] != key[:, :-1]).any(axis=0), [True])))
    return key[:, edge[:-1]], np.diff(edge)


def _blocks(items: DataFrame, item_col: str, text_col: str, lang_col: str) -> Iterator[list[tuple[object, str, bool]]]:
    """The test items in blocks of at most BLOCK_CHARS characters (a longer single item is a block)."""
    block, size = [], 0
    rows = items.select(F.col(item_col).alias("i"), F.col(text_col).cast("string").alias("t"), F.lower(F.trim(F.col(lang_col))).alias("l")).filter("t is not null and i is not null").distinct()
    for r in rows.toLocalIterator():
        if block and size + len(r.t) > BLOCK_CHARS:
            yield block
            block, size = [], 0
        block.append((r.i, r.t, (r.l or "").startswith("zh")))
        size += len(r.t)
    if block:
        yield block


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", lang_col: str = "lang", proximity: float | None = None) -> DataFrame:
    """(doc id, item id, longest bigint, anchors bigint): the documents that share a passage with a test item.

    A passage is at least 15 consecutive words, or for zh items 30 consecutive letters, digits or Chinese
    characters; only letters and digits are compared, without regard to case and full-width forms. ``longest``
    is the longest such run and ``anchors`` the most anchor terms found in one alignment. With ``proximity``, the
    share of an item's anchors that must stand near each other, matches without a passage come too, with longest 0. Null and empty texts
    match nothing, items shorter than a passage neither; null lang counts as not Chinese; a repeated row of
    documents gives its rows again; other columns are dropped; an empty table on either side gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    id_type, item_type = rows.schema["_id"].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    item_arrow = to_arrow_type(items.schema[item_col].dataType)
    schema = f"`{id_col}` {id_type}, `{item_col}` {item_type}, longest bigint, anchors bigint"
    spark, results = docs.sparkSession, []
    for block in _blocks(items, item_col, item_text_col, lang_col):
        test = TestItems(block)
        terms = {zh: test.terms(zh) for zh in (False, True)}

        def count(batches: Iterator[pa.RecordBatch], terms=terms) -> Iterator[pa.RecordBatch]:
            total = {zh: np.zeros(len(t), dtype=np.int64) for zh, t in terms.items()}
            for batch in common.text_groups(batches, 0):
                texts = batch.column(0).to_pylist()
                for zh, t in terms.items():
                    if not len(t):  # no item of this kind: its stream isn't made
                        continue
                    total[zh] += np.bincount(_places(_index(texts, zh)[2], t)[1], minlength=len(t))
            for zh, n in total.items():
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), zh)), pa.array(at), pa.array(n[at])], names=["zh", "term", "n"])

        counts = rows.select("_text").mapInArrow(count, "zh boolean, term bigint, n bigint").groupBy("zh", "term").agg(F.sum("n").alias("n")).toPandas()
        df = {}
        for zh, t in terms.items():
            df[zh] = np.zeros(len(t), dtype=np.int64)
            own = counts[counts.zh == zh]
            df[zh][own.term.to_numpy(dtype=np.int64)] = own.n.to_numpy(dtype=np.int64)
        test.choose(df)
        sent = spark.sparkContext.broadcast(test)

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            test = sent.value
            for batch in common.text_groups(batches, 1):
                texts = batch.column(1).to_pylist()
                hits = [x for zh in (False, True) for x in _search(texts, test, zh)]
                if proximity is not None:
                    exact = {x[:2] for x in hits}
                    hits += [x for zh in (False, True) for x in _near(texts, test, zh, proximity) if x[:2] not in exact]
                if hits:
                    doc, k, run, n = map(list, zip(*hits))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc)), pa.array([test.items[i][0] for i in k]).cast(item_arrow), pa.array(run, pa.int64()), pa.array(n, pa.int64())], names=[id_col, item_col, "longest", "anchors"])

        results.append(rows.mapInArrow(search, schema))
    return reduce(DataFrame.unionByName, results) if results else spark.createDataFrame([], schema)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p9_found: documents against eval_items."""
    return find_leaks(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "eval_items")).select("doc_id", "item_id").distinct()


def p9_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact matches with their lengths, and proximity matches."""
    return find_leaks(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "eval_items"), proximity=0.6)


QUERIES = {"p9_found": p9_found, "p9_matches": p9_matches}
SQL: dict[str, str] = {}
