"""Encoding of a whole corpus with a public byte-level BPE vocabulary.

Method: the contiguous rank array. A word's part boundaries are kept side by side with the rank of each
adjacent pair; the minimum is found by a scan, its right boundary deleted and the two neighbouring ranks
refreshed. ``merge_word`` states it in Python; the bulk of the work runs the same algorithm compiled, in
tiktoken, because Python is too slow for whole corpora. Both give the ids of the public vocabulary.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

VOCABULARY_DIR = os.environ.get("WOVENKB_TOKENIZERS", "/opt/tokenizers")

# Fixed value: the split pattern that belongs to the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_ENCODERS: dict[tuple[str, str], object] = {}


def load_ranks(name: str, folder: str = VOCABULARY_DIR) -> dict[bytes, int]:
    """The ranks of a .tiktoken vocabulary file."""
    with open(f"{folder}/{name}.tiktoken", "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word by the contiguous rank array: O(n * merges), meant for short words."""
    if word in ranks:
        return [ranks[word]]
    none = 1 << 60
    bounds = list(range(len(word) + 1))
    pair = [ranks.get(word[i : i + 2], none) for i in range(len(word) - 1)]
    while pair:
        low = min(pair)
        if low == none:
            break
        at = pair.index(low)
        del bounds[at + 1]
        del pair[at]
        for i in (at - 1, at):
            if 0 <= i < len(pair):
                pair[i] = ranks.get(word[bounds[i] : bounds[i + 2]], none)
    return [ranks[word[a:b]] for a, b in zip(bounds, bounds[1:])]


def encode_text(text: str, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a text by ``merge_word``: the plain statement that tests hold the operator against."""
    import regex

    return [i for w in regex.findall(PATTERN, text) for i in merge_word(w.encode("utf-8", "replace"), ranks)]


def _encoder(name: str, folder: str):
    key = (name, folder)
    if key not in _ENCODERS:
        import tiktoken

        _ENCODERS[key] = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=load_ranks(name, folder), special_tokens={})
    return _ENCODERS[key]


def encode_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k", folder: str = VOCABULARY_DIR) -> DataFrame:
    """One row (id, ids array<int>) for each input row, in one pass without a shuffle.

    Null and empty text give an empty list. Strings that look like special tokens are ordinary text. Null ids,
    repeated rows and texts of any length are kept as they come; other columns are dropped. An empty table
    gives an empty table.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    id_type = rows.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        core = _encoder(vocabulary, folder)
        for batch in common.text_groups(batches, 1):
            parts = [core.encode_ordinary(t) if t else [] for t in batch.column(1).to_pylist()]
            offsets = np.zeros(len(parts) + 1, dtype=np.int32)
            np.cumsum([len(p) for p in parts], out=offsets[1:])
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.fromiter(chain.from_iterable(parts), dtype=np.int32, count=int(offsets[-1]))))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[id_col, "ids"])

    return rows.mapInArrow(run, f"`{id_col}` {id_type}, ids array<int>")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p8_ids: every row of documents."""
    return encode_corpus(common.table(spark, sf_dir, "documents"))


QUERIES = {"p8_ids": p8_ids}
SQL: dict[str, str] = {}
