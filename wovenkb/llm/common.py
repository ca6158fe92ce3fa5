"""Helpers that the operators share: code point arrays, checkpoints and salted joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint, discard  # noqa: F401

#: Rows of an Arrow batch are handled in groups of about this many characters, so that memory doesn't grow with a batch.
GROUP_CHARS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_groups(batches: Iterator[pa.RecordBatch], text_at: int) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about GROUP_CHARS bytes of text each (a single longer text stays whole)."""
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(text_at)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        start = 0
        while start < n:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + GROUP_CHARS, side="right")))
            yield batch.slice(start, min(stop, n) - start)
            start = stop


def code_points(text: str) -> np.ndarray:
    """The code points of a text as an array; lone surrogates are kept."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _alnum_table() -> np.ndarray:
    return np.fromiter((chr(i).isalnum() for i in range(0x110000)), dtype=bool, count=0x110000)


_TABLES: dict[str, np.ndarray] = {}


def alnum_table() -> np.ndarray:
    """For each code point, whether it is a letter or digit (built once per process)."""
    if "alnum" not in _TABLES:
        _TABLES["alnum"] = _alnum_table()
    return _TABLES["alnum"]


def fold_table() -> np.ndarray:
    """For each code point its lower-case form without full-width difference; one code point for one."""
    if "fold" not in _TABLES:
        t = np.arange(0x110000, dtype=np.uint32)
        t[0xFF01:0xFF5F] -= 0xFEE0
        low = t.copy()
        for i in range(0x30000):
            c = chr(int(t[i])).lower()
            if len(c) == 1:
                low[i] = ord(c)
        _TABLES["fold"] = low
    return _TABLES["fold"]


def is_han(cp: np.ndarray) -> np.ndarray:
    """Whether code points are Chinese characters."""
    return ((cp >= 0x4E00) & (cp <= 0x9FFF)) | ((cp >= 0x3400) & (cp <= 0x4DBF)) | ((cp >= 0x20000) & (cp <= 0x323AF)) | ((cp >= 0xF900) & (cp <= 0xFAFF))


_BASE = 0x9E3779B97F4A7C15  # an odd multiplier; arithmetic is modulo 2^64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, applied to each value."""
    x = x.astype(np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def letter_codes() -> np.ndarray:
    """For each code point a 64-bit code of its folded form: equal for letters that differ in case or width only."""
    if "codes" not in _TABLES:
        _TABLES["codes"] = mix(fold_table().astype(np.uint64) + np.uint64(1))
    return _TABLES["codes"]


def window_hashes(codes: np.ndarray, width: int) -> np.ndarray:
    """Polynomial hash of every window of the given width over 64-bit codes, by doubling in log2(width) passes."""
    n = len(codes) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    cur, size, power, out, have = codes, 1, _BASE, None, 0
    with np.errstate(over="ignore"):
        while True:
            if width & size:
                part = cur[have : have + n]
                out = part if out is None else out * np.uint64(power) + part
                have += size
            if have == width:
                return out
            nxt = cur[: len(cur) - size] * np.uint64(power)
            nxt += cur[size:]
            cur, size, power = nxt, size * 2, power * power % (1 << 64)


def word_codes(codes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of adjacent positions ``at`` (words) over the codes of its letters; also where each run begins in ``at``."""
    n = len(at)
    if n == 0:
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    first = np.flatnonzero(np.concatenate(([True], np.diff(at) > 1)))
    with np.errstate(over="ignore"):
        place = np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))
        return mix(np.add.reduceat(codes * _powers(int(place.max()) + 1)[place], first)), first


def _powers(n: int) -> np.ndarray:
    have = _TABLES.get("powers")
    if have is None or len(have) < n:
        size = max(256, 1 << (n - 1).bit_length())
        have = np.full(size, _BASE, dtype=np.uint64)
        have[0] = 1
        with np.errstate(over="ignore"):
            _TABLES["powers"] = have = np.multiply.accumulate(have)
    return have


def split_hot_join(left: DataFrame, right: DataFrame, key: str, hot: DataFrame, how: str = "inner") -> DataFrame:
    """Join on a key of which a few values are hot. ``hot`` holds those values and is bounded by its maker
    (values with more than a share s of all rows: at most 1/s of them), so its rows of ``right`` are broadcast
    while all other rows go through a shuffled join. ``right`` has one row per key."""
    mark = F.broadcast(hot.select(key).withColumn("_hot", F.lit(True)))
    rows = left.join(mark, key, "left")
    few = right.join(F.broadcast(hot.select(key)), key, "left_semi")
    a = rows.filter("_hot").drop("_hot").join(F.broadcast(few), key, how)
    b = rows.filter("_hot is null").drop("_hot").join(right, key, how)
    return a.unionByName(b)
