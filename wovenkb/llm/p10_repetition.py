"""Repetition inside a single document.

Method: the rule bitmask ledger. Each text is measured once; every rule is evaluated once on the
measurements, its failure stored as one bit of a mask, and policies (versioned sets of rules) and their
ablations are then bit operations and aggregates over the stored ledger, without reading a text again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Length in letters and digits of a passage that counts as repeated, in Chinese text and in other text.
PASSAGE_HAN, PASSAGE_OTHER = 20, 40

MEASURES = ("n_letters", "n_covered", "passage_share", "line_share", "paragraph_share", "sentence_share", "top_5gram_share")


@dataclass(frozen=True)
class Rule:
    """Fails a text if the measure is greater than the limit."""

    bit: int
    name: str
    measure: str
    limit: float


#: Bits are never reused for another meaning, so old ledgers stay readable.
RULES = (
    Rule(0, "passages", "passage_share", 1 / 3),
    Rule(1, "lines", "line_share", 0.3),
    Rule(2, "paragraphs", "paragraph_share", 0.3),
    Rule(3, "sentences", "sentence_share", 0.3),
    Rule(4, "top_5gram", "top_5gram_share", 0.15),
)

#: Versioned policies: the bits that reject a text.
POLICIES = {"v1": 0b00001, "v2": 0b01111, "v3": 0b11111}


def covered(stream: np.ndarray, width: int) -> np.ndarray:
    """Marks of the positions that lie in a window of ``width`` which already began at an earlier position.

    Windows are compared by 64-bit hashes; a repeated passage longer than the width is the union of its
    windows, and overlaps with the earlier occurrence count.
    """
    n = len(stream)
    marks = np.zeros(n, dtype=bool)
    h = common.window_hashes(stream, width)
    if len(h) < 2:
        return marks
    s = np.sort(h)
    if not (s[1:] == s[:-1]).any():  # most texts end here: a plain sort is much cheaper than one that keeps places
        return marks
    order = np.argsort(h, kind="stable")
    s = h[order]
    again = order[1:][s[1:] == s[:-1]]
    if len(again):
        edge = np.zeros(n + 1, dtype=np.int32)
        np.add.at(edge, again, 1)
        np.add.at(edge, again + width, -1)
        marks = np.cumsum(edge[:-1]) > 0
    return marks


def _unit_share(units: list[str]) -> float:
    """Share of the characters that stand in units equal to an earlier unit of the same text."""
    units = [u for u in map(str.strip, units) if u]
    total = sum(map(len, units))
    return 1 - sum(map(len, set(units))) / total if total else 0.0


def _top_gram_share(stream: np.ndarray, width: int = 5) -> float:
    """Share of the letters that the most frequent run of five words or (Chinese) five characters would cover."""
    if len(stream) < width:
        return 0.0
    h = np.sort(common.window_hashes(stream, width))
    edges = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1], [True])))
    top = int(np.diff(edges).max())
    return min(1.0, top * width / len(stream)) if top > 1 else 0.0


def measure(text: str | None) -> tuple:
    """All measurements of one text, in the order of MEASURES; null and texts without letters give zeros."""
    if not text:
        return (0, 0, 0.0, 0.0, 0.0, 0.0, 0.0)
    cp = common.code_points(text)
    at = np.flatnonzero(common.alnum_table()[cp])
    n = len(at)
    if n == 0:
        return (0, 0, 0.0, 0.0, 0.0, 0.0, 0.0)
    letters = cp[at]
    codes = common.letter_codes()[letters]
    han = 2 * int(np.count_nonzero(common.is_han(letters))) > n
    c = int(np.count_nonzero(covered(codes, PASSAGE_HAN if han else PASSAGE_OTHER)))
    low = text.lower()
    return (n, c, c / n, _unit_share(low.split("\n")), _unit_share(low.split("\n\n")), _unit_share(low.replace("。", "\n").replace(". ", "\n").split("\n")), _top_gram_share(codes if han else common.word_codes(codes, at)[0]))


def repetition_ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ledger: (id, the MEASURES, failed bigint mask), one row for each input row, without a shuffle.

    ``passage_share`` is the share of letters, digits and Chinese characters that lie in passages (40 of them,
    20 where most are Chinese) which occurred earlier in the same text, overlaps included, ignoring case,
    full-width forms, punctuation and spacing. Null, empty and blank texts get zero shares and no failure bit;
    repeated rows and null ids are kept; other columns are dropped; an empty table gives an empty ledger.
    A text is measured whole, in time n log n.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    id_type = rows.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.text_groups(batches, 1):
            found = [measure(t) for t in batch.column(1).to_pylist()]
            cols = [np.array(x) for x in zip(*found)]
            failed = np.zeros(len(found), dtype=np.int64)
            for r in RULES:
                failed |= (cols[MEASURES.index(r.measure)] > r.limit).astype(np.int64) << r.bit
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c.astype(np.int64 if i < 2 else np.float64)) for i, c in enumerate(cols)), pa.array(failed)], names=[id_col, *MEASURES, "failed"])

    return rows.mapInArrow(run, f"`{id_col}` {id_type}, n_letters bigint, n_covered bigint, " + ", ".join(f"{m} double" for m in MEASURES[2:]) + ", failed bigint")


def rejected(policy: str) -> Column:
    """Whether a ledger row fails a policy."""
    return F.col("failed").bitwiseAND(F.lit(POLICIES[policy])) != 0


def ablations(ledger: DataFrame) -> DataFrame:
    """For each policy and rule: texts the policy rejects, texts the rule alone fails, and texts only this rule rejects.

    One bitwise aggregate over the distinct masks, of which there are at most 2^rules however many rows the ledger has.
    """
    masks = ledger.groupBy("failed").agg(F.count("*").alias("n"))
    policies = F.explode(F.array(*(F.struct(F.lit(k).alias("policy"), F.lit(v).cast("bigint").alias("bits")) for k, v in POLICIES.items())))
    rules = F.explode(F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("bigint").alias("bit")) for r in RULES)))
    x = masks.select("failed", "n", policies.alias("p")).select("failed", "n", "p.*", rules.alias("r")).select("failed", "n", "policy", "bits", "r.*").filter(F.col("bits").bitwiseAND(F.col("bit")) != 0)
    hit = F.col("failed").bitwiseAND(F.col("bits"))
    return x.groupBy("policy", "rule").agg(
        F.coalesce(F.sum(F.when(hit != 0, F.col("n"))), F.lit(0)).alias("policy_rejects"),
        F.coalesce(F.sum(F.when(F.col("failed").bitwiseAND(F.col("bit")) != 0, F.col("n"))), F.lit(0)).alias("rule_fails"),
        F.coalesce(F.sum(F.when(hit == F.col("bit"), F.col("n"))), F.lit(0)).alias("only_this_rule"),
    )


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p10_found: texts that policy v1 rejects."""
    return repetition_ledger(common.table(spark, sf_dir, "documents")).filter(rejected("v1")).select("doc_id").distinct()


def p10_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ledger of documents."""
    return repetition_ledger(common.table(spark, sf_dir, "documents"))


def p10_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Policies and ablations over documents."""
    return ablations(repetition_ledger(common.table(spark, sf_dir, "documents")))


QUERIES = {"p10_found": p10_found, "p10_ledger": p10_ledger, "p10_ablations": p10_ablations}
SQL: dict[str, str] = {}
