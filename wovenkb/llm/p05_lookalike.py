"""Visually identical text with different characters.

Method: compatibility normalisation and deletion of ignorable characters, then look-alike lattices. Each
letter opens its class of look-alikes; Viterbi finds the best path under character bigram scores of the
collection with a penalty for changing the script inside a word. The lattice is made of the classes alone,
not of the characters that were typed, so all texts that look the same get the same form.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

# Letters of other scripts that look like a Latin letter, and Greek and Cyrillic ones that look like each other.
LOOKALIKES = {
    "A": "ΑА", "B": "ΒВ", "C": "С", "E": "ΕЕ", "H": "ΗН", "I": "ΙІӀ", "J": "ЈͿ", "K": "ΚК", "M": "ΜМ", "N": "Ν", "O": "ΟОՕ", "P": "ΡР",
    "S": "ЅՏ", "T": "ΤТ", "W": "Ԝ", "X": "ΧХ", "Y": "ΥУҮ", "Z": "Ζ", "Q": "Ԛ", "G": "Ԍ",
    "a": "аα", "c": "с", "d": "ԁ", "e": "е", "g": "ɡ", "h": "һհ", "i": "іι", "j": "јϳ", "l": "ӏ", "n": "ո", "o": "οоօ", "p": "рρ",
    "q": "ԛ", "s": "ѕ", "u": "սυ", "v": "νѵ", "w": "ԝ", "x": "х", "y": "уү",
    "Γ": "Г", "Π": "П", "Φ": "Ф", "κ": "к",
}

#: Kinds of compatibility characters that look the same as what they stand for; superscripts, circles and the like don't.
_SAME_LOOK = {"<wide>", "<narrow>", "<compat>", "<noBreak>", "<small>", "<initial>", "<medial>", "<final>", "<isolated>", "<vertical>"}

#: Cost of a change of script inside a word, weight of single letters beside bigrams, and count of an unseen letter.
SCRIPT_CHANGE, SINGLE, UNSEEN = 8.0, 5.0, 0.01
#: Bigrams under this share of all count as unseen, so that a model has at most 1/SHARE of them.
SHARE = 1e-6


def _script(ch: str) -> str:
    return unicodedata.name(ch, "OTHER").split()[0]


CLASSES: dict[str, tuple[str, ...]] = {ch: (base, *others) for base, others in LOOKALIKES.items() for ch in (base, *others)}
_ALPHABETS = {_script(ch) for ch in CLASSES}
SCRIPTS: dict[str, str | None] = {}


def script_of(ch: str) -> str | None:
    """The script of a letter, with look-alikes or without, of one of the alphabets that share looks; else None."""
    if ch not in SCRIPTS:
        s = _script(ch) if ch.isalpha() else None
        SCRIPTS[ch] = s if s in _ALPHABETS else None
    return SCRIPTS[ch]


_FOLD: dict[str, str] = {}


def _folded(ch: str) -> str:
    """What a character becomes by compatibility normalisation; ignorable characters vanish, spaces become one kind."""
    kind = unicodedata.category(ch)
    o = ord(ch)
    if kind == "Cf" or 0xFE00 <= o <= 0xFE0F or 0xE0100 <= o <= 0xE01EF or o in (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, 0x180B, 0x180C, 0x180D):
        return ""
    if kind in ("Zs", "Zl", "Zp") or ch in "\t\n\v\f\r\x85":
        return " "
    how = unicodedata.decomposition(ch).split(" ")[0]
    if how in _SAME_LOOK:
        return unicodedata.normalize("NFKC", ch)
    return "" if kind == "Cc" else ch


def compatible(text: str) -> str:
    """Compatibility form in decomposed order, with single spaces and no ignorable characters."""
    if not text.isascii():
        for ch in set(text):
            if ch not in _FOLD:
                _FOLD[ch] = _folded(ch)
        text = unicodedata.normalize("NFD", "".join(map(_FOLD.__getitem__, text)))
    return " ".join(text.split())


def bigrams(text: str) -> Counter:
    """Bigrams of the letters that have look-alikes and their neighbours within words of a compatible text."""
    out: Counter = Counter()
    for word in text.split(" "):
        letters = "^" + "".join(ch for ch in word if not unicodedata.combining(ch)) + "$"
        out.update((a, b) for a, b in zip(letters, letters[1:]) if a in CLASSES or b in CLASSES)
    return out


def _first(found: tuple[float, str]) -> float:
    """The score of a path; of equal paths the first is taken, which has the base letters of the classes."""
    return round(found[0], 9)


class Model:
    """Bigram scores of the collection and the words already solved."""

    def __init__(self, counts: dict[tuple[str, str], int]) -> None:
        self.counts = counts
        self.totals: Counter = Counter()
        self.letters: Counter = Counter()
        for (a, b), n in counts.items():
            self.totals[a] += n
            self.letters[b] += n
        self.all = sum(self.letters.values()) + 1
        self.words: dict[str, str] = {}

    def score(self, a: str, b: str) -> float:
        """Log weight of b after a, less the penalty if they are letters of different scripts."""
        s = math.log((self.counts.get((a, b), 0) + SINGLE * (self.letters[b] + UNSEEN) / self.all) / (self.totals[a] + SINGLE))
        x, y = script_of(a), script_of(b)
        return s - SCRIPT_CHANGE if x and y and x != y else s

    def solve(self, word: str) -> str:
        """The best path through the lattice of a word (decomposed letters); marks stay where they are."""
        key = "".join(CLASSES[ch][0] if ch in CLASSES else ch for ch in word)
        if key in self.words:
            return self.words[key]
        letters = [(i, ch) for i, ch in enumerate(key) if not unicodedata.combining(ch)]
        best: dict[str, tuple[float, str]] = {"^": (0.0, "")}
        for _, ch in letters:
            states = CLASSES.get(ch, (ch,))
            best = {c: max(((s + self.score(p, c), path + c) for p, (s, path) in best.items()), key=_first) for c in states}
        path = max(((s + self.score(p, "$"), path) for p, (s, path) in best.items()), key=_first)[1]
        out = list(key)
        for (i, _), c in zip(letters, path):
            out[i] = c
        if len(self.words) < 200_000:  # a bounded cache, not a bound on the words
            self.words[key] = "".join(out)
        return "".join(out)

    def canonical(self, text: str) -> str:
        """The one form of all texts that look like this one."""
        words = compatible(text).split(" ")
        return unicodedata.normalize("NFC", " ".join(w if not any(ch in CLASSES for ch in w) else self.solve(w) for w in words))


def fit_model(texts: DataFrame, text_col: str) -> Model:
    """Counts over all texts of every bigram in which a letter has look-alikes, its neighbour being any character or a
    word's edge. What is collected is bounded by SHARE."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()
        for df in batches:
            for t in df["_text"].dropna():
                total.update(bigrams(compatible(t)))
        yield pd.DataFrame([(a, b, n) for (a, b), n in total.items()], columns=["a", "b", "n"])

    pairs = texts.select(F.col(text_col).cast("string").alias("_text")).mapInPandas(count, "a string, b string, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n"))
    rows = pairs.crossJoin(F.broadcast(pairs.agg(F.sum("n").alias("_all")))).filter(F.col("n") >= F.lit(SHARE) * F.col("_all")).collect()
    return Model({(r.a, r.b): r.n for r in rows})


def canonicalize(rows: DataFrame, text_col: str, model: Model, out_col: str = "canonical") -> DataFrame:
    """The rows with one more column (an old one of that name is replaced): the canonical text.

    Null stays null; empty and blank texts become empty; repeated rows and other columns are kept.
    """
    sent = rows.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        m = sent.value
        return texts.map(lambda t: None if t is None else m.canonical(t))

    return rows.withColumn(out_col, run(F.col(text_col).cast("string")))


def lookalike_pairs(rows: DataFrame, id_col: str, text_col: str, group_col: str | None, model: Model) -> DataFrame:
    """(id_a, id_b): two ids of one group whose texts differ in code points but have the same canonical form.

    Rows with null id or text give no pair, and neither do null groups; repeats count once. An id with several
    texts takes part with each. Every pair of differing texts is part of the result, so the join makes no
    row that isn't; equal texts are brought together first and only pairs of different texts are expanded.
    """
    group = F.col(group_col) if group_col else F.lit("")
    x = canonicalize(rows.select(F.col(id_col).alias("_id"), group.cast("string").alias("_g"), F.col(text_col).cast("string").alias("_t")).filter("_id is not null and _t is not null and _g is not null").distinct(), "_t", model, "_c")
    x = common.checkpoint(x)
    texts = x.select("_g", "_c", "_t").distinct()
    other = texts.select("_g", "_c", F.col("_t").alias("_t2"))
    differ = texts.join(other, ["_g", "_c"]).filter(F.col("_t") < F.col("_t2")).drop("_c")  # pairs of spellings, not of rows
    one = x.select("_g", "_t", F.col("_id").alias("_a"))
    two = x.select("_g", F.col("_t").alias("_t2"), F.col("_id").alias("_b"))
    pairs = differ.join(one, ["_g", "_t"]).join(two, ["_g", "_t2"]).filter("_a != _b")
    return pairs.select(F.least("_a", "_b").alias("id_a"), F.greatest("_a", "_b").alias("id_b")).distinct()


def _model(spark: SparkSession, sf_dir: str) -> Model:
    names = common.table(spark, sf_dir, "kb_entities").select(F.col("name").alias("t"))
    more = common.table(spark, sf_dir, "extracted_entities").select(F.col("name").alias("t"))
    return fit_model(names.unionByName(more).unionByName(common.table(spark, sf_dir, "kb_events").select(F.col("title").alias("t"))), "t")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p5_found: entity names within their type, and event titles."""
    model = _model(spark, sf_dir)
    names = lookalike_pairs(common.table(spark, sf_dir, "kb_entities"), "id", "name", "entity_type", model)
    titles = lookalike_pairs(common.table(spark, sf_dir, "kb_events"), "id", "title", None, model)
    return names.select(F.lit("name").alias("field"), "id_a", "id_b").unionByName(titles.select(F.lit("title").alias("field"), "id_a", "id_b"))


def p5_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw extracted mentions with their names in the one form."""
    return canonicalize(common.table(spark, sf_dir, "extracted_entities").select("mention_id", "name"), "name", _model(spark, sf_dir))


QUERIES = {"p5_found": p5_found, "p5_names": p5_names}
SQL: dict[str, str] = {}
