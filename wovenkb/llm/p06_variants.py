"""Variant spellings of names typed by people.

Method: the pigeonhole segment join. Each name is read as a distinctive part and a rest. Names with k edits are
proposed by cutting a part into segments of which some stay intact, whatever the k edits hit: those are looked up, at
shifted positions too, in an inverted index, and a banded edit distance verifies what it proposes. Two edits are allowed
between names of equal descriptions (three segments of the distinctive part, one of them intact); one edit between all
(four segments, two of them intact, and the other part whole, which keeps the groups of common words small).

Before that names are brought to readings that know titles, legal forms, order, homophones and the collection's own
words: a rare word that shortens a common word of the collection is read as that word. Initials and shortened names are
linked afterwards to the one entity they can mean. Links become classes by connected components.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, graph
from .p05_lookalike import Model, _model, canonicalize

# Short forms of English given names that no rule gives (``shortens`` knows the regular ones).
NICKNAMES = {
    "abigail": "gail", "adelaide": "addie della", "agnes": "nessie", "albert": "bert", "alexander": "sandy sasha xander lex", "alexandra": "sasha sandra lexi", "alfred": "fred", "alice": "ally", "amelia": "millie", "andrew": "drew",
    "ann": "nancy nan", "anthony": "tony", "arabella": "bella", "archibald": "baldie", "augustus": "gus", "barbara": "babs bobbie", "bartholomew": "bart", "beatrice": "trixie", "beatriz": "trixie", "bernard": "bernie", "bridget": "biddy",
    "caroline": "carrie lina", "catherine": "kate kathy kitty kit katie", "cecilia": "cissy celia", "charles": "chuck chas charley", "charlotte": "lottie", "christina": "tina", "christopher": "kit topher", "clarence": "clay", "constance": "connie",
    "cordelia": "delia", "daniel": "danny", "david": "davy", "deborah": "debbie", "dmitri": "dima mitya", "dorothy": "dot dolly", "edmund": "ned ted", "edward": "ted ned teddy", "edwin": "ned", "eleanor": "nell nora nellie", "elizabeth": "betty betsy liz libby bess",
    "emily": "millie", "ernest": "ernie", "esther": "hetty", "eugene": "gene", "florence": "flossie", "frances": "fanny", "francis": "frank", "franklin": "frank", "geoffrey": "jeff", "george": "dod", "gerald": "jerry", "gertrude": "trudy", "gilbert": "bert",
    "harold": "hal harry", "helen": "nell ellie", "henrietta": "hetty etta", "henry": "harry hank hal", "herbert": "bert", "hubert": "bert", "isabella": "bella", "james": "jim jimmy", "jane": "jenny", "janet": "jessie", "jeffrey": "geoff", "jeremiah": "jerry",
    "jerome": "jerry", "joanna": "nan", "john": "jack johnny", "jonathan": "nathan", "joseph": "joe", "josephine": "jo josie fina", "julia": "jill", "katherine": "kit kitty kate", "kenneth": "ken", "lawrence": "larry", "leonard": "len lenny", "louise": "lulu", "lucille": "lucy",
    "margaret": "peggy meg maggie daisy peg madge rita", "martha": "patty mattie", "mary": "molly polly", "matilda": "tilly", "matthew": "matty", "mercedes": "sadie", "michael": "mike mick micky", "mildred": "milly", "nathaniel": "nat", "nicholas": "nick klaus", "oliver": "noll",
    "olivia": "livvy", "patricia": "trish patsy", "patrick": "paddy pat", "penelope": "nell", "philip": "pip flip", "prudence": "prue", "rachel": "shelly", "raymond": "ray", "rebecca": "becky becca", "reginald": "rex", "richard": "dick rick", "robert": "bob bobby", "rosemary": "romy",
    "rudolph": "dolph", "samantha": "sammie", "sarah": "sally sadie", "sigmund": "ziggy", "sophia": "sukie", "stephen": "steve", "susan": "sukey", "susannah": "sue suzy", "theodore": "ted teddy", "theresa": "tess", "thomas": "tom", "timothy": "tim", "veronica": "ronnie",
    "victoria": "vicky vicki tori", "vincent": "vinny", "virginia": "ginger ginny", "walter": "wat", "wilhelmina": "mina billie", "william": "bill billy liam", "winifred": "freddie", "zachary": "zak",
}

# Titles and legal forms.
TITLES = frozenset("mr mrs ms miss dr prof professor sir dame madam mx hon rev eng".split())
LEGAL = frozenset("ltd limited inc incorporated corp corporation plc gmbh llc llp lp co company ag sa bv nv pty".split())
ZH_TITLES = re.compile("(先生|女士|小姐|经理|总经理|总监|博士|教授|老师|主任|总)$")
ZH_LEGAL = re.compile("(股份有限公司|有限责任公司|有限公司|集团公司|公司|集团)$")

#: A word of this share of all words of its kind of names, and of so many at least, is common; there are at most 1/COMMON.
COMMON, COMMON_LEAST = 1e-4, 3
#: How much more frequent a word must be than what shortens it.
RATIO = 3
#: A word so many times rarer than another common one may be an error for it.
ERROR_RATIO = 10

_ROOTS: dict[str, list[str]] = {}
for _full, _short in NICKNAMES.items():
    for _s in _short.split():
        _ROOTS.setdefault(_s, []).append(_full)

_HAN = re.compile(r"[㐀-鿿]")
_ROMAN = re.compile(r"(?:\d+|[ivx]+)$")


def shortens(x: str, word: str) -> bool:
    """Whether ``x`` is a regular short form of a given name: a piece of it, with or without a diminutive ending."""
    stem = re.sub("(?:ie|ey|y|i)$", "", x)
    stem = stem[:-1] if len(stem) > 3 and stem[-1] == stem[-2] else stem
    return len(word) > len(x) > 1 and any(len(v) > 2 and v in word or len(v) > 1 and word.startswith(v) for v in (x, stem))


def abbreviates(x: str, word: str) -> bool:
    """Whether ``x`` can be an abbreviation: it begins as the word does and holds some of its letters in their order."""
    rest = iter(word)
    return len(word) > len(x) + 1 > 2 and x[0] == word[0] and not _ROMAN.match(x) and all(ch in rest for ch in x)


class Lexicon:
    """What the readings know of a collection: its common words, for people and for organisations, and the sound of characters.

    ``sounds`` gives the syllable of a Chinese character, and its syllable as a surname.
    """

    def __init__(self, people: dict[str, int] | None = None, firms: dict[str, int] | None = None, sounds: dict[str, tuple[str, str]] | None = None) -> None:
        self.people, self.firms, self.sounds = people or {}, firms or {}, sounds or {}
        self.known: dict[str, str] = {}

    def roots(self, given: str) -> list[str]:
        """A given name and what it may be short for."""
        own = self.people.get(given, 0)
        regular = [w for w, n in self.people.items() if n >= RATIO * own and w not in TITLES and shortens(given, w)] if len(given) > 1 else []
        return list(dict.fromkeys([given, *_ROOTS.get(given, ()), *sorted(regular)]))

    def word(self, x: str) -> str:
        """The common word that a word of an organisation's name abbreviates, or the word itself."""
        if x not in self.known:
            own, bare = self.firms.get(x, 0), x.replace("'", "")
            found = [(not w.startswith(bare), -n, w) for w, n in self.firms.items() if n >= RATIO * own and w != x and w not in LEGAL and len(bare) > 1 and abbreviates(bare, w)]
            if len(self.known) > 200_000:  # a bounded memory, not a bound on the words
                self.known.clear()
            self.known[x] = min(found)[2] if found else x
        return self.known[x]

    def both_words(self, x: str, y: str) -> bool:
        """Whether two different words are both words of their own: common, and neither so much rarer that it may be an error."""
        a, b = (max(self.people.get(w, 0), self.firms.get(w, 0)) for w in (x, y))
        return min(a, b) * ERROR_RATIO > max(a, b)


def pinyin(spark: SparkSession) -> dict[str, tuple[str, str]]:
    """The syllable of each Chinese character, and as a surname: the public transliteration data that Spark brings along."""
    if not _SOUNDS:
        chars = [chr(c) for c in range(0x3400, 0xA000)]
        kinds = spark._jvm.com.ibm.icu.text.Transliterator
        ways = [kinds.getInstance(k).transliterate("\n".join(chars)).split("\n") for k in ("Han-Latin", "Han-Latin/Names; Han-Latin")]
        plain = lambda x: "".join(ch for ch in unicodedata.normalize("NFD", x.strip()) if not unicodedata.combining(ch) or ch == "\u0308").replace("u\u0308", "ü")
        _SOUNDS.update({ch: (plain(a), plain(b)) for ch, a, b in zip(chars, *ways)})
    return _SOUNDS


_SOUNDS: dict[str, tuple[str, str]] = {}


def fit_lexicon(nodes: DataFrame) -> Lexicon:
    """The lexicon of (entity_type, _c): words are counted over all names; what is collected has a bound, see COMMON."""
    kind = F.lower(F.trim("entity_type"))
    words = nodes.select(kind.alias("t"), F.explode(F.split(F.regexp_replace("_c", r"[.,()（）]", " "), r"\s+")).alias("w")).filter("length(w) > 1 and w rlike '[a-z]'").groupBy("t", "w").agg(F.count("*").alias("n"))
    total = words.groupBy("t").agg(F.sum("n").alias("_all"))
    rows = words.join(F.broadcast(total), "t").filter(F.col("n") >= F.greatest(F.lit(COMMON_LEAST), F.lit(COMMON) * F.col("_all"))).collect()
    return Lexicon({r.w: r.n for r in rows if r.t == "person"}, {r.w: r.n for r in rows if r.t != "person"}, pinyin(nodes.sparkSession))


def person_readings(name: str, lexicon: Lexicon) -> list[tuple[str, str, str]]:
    """(kind, a, b) of a folded person's name. Kinds: full (a surname, b given), initial and its whole form, latin and zh for pinyin."""
    if _HAN.search(name):
        core = re.sub(r"\(.*?\)|\s+", "", name)
        core = ZH_TITLES.sub("", core) if len(core) > 2 else core
        if not core:
            return []
        given = "".join(lexicon.sounds.get(ch, (ch, ch))[0] for ch in core[1:])
        out = [("same", core[0], given)]
        for surname in dict.fromkeys(lexicon.sounds.get(core[0], (core[0], core[0]))):
            for u in ("u", "v") if "ü" in surname + given else ("u",):
                out.append(("of_latin", surname.replace("ü", u), given.replace("ü", u)))
        return out
    name = re.sub(r"\(.*?\)", " ", name)
    comma = "," in name
    parts = [re.sub(r"[^\w'’ -]", " ", p.replace(".", " ")).split() for p in name.split(",")]
    parts = [[t for t in p if t not in TITLES] for p in parts]
    if comma and len(parts) >= 2 and parts[0] and parts[1]:
        orders = [(parts[0][-1], parts[1])]
    else:
        t = [x for p in parts for x in p]
        if len(t) < 2:
            return [("same", x, "") for x in t]
        orders = [(t[-1], t[:-1]), (t[0], t[1:])]
    out = []
    for surname, given in orders:
        if len(surname) < 2:
            continue
        words = [g for g in given if len(g) > 1]
        if words:
            for root in lexicon.roots(words[0]):
                out.append(("full", surname, " ".join([root, *words[1:]])))
                out.append(("of_initial", surname, root[0]))
            out.append(("latin", surname, "".join(words).replace("-", "")))
        elif given:
            out.append(("initial", surname, given[0]))
    return out


def organization_readings(name: str, lexicon: Lexicon) -> list[tuple[str, str, str]]:
    """(kind, a, b) of a folded organisation's name. Kinds: full (a first word, b the rest), short and its whole form."""
    place = re.search(r"[(（](.*?)[)）]", name)
    name = re.sub(r"[(（].*?[)）]", " ", name).strip()
    if _HAN.search(name):
        core = re.sub(r"\s+", "", name)
        stem = ZH_LEGAL.sub("", core)
        legal = core[len(stem) :]
        if place and _HAN.search(place[1]):
            stem = place[1] + stem
        stem = re.sub(r"^(.{2,3})市", r"\1", stem)
        if not stem:
            return []
        out = [("zh", stem, "")]
        if legal not in ("", "公司"):
            out += [("of_short", stem[k:], "") for k in (2, 3)] + [("of_short", stem[:-2], "")]
        else:
            out.append(("short", stem, ""))
        return out
    t = [re.sub(r"[^\w'&-]", "", x.replace(".", "")) for x in name.replace(",", " ").split()]
    t = [x for x in t if x]
    if len(t) > 1 and t[0] == "the":
        t = t[1:]
    while len(t) > 1 and t[-1] in LEGAL:
        t = t[:-1]
    t = [lexicon.word(x) for x in t]
    if not t:
        return []
    out = [("full", t[0], " ".join(t[1:]))]
    if len(t) > 2:
        out.append(("full", t[-1], " ".join(t[:-1])))
        out.append(("of_short", t[0], " ".join(t[1:-1])))
    if len(t) == 2:
        out.append(("short", t[0], t[1]))
    return out


def within_one(a: str, b: str) -> bool:
    """Whether the edit distance (insertion, deletion, substitution, swap of neighbours) is at most one: the band of width one."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    x, y = a[i:], b[i:]
    return x[1:] == y[1:] or x == y[1:] or x[1:] == y or (len(x) > 1 and len(y) > 1 and x[0] == y[1] and x[1] == y[0] and x[2:] == y[2:])


def distance(a: str, b: str, most: int) -> int:
    """Edit distance (insertion, deletion, substitution, swap of neighbours) in a band of that width; ``most`` + 1 if it is more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    if a == b or most == 1:
        return 0 if a == b else 2 - within_one(a, b)
    far = most + 1
    before: list[int] = []
    last = [j if j <= most else far for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        now = [far] * (len(b) + 1)
        if i <= most:
            now[0] = i
        for j in range(max(1, i - most), min(len(b), i + most) + 1):
            v = min(last[j - 1] + (x != b[j - 1]), last[j] + 1, now[j - 1] + 1)
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == b[j - 1]:
                v = min(v, before[j - 2] + 1)
            now[j] = min(v, far)
        if min(now) >= far:
            return far
        before, last = last, now
    return last[-1]


def _layout(length: int, m: int) -> list[tuple[int, int]]:
    return [(length * i // m, length * (i + 1) // m) for i in range(m)]


def segment_keys(text: str, fixed: str, m: int, keep: int) -> list[tuple[bool, str]]:
    """(index side, key): the text's own segments in the index, and where a text one longer would have its segments.

    One edit touches at most two neighbouring segments, so ``keep`` = m - 2 stay intact; behind an insertion
    they stand one place further.
    """
    n, out = len(text), []
    own = _layout(n, m)
    for c in combinations(range(m), keep):
        out.append((True, f"{fixed}\x01{n}\x01{c}\x01" + "\x02".join(text[own[i][0] : own[i][1]] for i in c)))
    longer = _layout(n + 1, m)
    for c in combinations(range(m), keep):
        for moved in range(keep + 1):
            part = [text[longer[i][0] - (k >= moved) : longer[i][1] - (k >= moved)] if longer[i][0] - (k >= moved) >= 0 else "" for k, i in enumerate(c)]
            out.append((False, f"{fixed}\x01{n + 1}\x01{c}\x01" + "\x02".join(part)))
    return list(dict.fromkeys(out))


def shifted_keys(text: str, fixed: str, k: int) -> list[tuple[bool, str]]:
    """(index side, key) for k edits: of k + 1 segments one stays intact. The index has a text's own segments; a text looks
    for the segments of texts that are up to k shorter, at the places to which edits before and behind can move them."""
    n, out = len(text), []
    for i, (lo, hi) in enumerate(_layout(n, k + 1)):
        out.append((True, f"{fixed}\x01{n}\x01{i}\x01{text[lo:hi]}"))
    for size in range(max(k + 1, n - k), n + 1):
        for i, (lo, hi) in enumerate(_layout(size, k + 1)):
            for at in range(max(0, lo - i, lo + n - size - (k - i)), min(n - hi + lo, lo + i, lo + n - size + (k - i)) + 1):
                out.append((False, f"{fixed}\x01{size}\x01{i}\x01{text[at : at + hi - lo]}"))
    return list(dict.fromkeys(out))


def deletion_keys(text: str, fixed: str) -> list[tuple[bool, str]]:
    """Keys of a text that is too short for segments: itself and, from three characters on, itself without one of them.

    Two texts with one edit share one of these.
    """
    own = [text] + [text[:i] + text[i + 1 :] for i in range(len(text)) if len(text) > 2]
    return [(True, f"{fixed}\x01-\x01{x}") for x in dict.fromkeys(own)]


def part_keys(text: str, fixed: str, m: int, keep: int) -> list[tuple[bool, str]]:
    """Segments from ``m`` characters on, deletions up to ``m``: those of ``m`` itself have both, for what is one shorter."""
    return (segment_keys(text, fixed, m, keep) if len(text) >= m else []) + (deletion_keys(text, fixed) if 2 <= len(text) <= m else [])


def reading_keys(kind: str, a: str, b: str) -> list[tuple[bool, str]]:
    """The keys of a reading: (a intact, segments or deletions of b) and (b intact, those of a)."""
    if kind == "zh":
        return part_keys(a, "z", 5, 3)
    return part_keys(a, f"a\x01{b}", 4, 2) + part_keys(b, f"b\x01{a}", 4, 2)


def _numbers(text: str) -> list[str]:
    return [t for t in text.split() if _ROMAN.match(t)]


#: Edits between names of equal descriptions, in all and in a part of less than LONG letters. Of Chinese characters, each of
#: which is a syllable, one may differ.
EDITS, EDITS_SHORT, LONG = 2, 1, 8


def typed_alike(a: str, b: str, a2: str, b2: str, most: int, lexicon: Lexicon) -> bool:
    """Whether two readings differ by at most ``most`` edits that may be typing errors: numbers are equal, and no common
    word of the collection stands for another."""
    if _numbers(a) != _numbers(a2) or _numbers(b) != _numbers(b2):
        return False
    left = most
    for x, y in ((a, a2), (b, b2)):
        n = distance(x, y, min(left, most if min(len(x), len(y)) >= LONG else EDITS_SHORT)) if left or x == y else left + 1
        left -= n
        if left < 0 or (n and min(len(x), len(y)) < LONG and n > EDITS_SHORT):
            return False
        u, v = x.split(), y.split()
        if n and len(u) == len(v) and any(p != q and lexicon.both_words(p, q) for p, q in zip(u, v)):
            return False
    return True


def described(desc: Column) -> Column:
    """The description as a hint: lower case, with place and role joined in one way; empty is null."""
    x = F.regexp_replace(F.lower(F.trim(desc)), r"\s*(,| at | in )\s*", "|")
    return F.when(F.length(x) > 0, x)


def link_variants(entities: DataFrame, model: Model, id_col: str = "id", type_col: str = "entity_type", name_col: str = "name", desc_col: str = "description") -> DataFrame:
    """(entity_type, id, name, description, class): every row of type person or organization with the class of its entity.

    Names that look alike are one name. Null or blank names are a class of their own id; rows without an id are
    left out; repeats of equal rows count once; other types give no rows; other columns are dropped; descriptions
    only forbid links (two that differ) and settle which entity an initial or a short name means.
    """
    kind = F.lower(F.trim(F.col(type_col)))
    rows = entities.select(F.col(id_col).alias("id"), F.col(type_col).alias("entity_type"), F.col(name_col).alias("name"), F.col(desc_col).alias("description")).filter(kind.isin("person", "organization") & F.col("id").isNotNull()).distinct()
    named = canonicalize(rows, "name", model, "_c").withColumn("_c", F.lower("_c"))
    named = common.checkpoint(named.withColumn("node", F.concat_ws("\x03", "entity_type", F.when(F.length("_c") > 0, F.col("_c")).otherwise(F.concat(F.lit("\x04"), F.col("id"))))))
    hint = described(F.col("description"))
    nodes = named.filter("length(_c) > 0").groupBy("node", "entity_type", "_c").agg(F.min(hint).alias("d"), F.max(hint).alias("_d2")).withColumn("d", F.when(F.col("d") == F.col("_d2"), F.col("d"))).drop("_d2")

    nodes = common.checkpoint(nodes)
    sent = entities.sparkSession.sparkContext.broadcast(fit_lexicon(nodes))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon = sent.value
        for df in batches:
            out = []
            for node, t, c, d in df[["node", "entity_type", "_c", "d"]].itertuples(index=False):
                f = person_readings if t.strip().lower() == "person" else organization_readings
                out += [(node, t, d, *r) for r in dict.fromkeys(f(c, lexicon))]
            yield pd.DataFrame(out, columns=["node", "t", "d", "kind", "a", "b"])

    readings = common.checkpoint(nodes.mapInPandas(read, "node string, t string, d string, kind string, a string, b string"))

    # Equal readings: each node is tied to the least node of its reading and description; those without one to the least of all.
    exact = readings.filter("kind in ('full', 'same', 'zh')")
    key = ["t", "kind", "a", "b"]
    least = exact.groupBy(*key).agg(F.min("node").alias("_m"))
    least_d = exact.filter("d is not null").groupBy(*key, "d").agg(F.min("node").alias("v"))
    ties = exact.filter("d is not null").join(least_d, [*key, "d"]).select(F.col("node").alias("u"), "v")
    loose = exact.filter("d is null").join(least, key).select(F.col("node").alias("u"), F.col("_m").alias("v"))
    # ... and the least without a description to the least that has one.
    first = exact.groupBy(*key).agg(F.min(F.when(F.col("d").isNull(), F.col("node"))).alias("u"), F.min(F.when(F.col("d").isNotNull(), F.col("node"))).alias("v"))
    links = ties.unionByName(loose).unionByName(first.filter("u is not null and v is not null").select("u", "v"))

    # Readings with one edit. That the ranges of descriptions meet only keeps down what is verified; what is linked is settled below.
    edited = exact.filter("kind in ('full', 'zh')")
    forms = edited.groupBy(*key).agg(F.min("d").alias("d1"), F.max("d").alias("d2"))
    columns = ["t", "kind", "a", "b", "d1", "d2"]

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        for df in batches:
            out = []
            for t, kind, a, b, d1, d2 in df[columns].itertuples(index=False):
                for side, k in reading_keys(kind, a, b):
                    out.append((xxhash.xxh64_intdigest(f"{t}\x01{kind}\x01{k}") - (1 << 63), side, t, kind, a, b, d1, d2))
            yield pd.DataFrame(out, columns=["key", "side", *columns])

    keys = forms.mapInPandas(index, "key bigint, side boolean, t string, kind string, a string, b string, d1 string, d2 string")
    left = keys.select("key", "side", *(F.col(c).alias("l_" + c) for c in columns))
    right = keys.filter("side").select("key", *(F.col(c).alias("r_" + c) for c in columns))
    agree = F.coalesce((F.col("l_d1") <= F.col("r_d2")) & (F.col("r_d1") <= F.col("l_d2")), F.lit(True))
    alike = (F.col("l_t") == F.col("r_t")) & (F.col("l_kind") == F.col("r_kind"))
    x, y = F.struct("l_a", "l_b"), F.struct("r_a", "r_b")
    near = left.join(right, "key").filter(alike & (x != y) & (~F.col("side") | (x < y)) & agree & (F.abs(F.length("l_a") - F.length("r_a")) <= 1) & (F.abs(F.length("l_b") - F.length("r_b")) <= 1))
    near = near.select("l_t", "l_kind", "l_a", "l_b", "r_a", "r_b").distinct()

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            ok = [(x.l_a == x.r_a or x.l_b == x.r_b) and typed_alike(x.l_a, x.l_b, x.r_a, x.r_b, 1, sent.value) for x in df.itertuples(index=False)]
            yield df[ok].set_axis([*key, "a2", "b2"], axis=1)

    pairs = common.checkpoint(near.mapInPandas(verify, "t string, kind string, a string, b string, a2 string, b2 string"))
    # Nodes of equal descriptions are tied. A reading without any description is tied to one node of the other, as equal readings are.
    each = edited.filter("d is not null").groupBy(*key, "d").agg(F.min("node").alias("u"))
    other = each.select("t", "kind", F.col("a").alias("a2"), F.col("b").alias("b2"), "d", F.col("u").alias("v"))
    fuzzy = pairs.join(each, key).join(other, ["t", "kind", "a2", "b2", "d"]).select("u", "v")
    ends = edited.groupBy(*key).agg(F.max(F.col("d").isNotNull()).alias("_told"), F.coalesce(F.min(F.when(F.col("d").isNull(), F.col("node"))), F.min("node")).alias("u"))
    other = ends.select("t", "kind", F.col("a").alias("a2"), F.col("b").alias("b2"), F.col("_told").alias("_told2"), F.col("u").alias("v"))
    untold = pairs.join(ends, key).join(other, ["t", "kind", "a2", "b2"]).filter("not (_told and _told2)").select("u", "v")
    fuzzy = fuzzy.unionByName(untold).filter("u != v").distinct()
    # Two edits between readings of equal descriptions: segments of the distinctive part, looked up among those.
    told = common.checkpoint(edited.filter("d is not null and kind = 'full'").groupBy(*key, "d").agg(F.min("node").alias("node")))
    width = ["node", "kind", "a", "b"]

    def segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        for df in batches:
            out = []
            for t, kind, a, b, d, node in df[["t", "kind", "a", "b", "d", "node"]].itertuples(index=False):
                if len(a) >= LONG - EDITS:
                    out += [(xxhash.xxh64_intdigest(k) - (1 << 63), side, node, kind, a, b) for side, k in shifted_keys(a, f"{t}\x01{kind}\x01{d}", EDITS)]
            yield pd.DataFrame(out, columns=["key", "side", *width])

    cut = told.mapInPandas(segments, "key bigint, side boolean, node string, kind string, a string, b string")
    seek = cut.select("key", "side", *(F.col(c).alias("l_" + c) for c in width))
    held = cut.filter("side").select("key", *(F.col(c).alias("r_" + c) for c in width))
    apart = F.struct("l_a", "l_b") != F.struct("r_a", "r_b")
    two_off = seek.filter("not side").drop("side").join(held, "key").filter((F.col("l_kind") == F.col("r_kind")) & apart & (F.abs(F.length("l_b") - F.length("r_b")) <= EDITS)).drop("key").distinct()

    def verify_two(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            ok = [typed_alike(x.l_a, x.l_b, x.r_a, x.r_b, EDITS, sent.value) for x in df.itertuples(index=False)]
            yield df.loc[ok, ["l_node", "r_node"]].set_axis(["u", "v"], axis=1)

    fuzzy = fuzzy.unionByName(two_off.mapInPandas(verify_two, "u string, v string").filter("u != v"))
    one = graph.components(links.unionByName(fuzzy))

    # Initials, short names and Latin spellings: to the only class of a whole form that they can mean.
    member = readings.join(one, readings["node"] == one["node"], "left").select(readings["*"], F.coalesce("component", readings["node"]).alias("component"))
    later = []
    for short, whole in (("initial", "of_initial"), ("short", "of_short"), ("latin", "of_latin")):
        s = member.filter(F.col("kind") == short).select("t", "a", "b", "node", "d", F.col("component").alias("_own"))
        w = member.filter(F.col("kind") == whole).groupBy("t", "a", "b", "component").agg(F.min("d").alias("w1"), F.max("d").alias("w2"))
        found = s.join(w, ["t", "a", "b"]).filter(F.coalesce((F.col("d") >= F.col("w1")) & (F.col("d") <= F.col("w2")), F.lit(True)))
        same = F.coalesce((F.col("d") == F.col("w1")) | (F.col("d") == F.col("w2")), F.lit(False))
        choice = found.groupBy("node").agg(
            F.countDistinct("component").alias("n"), F.min("component").alias("c"), F.countDistinct(F.when(same, F.col("component"))).alias("n_same"), F.min(F.when(same, F.col("component"))).alias("c_same")
        )
        later.append(choice.select(F.col("node").alias("u"), F.when(F.col("n_same") == 1, F.col("c_same")).when(F.col("n") == 1, F.col("c")).alias("v")))
        # Equal initial or short forms with equal descriptions are one entity, too.
        least_s = s.filter("d is not null").groupBy("t", "a", "b", "d").agg(F.min("node").alias("v"))
        later.append(s.filter("d is not null").join(least_s, ["t", "a", "b", "d"]).select(F.col("node").alias("u"), "v"))
    edges = one.select(F.col("node").alias("u"), F.col("component").alias("v"))
    for x in later:
        edges = edges.unionByName(x)
    two = graph.components(edges)
    return named.join(two, "node", "left").select("entity_type", "id", "name", "description", F.coalesce("component", "node").alias("class"))


def p6_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each person and organisation of kb_entities with its class."""
    return link_variants(common.table(spark, sf_dir, "kb_entities"), _model(spark, sf_dir))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p6_found: every two ids of a class."""
    x = common.checkpoint(p6_classes(spark, sf_dir).select("class", "id").distinct())
    several = x.groupBy("class").agg(F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    few = x.join(several, "class")
    pairs = few.select("class", F.col("id").alias("entity_a")).join(few.select("class", F.col("id").alias("entity_b")), "class")
    return pairs.filter("entity_a < entity_b").select("entity_a", "entity_b").distinct()


QUERIES = {"p6_found": p6_found, "p6_classes": p6_classes}
SQL: dict[str, str] = {}
