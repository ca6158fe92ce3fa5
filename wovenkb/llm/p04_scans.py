"""Noise in text from scanned pages.

Method: headers and footers are found by fuzzy repetition of lines at page edges, page numbers as sequences of
number lines and removed, then lines are joined with dehyphenation by the vocabulary of the corpus. The same
vocabulary puts misread characters right: a rare word is corrected if a known confusion of characters makes
a word of it that is far more frequent.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

KINDS = ("hyphen", "misread", "header", "page_number")

# What scanners read for what was printed, in Latin words, in Chinese text and in numbers.
GROUPS = (("rn", "m"), ("m", "rn"), ("cl", "d"), ("d", "cl"), ("vv", "w"), ("w", "vv"), ("ii", "u"), ("u", "ii"), ("ri", "n"), ("n", "ri"), ("li", "h"), ("h", "li"), ("iii", "m"), ("ni", "m"), ("in", "m"), ("lc", "k"), ("ll", "U"))
LETTERS = ("ce", "ft", "il1I|j", "o0O", "s5S", "bh68B", "gq9", "vy", "z2Z", "nu")
ZH_CONFUSIONS = {a: b for a, b in ("曰日", "朋期", "己已", "太大", "末未", "未末", "入人", "人入", "士土", "千干", "干千", "甲申", "夭天", "侍待", "牛午", "目日", "夫失", "问间", "间问", "困因", "囚因", "末木", "王主", "贝见", "见贝", "刀力", "厂广", "广厂", "儿几", "几儿", "白自", "自白", "巳已", "末来", "车东", "令今", "今令", "折拆", "拆折", "晴睛", "候侯", "侯候", "圆园", "园圆", "历厉", "治冶", "冶治", "拔拨", "栽裁", "复夏", "持待", "未来", "士上", "士工", "土士", "大太", "日曰", "期朋", "已己")}
DIGITS = {"O": "0", "o": "0", "l": "1", "I": "1", "i": "1", "|": "1", "S": "5", "s": "5", "B": "8", "Z": "2", "z": "2"}

#: Signs at a line end that divide a word.
HYPHENS = "-‐‑\u00ad¬⁃"
#: A word is common with this share of all words or characters, so that the vocabulary that is sent to all tasks has at
#: most 1/COMMON entries (the exact counts of rarer words are joined to the documents that ask for them); and a
#: correction must occur more than LEAST times and be more than so many times as frequent as what was read.
COMMON, LEAST, RATIO = 1e-6, 4, 8
#: A corrected Chinese context must have this share of all words and contexts, which keeps names out.
COMMON_ZH = 1e-4
#: What a capitalised word is corrected to must have this share, which keeps names out; and two words that both have it
#: and that stand nowhere undivided are a compound.
COMMON_LATIN = 1e-4
#: Words whose answers a task keeps (a bounded memory, not a bound on the words).
CACHE = 300_000

#: Characters of the longest form of a page number with single blanks.
FORM_CHARS = 32
_NO_LETTERS = re.compile(r"[\d\W]*")
#: Letters of a line from which on one may differ.
FUZZY = 8
_N = r"(\d{1,6}|[ivxl]{1,7}|[\doOlISB]{2,4})"
_FORMS = tuple(
    re.compile(p.replace("N", _N, 1).replace("N", _N.replace("(", "(?:", 1)), re.I if k == 2 else 0)
    for k, p in enumerate((
        r"[-–—·•]\s*N\s*[-–—·•]", r"[\[(]N[\])]", r"(?:page|pg\.?|p\.)\s*N(?:\s+of\s+N)?", r"N\s*(?:[|/]|of)\s*N", r"第\s*N\s*页(?:\s*[,，/]?\s*共\s*N\s*页)?", r"N"
    ))
)
_INSIDE = re.compile(r"(?:\s{2,}|\s[|·—/]\s?|\t)(?:page |p\. |第 ?|- ?)?" + _N + r"(?: ?页| ?-)?$|^(?:page |p\. |第 ?)?" + _N + r"(?: ?页)?(?:\s{2,}|\s[|·—/]\s|\t)", re.I)
#: What the forms of page numbers begin and end with, besides digits (any case, as some are compared without case).
_FORM_STARTS, _FORM_ENDS = frozenset("-–—·•[(pP第ivxloOISB"), frozenset("-–—·•])页ivxlIVXLoOsSbBıİſ")
#: What a line ends with that ends a sentence.
_ENDS = frozenset(".!?。！？：:;；”\")）")
_CODE_TAIL = re.compile(r"[A-Z]{2}[" + HYPHENS + r"]\s*$")


def _value(text: str) -> int | None:
    """The number that a page number shows, roman or decimal; misread digits are read as digits."""
    low = text.lower()
    if re.fullmatch("[ivxl]+", low) and text not in ("I", "l", "ll", "II"):
        roman, total, last = {"i": 1, "v": 5, "x": 10, "l": 50}, 0, 0
        for ch in reversed(low):
            v = roman[ch]
            total += v if v >= last else -v
            last = max(last, v)
        return total
    text = "".join(DIGITS.get(ch, ch) for ch in text)
    return int(text) if text.isdigit() else None


# Patterns that search whole texts begin with a set of characters, as re then skips to these; a look behind comes after it.
#: What every form of _INSIDE needs (two blanks, or a sign that parts); lines without it aren't searched.
_PARTED = re.compile(r"[\s|·—/](?:(?<=[\t|·—/])|\s)")
_ALIKE = tuple({"1": "i", "l": "i", "|": "i", "0": "o", "5": "s", "8": "b", "6": "b", "c": "e", "f": "t", "q": "g", "9": "g", "曰": "日", "己": "已", "朋": "期", "太": "大"}.items())
_NUMERAL = re.compile(r"\d[\doilsb|]*")


def _without_number(line: str) -> str:
    line = line.strip()
    return _INSIDE.sub("", line) if _PARTED.search(line) else line


def _one_number(x: str) -> str:
    """A lower-case text with ``#`` for each run of digits and what is read for them that holds a digit."""
    out, done = [], 0
    for m in _NUMERAL.finditer(x):
        out += x[done : m.start()].rstrip("oilsb|"), "#"
        done = m.end()
    return "".join((*out, x[done:])) if out else x


_GAPS = re.compile(r"[^\S\n]+")
_ODD_GAP = re.compile(r"[^\S\n ]")


def plain_lines(lines: list[str]) -> list[str]:
    """Lines in small letters without the page numbers inside, with single blanks and all numbers as one. All together."""
    x = "\n".join([line.strip() for line in lines])
    if _PARTED.search(x):
        x = "\n".join(map(_without_number, lines))
    x = x.lower()
    if "  " in x or _ODD_GAP.search(x):
        x = _GAPS.sub(" ", x)
    return _one_number(x).split("\n")


def line_keys(plain: list[str]) -> list[str]:
    """Plain lines for fuzzy comparison: letters that scanners confuse are one. All lines together."""
    x = "\n".join(plain)
    for a, b in (("rn", "m"), ("cl", "d"), ("vv", "w"), ("ii", "u"), ("ri", "n"), ("li", "h"), *_ALIKE):
        x = x.replace(a, b)
    return x.split("\n")


def line_key(line: str) -> str:
    """The key of one line."""
    return line_keys(plain_lines([line.replace("\n", " ")]))[0]


_HAN = re.compile("[㐀-鿿]")


def templates_of(line: str) -> list[str]:
    """What header lines of many documents share: the last words without names, or the first word and its number."""
    return _templates(plain_lines([line])[0].strip())


def _templates(x: str) -> list[str]:
    if not x.isascii() and _HAN.search(x):
        return [x[-4:]] if len(x) > 6 else []
    if "#:" in x and (m := re.match(r"[a-z]+ #:", x)):
        return [m[0]]
    words = x.rsplit(" ", 3)
    return [" ".join(words[1:])] if len(words) > 3 else []


class Page:
    """The lines of a document with what is page furniture among them."""

    def __init__(self, text: str, templates: frozenset[str] = frozenset()) -> None:
        self.lines = text.replace("\r\n", "\n").replace("\r", "\n").replace("\f", "\n\f\n").split("\n")
        self.bare = [line.strip() for line in self.lines]
        self.at = [i for i, line in enumerate(self.bare) if line]
        self.place = {i: j for j, i in enumerate(self.at)}
        self.numbers: dict[int, int] = {}
        self.headers: dict[int, int | None] = {}
        self.repeated: set[int] = set()
        if len(self.at) > 1:
            self.beside = self._beside_feeds()
            marks = self._marks()
            self._headers(templates, {i for i, (form, _) in marks.items() if form < 5})
            self._numbers(marks)

    def _beside_feeds(self) -> set[int]:
        """The lines that only blank lines part from a form feed or from the end of the text."""
        feeds = [-1, *(i for i, line in enumerate(self.lines) if line == "\f"), len(self.lines)]
        out = set()
        for feed in feeds:
            for step in (-1, 1):
                j = feed + step
                while 0 <= j < len(self.lines) and not self.lines[j].strip(" \t"):
                    j += step
                if 0 <= j < len(self.lines) and self.lines[j] != "\f":
                    out.add(j)
        return out

    def _marks(self) -> dict[int, tuple[int, int]]:
        found = {}
        for i in self.at:
            line = self.bare[i]
            if not (line[0] in _FORM_STARTS or line[0].isdecimal()) or not (line[-1] in _FORM_ENDS or line[-1].isdecimal()):
                continue
            if len(line) > FORM_CHARS and _PARTED.search(line):
                line = " ".join(line.split())
            if len(line) <= FORM_CHARS:  # no form has more characters
                for form, p in enumerate(_FORMS):
                    if (m := p.fullmatch(line)) and (v := _value(m[1])) is not None:
                        found[i] = (form, v)
                        break
        return found

    def _numbers(self, marks: dict[int, tuple[int, int]]) -> None:
        inside = {i: v for i, v in self.headers.items() if v is not None}
        seen = sorted([(i, v, form) for i, (form, v) in marks.items()] + [(i, v, 0) for i, v in inside.items()])
        for k, (i, v, form) in enumerate(seen):
            if form < 5:
                self.numbers[i] = v
                continue
            before = self.lines[self.at[self.place[i] - 1]] if self.place[i] else ""
            if _CODE_TAIL.search(before):
                continue
            near = [seen[j] for j in (k - 1, k + 1) if 0 <= j < len(seen)]
            run = any(abs(x[1] - v) <= 2 and (x[1] - v) * (x[0] - i) > 0 for x in near)
            beside = any(self.at[j] in self.headers for j in (self.place[i] - 1, self.place[i] + 1) if 0 <= j < len(self.at))
            if run or beside or (i in self.beside and self.place[i] > 0):
                self.numbers[i] = v
        self.numbers.update(inside)

    def _edge(self, i: int, close: set[int]) -> bool:
        """Whether a line stands at a page edge (beside a form feed, the text's end or a page number) or breaks a sentence."""
        return i in close or (self.place[i] > 0 and self.bare[self.at[self.place[i] - 1]][-1] not in _ENDS)

    def _merge(self, keys: dict[str, list[int]], close: set[int]) -> None:
        """Put lines together that stand at page edges and whose keys differ by one letter (left out, added or changed)."""
        able = [k for k, own in keys.items() if len(k) >= FUZZY and not close.isdisjoint(own)]
        if len(able) < 2:
            return
        near: dict[str, str] = {}
        for key in sorted(able, key=lambda k: (-len(keys[k]), k)):
            own = {key, *(key[:i] + key[i + 1 :] for i in range(len(key)))}
            known = own.intersection(near)
            if not known:
                near.update(dict.fromkeys(own, key))
            else:
                first = near[min(known)]
                keys[first] = sorted([*keys[first], *keys.pop(key)])

    def _headers(self, templates: frozenset[str], marks: set[int]) -> None:
        keys: dict[str, list[int]] = {}
        able = []
        for i in self.at:
            line = self.bare[i]
            if len(line) > 2 and line[0] not in "#|*+->" and line[-1] not in ".。!?！？,，;；" and i not in marks and line.count(",") < 3 and not _NO_LETTERS.fullmatch(line):
                able.append(i)
        plain = dict(zip(able, plain_lines([self.bare[i] for i in able])))
        key_of = dict(zip(able, line_keys([*plain.values()])))
        for i, key in key_of.items():
            keys.setdefault(key, []).append(i)
        close = self.beside | {self.at[j] for i in marks for j in (self.place[i] - 1, self.place[i] + 1) if 0 <= j < len(self.at)}
        if marks or "\f" in self.lines:
            self._merge(keys, close)
        for own in keys.values():
            if len(own) >= 2:
                place = [self.place[i] for i in own]
                around = [[i for j in place if 0 <= j + d < len(self.at) and (i := self.at[j + d]) not in marks] for d in (-1, 1)]
                differ = all(len({key_of[i] if i in key_of else line_key(self.lines[i]) for i in a}) >= len(a) for a in around)
                if differ and 2 * sum(self._edge(i, close) for i in own) > len(own):
                    self.repeated.update(own)
                    continue
            if templates and not templates.isdisjoint(_templates(plain[own[0]].strip())):
                self.repeated.update(i for i in own if self._edge(i, close))
        for i in self.repeated:
            m = _INSIDE.search(self.bare[i])
            self.headers[i] = _value(m[1] or m[2]) if m else None


_CLASS = str.maketrans({ch: group[0] for group in LETTERS for ch in group})
_LOWER = re.compile(r"[a-z](?<![\w’'-][a-z])[a-z]+(?:-[a-z]+)*(?![\w’'-])")
_MIXED = re.compile(r"([A-Za-z0-9|](?<![\w’'" + HYPHENS + r"][A-Za-z0-9|])[A-Za-z0-9|]*(?![\w’'-]))")
_NUMBER_LIKE = re.compile(r"(?<![A-Za-z0-9-])(?=[OolISBZ,.]*\d)(?=[\d,.]*[OolISBZ])[\dOolISBZ]+(?:[.,][\dOolISBZ]+)*(?![A-Za-z0-9-])")
# What a match of _NUMBER_LIKE can't do without; texts that lack it aren't searched further.
_DIGIT_LETTER = re.compile(r"\d(?:[.,]?[OolISBZ]|(?<=[OolISBZ]\d)|(?<=[OolISBZ][.,]\d))")
_LONE = re.compile(r"[OolISB](?<![A-Za-z0-9-][OolISB])(?=\s(?:January|February|March|April|May|June|July|August|September|October|November|December)\b|[年月日曰])")
_ZH = re.compile("[" + "".join(sorted(set(ZH_CONFUSIONS))) + "]")
#: A sign at a line end that divides a word, and the rest of the word.
_SPLIT = re.compile("[" + HYPHENS + r"](?<=[A-Za-z0-9|].)[ \t]*\n[ \t]*([A-Za-z0-9|]+)")
_TAIL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789|"


def divisions(body: str) -> list[tuple[int, int, str, str]]:
    """(start, end, first part, second part) of the words that are divided at line ends; of three parts the first two."""
    out, done = [], 0
    for m in _SPLIT.finditer(body):
        at = m.start()
        if out and at == done:
            continue
        line = body[max(done, body.rfind("\n", 0, at)) : at]
        first = line[len(line.rstrip(_TAIL)) :]
        out.append((at - len(first), m.end(), first, m[1]))
        done = m.end()
    return out


def replaced(body: str, places: list[tuple[int, int]], texts: list[str]) -> str:
    """A text with others in its places (start, end), which are in order."""
    out, done = [], 0
    for (start, end), text in zip(places, texts):
        out += body[done:start], text
        done = end
    return "".join((*out, body[done:]))


_IN_CONTEXT = re.compile("(?s)" + _ZH.pattern + "(?<=(..))(?=(.))")


def contexts(flat: str) -> Counter:
    """How often each Chinese character that scanners confuse stands between which neighbours, in a text without line
    ends; digits and what is read for them count as one. Those beside no Chinese character don't count."""
    out: Counter = Counter()
    for (c, after), n in Counter(_IN_CONTEXT.findall(f" {flat} ")).items():
        if "㐀" <= c[0] <= "鿿" or "㐀" <= after <= "鿿":
            out[same(c + after)] += n
    return out


def same(c: str) -> str:
    """A context with the digits, and what is read for them, as one."""
    return _AS_DIGIT.get(c[0], c[0]) + c[1] + _AS_DIGIT.get(c[2], c[2])


_AS_DIGIT = dict.fromkeys("0123456789OolISBZ", "9")


# Strokes of letters: what scanners confuse has equal sums, so two words with different sums can't be confused.
_STROKES = {"i": "i", "l": "i", "1": "i", "|": "i", "I": "i", "j": "j", "r": "i", "n": "ii", "u": "ii", "U": "ii", "h": "ii", "b": "ii", "6": "ii", "8": "ii", "B": "ii", "m": "iii", "c": "c", "e": "c", "d": "ci", "k": "ci", "v": "v", "y": "v", "w": "vv", "o": "o", "O": "o", "0": "o", "s": "s", "S": "s", "5": "s", "g": "g", "q": "g", "9": "g", "z": "z", "Z": "z", "2": "z", "f": "t", "t": "t", "a": "a", "p": "p", "x": "x"}
_WEIGHT = {ch: sum(1 << 12 * "icvosgztajpx".index(x) for x in strokes) for ch, strokes in _STROKES.items()}


def strokes(word: str) -> int:
    """The sum of a word's strokes, of each kind."""
    return sum(_WEIGHT.get(ch, 0) for ch in word)


def add_words(words: Counter, text: str) -> None:
    """Count the lower-case words and Chinese contexts of a text, for the vocabulary."""
    words.update(_LOWER.findall(text))
    if _ZH.search(text):
        words.update(contexts(text.replace("\n", "")))


def confusions(word: str) -> list[tuple[int, str]]:
    """(how many groups of letters were exchanged, class of letters) of all that a word may have been read from."""
    places = [(m.start(), a, b) for a, b in GROUPS for m in re.finditer(a, word)]
    out = []
    for n in (0, 1, 2):  # confusions of single letters, with up to two of groups of letters
        for chosen in combinations(places, n):
            chosen = sorted(chosen)
            if n == 2 and chosen[0][0] + len(chosen[0][1]) > chosen[1][0]:
                continue
            x = word
            for at, a, b in reversed(chosen):
                x = x[:at] + b + x[at + len(a) :]
            out.append((n, x.translate(_CLASS)))
    return out


class Vocabulary:
    """Counts of the common words and contexts of the corpus, and the templates of its header lines.

    ``rare`` are the counts of words that aren't common, as far as the text in work asks for them (``asked``).
    """

    def __init__(self, counts: dict[str, int], total: int, templates: frozenset[str]) -> None:
        self.counts, self.total, self.templates = counts, total, templates
        self.rare_may_be_right = COMMON * total > LEAST + 1  # whether a word that isn't common can be a correction
        self.known: dict[str, str | None] = {}
        self.longest = max((len(w) for w in counts if w.isascii()), default=0)
        self.alike = self._by_class(counts)
        self.strokes = Counter(strokes(w) for w, n in counts.items() if w.isascii() and n >= LEAST)
        self.asks: dict[str, bool] = {}
        self.needs: dict[str, tuple[str, ...]] = {}
        self.needless: set[str] = set()
        self.fine: set[str] = set()
        self.wants: dict[str, list[tuple[str, int]]] = {}
        self.rare: dict[str, int] = {}
        self.rare_alike: dict[str, list[str]] = {}

    @staticmethod
    def _by_class(counts: dict[str, int]) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for w, n in counts.items():
            if w.isascii() and n >= LEAST:
                out.setdefault(w.translate(_CLASS), []).append(w)
        return out

    def add_rare(self, rare: dict[str, int]) -> None:
        """Take these counts of rare words for the next text, instead of those of the text before."""
        self.rare, self.rare_alike = rare, self._by_class(rare)

    def count(self, word: str) -> int:
        n = self.counts.get(word)
        return self.rare.get(word, 0) if n is None else n

    def share(self, part: float) -> float:
        """The count that makes this part of all words."""
        return max(LEAST, part * self.total)

    def possible(self, word: str) -> bool:
        """Whether the exact count of a rare word can matter: a common word, or some rare one, may be what it was read from."""
        if word not in self.asks:
            if len(self.asks) > CACHE:
                self.asks.clear()
            self.asks[word] = self.strokes.get(strokes(word), 0) > (self.counts.get(word, 0) >= LEAST and word.isascii())
        return self.asks[word]

    def needed(self, words: set[str]) -> set[str]:
        """The words that aren't common whose counts the repair of these, as they stand in a text, can ask for."""
        out = set()
        for w in words.difference(self.counts, self.needless):
            found = self.needs.get(w)
            if found is None:
                if len(self.needs) + len(self.needless) > CACHE:
                    self.needs.clear()
                    self.needless.clear()
                found = tuple(self._needed(w))
                if not found:
                    self.needless.add(w)
                    continue
                self.needs[w] = found
            out.update(found)
        return out

    def _needed(self, w: str) -> Iterator[str]:
        upper = w[0].isupper()  # what a capitalised word is corrected to is always a common one
        for x in ((w.lower(), "l" + w[1:]) if w[0] == "I" else (w.lower() if upper else w,)) if len(w) > 2 else ():
            if x not in self.counts and ((self.rare_may_be_right and not upper) or self.possible(x)):
                yield x

    def misread(self, words: set[str]) -> set[str]:
        """Those words, as they stand in a text, wherever that is, that can be corrected."""
        out = set()
        for w in words.difference(self.fine):
            if self._may_be_misread(w):
                out.add(w)
                continue
            if len(self.fine) > CACHE:
                self.fine.clear()
            self.fine.add(w)
        return out

    def _may_be_misread(self, w: str) -> bool:
        if len(w) < 3 or w.isdigit() or not any("a" <= ch <= "z" for ch in w):
            return False
        if w[0].islower() or w[0] in "1|056":
            return self.corrected(w) is not None
        return w[1:].islower() and self.corrected(w.lower() if w[0] != "I" else "l" + w[1:]) is not None

    def better(self, have: str) -> list[tuple[str, int]]:
        """(character, count) of the common contexts that a context may have been read from."""
        if have not in self.wants:
            found = [(ch, self.count(have[0] + ch + have[2])) for ch in ZH_ALL.get(have[1], ())]
            self.wants[have] = [x for x in found if x[1] >= self.share(COMMON_ZH)]
        return self.wants[have]

    def corrected(self, word: str) -> str | None:
        """The word that a rare one was read from, if there is one."""
        if word not in self.known:
            if len(self.known) > CACHE:
                self.known.clear()
            self.known[word] = self._corrected(word)
        return self.known[word]

    def _corrected(self, word: str) -> str | None:
        if not self.rare_alike and not self.possible(word):
            return None
        longest = max((len(w) for w in self.rare), default=0)
        if len(word) > max(self.longest, longest) + 4:  # no word can come of it
            return None
        best, top, level = None, max(LEAST, self.count(word) * RATIO), 0
        for n, x in confusions(word):
            if n > level and best:
                break
            level = n
            for w in (*self.alike.get(x, ()), *self.rare_alike.get(x, ())):
                k = self.count(w)
                if w != word and (k > top or (k == top and best and w < best)):
                    best, top = w, k
        return best

    def is_word(self, word: str) -> int:
        """How often a word occurs, as read or corrected."""
        n = self.count(word)
        return n if n else self.count(self.corrected(word) or "")


def _number(m: re.Match) -> str:
    return "".join(DIGITS.get(ch, ch) for ch in m[0])


def joins(a: str, b: str, v: Vocabulary) -> bool:
    """Whether a word divided at a line end is one undivided word and not a compound that always has a hyphen."""
    if not b[:1].islower() or not (a[-1:].islower() or a[-1:] in "10|I5") or re.fullmatch(r"\d+", a):
        return False
    a, b = a.lower(), b.lower()
    one, two = v.is_word(a + b), v.count(f"{a}-{b}")
    if one or two:
        return one > two
    return not min(v.count(a), v.count(b)) > v.share(COMMON_LATIN)


def repair(text: str | None, v: Vocabulary) -> tuple[list[str], str | None]:
    """The kinds of noise in a text and its repaired form: continuous paragraphs, blank lines between them."""
    if not text:
        return [], text
    plain, parts = shield(text)
    kinds, out = repair_words(*without_furniture(plain, v), v, parts is None)
    return kinds, unshield(out, parts)


def without_furniture(text: str, v: Vocabulary) -> tuple[set[str], str]:
    """The kinds of page furniture in a text and its lines without them."""
    page = Page(text, v.templates)
    kinds = set()
    if page.headers:
        kinds.add("header")
    if page.numbers:
        kinds.add("page_number")
    gone = set(page.numbers) | set(page.headers)
    lines: list[str] = []
    cut = False
    for i, line in enumerate(page.lines):
        if i in gone or line == "\f":
            cut = True
            continue
        if not page.bare[i]:
            if not cut and lines and lines[-1]:
                lines.append("")
            continue
        if cut and lines:
            while lines and not lines[-1]:
                lines.pop()
            if lines and lines[-1][-1] in _ENDS:
                lines.append("")
        cut = False
        lines.append(line.rstrip())
    return kinds, "\n".join(lines)


def asked(body: str, v: Vocabulary) -> list[str]:
    """The words and contexts that aren't common whose counts the repair of a body can ask for."""
    out = set()
    if parts := divisions(body):
        for _, _, a, b in parts:
            out.update((f"{a}{b}".lower(), f"{a}-{b}".lower()))
        body = replaced(body, [p[:2] for p in parts], [a + b for _, _, a, b in parts])
    out |= v.needed(set(_MIXED.findall(body)))
    if v.share(COMMON_ZH) <= RATIO * LEAST:  # else a common context is always more than RATIO times one that isn't
        out.update(c for c in contexts(body.replace("\n", "")) if v.better(c))
    return [w for w in out if w not in v.counts and not w.isdigit() and not w.isupper()]


def repair_words(kinds: set[str], body: str, v: Vocabulary, join: bool = True) -> tuple[list[str], str]:
    """The kinds of noise, those given included, and the repaired form of a body without page furniture; ``join``: the
    lines of a paragraph become one (in texts with markup lines have a meaning and stay)."""

    if parts := divisions(body):
        whole = [joins(a, b, v) for _, _, a, b in parts]
        if any(whole):
            kinds.add("hyphen")
        body = replaced(body, [p[:2] for p in parts], [a + ("" if one else "-") + b for (_, _, a, b), one in zip(parts, whole)])

    def number(m: re.Match) -> str:
        if _CODE_TAIL.search(body[max(0, m.start() - 6) : m.start()]):
            return m[0]
        kinds.add("misread")
        return _number(m)

    if _DIGIT_LETTER.search(body):
        body = _NUMBER_LIKE.sub(number, body)
    body = _LONE.sub(number, body)

    def word(k: int) -> str:
        w = low = pieces[k]
        if not w[0].islower() and w[0] not in "1|056":
            before = pieces[k - 1].rstrip(" ")[-1:] or (pieces[k - 2][-1] if k > 1 else "")
            if before not in ("", "\n", ".", "。") or not w[1:].islower():
                return w
            low = w.lower() if w[0] != "I" else "l" + w[1:]
        fixed = v.corrected(low)
        if fixed is None or (low != w and (fixed == w.lower() or v.count(fixed) < v.share(COMMON_LATIN) or v.count(fixed) <= RATIO * v.count(w.lower()))):
            return w
        kinds.add("misread")
        return fixed if low == w else fixed.capitalize()

    pieces = _MIXED.split(body)  # every second one is a word
    if wrong := v.misread(set(pieces[1::2])):
        body = "".join([word(k) if k % 2 and x in wrong else x for k, x in enumerate(pieces)])
    if _ZH.search(body):
        flat = body.replace("\n", "")
        told = {c for c in contexts(flat) if v.better(c)}
        fixes = {}
        if told:
            flat_at = [i for i, ch in enumerate(body) if ch != "\n"]
            for m in _IN_CONTEXT.finditer(f" {flat} "):
                c = same(m[1] + m[2])
                for ch, n in v.better(c) if c in told else ():
                    if n > RATIO * v.count(c):
                        fixes[flat_at[m.start() - 1]] = ch
        if fixes:
            kinds.add("misread")
            body = "".join(fixes.get(i, ch) for i, ch in enumerate(body))
    if not join:
        return [k for k in KINDS if k in kinds], body
    paragraphs = []
    for p in re.split(r"\n\s*\n", body):
        parts = [x for x in map(str.strip, p.split("\n")) if x]
        out = " ".join(parts) if p.isascii() else ""
        for x in parts if not out else ():
            both = out and ("㐀" <= x[0] or "㐀" <= out[-1]) and not (out[-1].isascii() and x[0].isascii() and out[-1].isalpha() and x[0].isalpha() and " " in out)
            out = x if not out else out + ("" if both else " ") + x
        if out:
            paragraphs.append(out)
    return [k for k in KINDS if k in kinds], "\n\n".join(paragraphs)


ZH_ALL: dict[str, list[str]] = {}
for _a, _b in (*ZH_CONFUSIONS.items(),):
    ZH_ALL.setdefault(_a, []).append(_b)


_MARKED = re.compile(r"\\(?:begin|end|section|item|textbf)\b|</?(?:p|li|td|tr|ul|ol|h\d|pre|table|div)\b|^```|^~~~|^\{\||^#{1,6} |^={2,}|\*\*|\[\[|^#[A-Z_]+#|\|---", re.M | re.I)
#: What _MARKED can't do without.
_MARKS = ("\\", "<", "```", "~~~", "{|", "#", "==", "**", "[[", "|---")
#: In texts with markup: code, formulas and tables, lines that are built of marks, and marks inside lines.
_SHIELDED = re.compile(
    r"^(?P<f>```|~~~).*?(?:^(?P=f)[^\n]*$|\Z)|<(?P<t>pre|code|script|style)\b.*?</(?P=t)\s*>|\\begin\{(?P<e>verbatim|lstlisting|minted|equation|align|tabular)(?P<s>[*x]?)\}.*?\\end\{(?P=e)(?P=s)\}"
    r"|^\{\|.*?(?:^\|\}|\Z)|\$\$.+?\$\$|\\\[.+?\\\]|^(?:[ \t]+|[#|!<=*+>:{}\\-]|\d+[.)]\s)[^\n]*$"
    r"|`[^`\n]+`|\$[^$\n]+\$|\\[a-zA-Z]+\*?(?:\[[^\]\n]*\])?|<[^<>\n]+>|\[\[[^\]\n]*\]\]|\{\{[^}\n]*\}\}|\]\([^)\n]*\)|&#?\w+;|https?://\S+",
    re.M | re.S | re.I,
)
_SHIELD = re.compile("\ue000(\\d+)\ue001")


def shield(text: str) -> tuple[str, list[str] | None]:
    """A text with what is markup, code or formula in it replaced by signs, and these parts; plain texts have None."""
    if not any(x in text for x in _MARKS) or not _MARKED.search(text):
        return text, None
    parts: list[str] = []

    def put(m: re.Match) -> str:
        parts.append(m[0])
        return f"\ue000{len(parts) - 1}\ue001"

    return _SHIELDED.sub(put, text.replace("\r\n", "\n").replace("\r", "\n").replace("\ue000", "")), parts


def unshield(text: str, parts: list[str] | None) -> str:
    return _SHIELD.sub(lambda m: parts[int(m[1])], text) if parts else text


def count_words(docs: DataFrame, content_col: str = "content") -> DataFrame:
    """(kind, word, n) over the whole corpus: w for words and contexts, h for templates of headers, n for the total."""
    rows = docs.select(F.col(content_col).cast("string").alias("_text")).filter("_text is not null")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words: Counter = Counter()
        heads: Counter = Counter()
        for df in batches:
            for t in df["_text"]:
                add_words(words, t)
                if "\n" in t or "\f" in t:
                    page = Page(shield(t)[0])
                    heads.update({k for i in page.repeated for k in templates_of(page.lines[i])})
        yield pd.DataFrame([("w", w, n) for w, n in words.items()] + [("h", w, n) for w, n in heads.items()] + [("n", "", sum(words.values()))], columns=["kind", "word", "n"])

    return common.checkpoint(rows.mapInPandas(count, "kind string, word string, n bigint").groupBy("kind", "word").agg(F.sum("n").alias("n")))


def fit_vocabulary(counts: DataFrame) -> Vocabulary:
    """The common part of the counts. Words under the share COMMON are left out of what is sent, so it has a bound."""
    total = counts.filter("kind = 'n'").agg(F.sum("n")).first()[0] or 0
    words = counts.filter((F.col("kind") == "w") & (F.col("n") >= max(2, COMMON * total))).collect()
    heads = counts.filter((F.col("kind") == "h") & (F.col("n") >= max(3, COMMON * total))).collect()
    return Vocabulary({r.word: r.n for r in words}, total, frozenset(r.word for r in heads))


def rare_counts(asked_for: DataFrame, counts: DataFrame, total: int) -> DataFrame:
    """(word, rare array<string>) of the words in ``asked_for`` (_row, word): "count word" of each itself and of the rare words it may have been read from."""
    rare = counts.filter((F.col("kind") == "w") & (F.col("n") < max(2, COMMON * total))).select("word", "n")
    words = asked_for.select("word").distinct()
    found = words.join(rare, "word").select("word", F.col("word").alias("w"), "n")
    if COMMON * total > LEAST + 1:  # else no rare word can be a correction
        able = rare.filter((F.col("n") > LEAST) & F.col("word").rlike("^[a-z-]+$")).select(F.translate("word", "".join(map(chr, _CLASS)), "".join(_CLASS.values())).alias("_class"), F.col("word").alias("w"), "n")
        longest = able.agg(F.max(F.length("w"))).first()[0] or 0

        def classes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for df in batches:
                yield pd.DataFrame([(w, x) for w in df["word"] if len(w) <= longest + 4 for x in {x for _, x in confusions(w)}], columns=["word", "_class"])

        found = found.unionByName(words.filter("word rlike '^[A-Za-z0-9|]+$'").mapInPandas(classes, "word string, _class string").join(able, "_class").select("word", "w", "n"))
    return found.groupBy("word").agg(F.collect_set(F.concat_ws(" ", "n", "w")).alias("rare"))


def repair_scans(docs: DataFrame, id_col: str = "id", content_col: str = "content", vocabulary: Vocabulary | None = None) -> DataFrame:
    """(id, noise array<string>, repaired_text) for every row.

    In texts with markup the marks, code, formulas, tables and sheet rows are kept as they are, and lines stay lines. Null
    content gives no noise and null text, empty content an empty text; repeated rows and null ids are kept; other columns are
    dropped. A vocabulary that is given counts as whole: what it lacks was never seen.
    """
    counts = count_words(docs, content_col) if vocabulary is None else None
    vocabulary = vocabulary or fit_vocabulary(counts)
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(content_col).cast("string").alias("_text"))
    id_type = rows.schema["_id"].dataType.simpleString()

    def strip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = sent.value
        for df in batches:
            done = []
            for t in df["_text"]:
                plain, parts = shield(t) if t else (t, None)
                kinds, body = without_furniture(plain, v) if t else ((), t)
                done.append((list(kinds), body, parts, asked(body, v) if t else []))
            yield pd.DataFrame({"_id": df["_id"], **{c: [d[k] for d in done] for k, c in enumerate(("_kinds", "_text", "_parts", "_asked"))}})

    bodies = rows.mapInPandas(strip, f"_id {id_type}, _kinds array<string>, _text string, _parts array<string>, _asked array<string>")
    bodies = bodies.withColumn("_rare", F.lit(None).cast("array<string>"))
    if counts is not None:
        bodies = common.checkpoint(bodies.drop("_rare").withColumn("_row", F.monotonically_increasing_id()))
        wanted = bodies.select("_row", F.explode("_asked").alias("word"))
        told = wanted.join(rare_counts(wanted, counts, vocabulary.total), "word").groupBy("_row").agg(F.array_distinct(F.flatten(F.collect_list("rare"))).alias("_rare"))
        asking = bodies.filter("size(_asked) > 0").join(told, "_row", "left")
        bodies = asking.unionByName(bodies.filter("size(_asked) = 0"), allowMissingColumns=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = sent.value
        for df in batches:
            done = []
            for t, k, parts, rare in zip(df["_text"], df["_kinds"], df["_parts"], df["_rare"]):
                if t:
                    v.add_rare({w: int(n) for n, w in (x.split(" ", 1) for x in (rare if rare is not None else ()))})
                    kinds, out = repair_words(set(k), t, v, parts is None)
                    done.append((kinds, unshield(out, None if parts is None else list(parts))))
                else:
                    done.append((list(k), t))
            yield pd.DataFrame({id_col: df["_id"], "noise": [d[0] for d in done], "repaired_text": [d[1] for d in done]})

    return bodies.select("_id", "_kinds", "_text", "_parts", "_rare").mapInPandas(run, f"`{id_col}` {id_type}, noise array<string>, repaired_text string")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p4_found over kb_documents."""
    return repair_scans(common.table(spark, sf_dir, "kb_documents")).select(F.col("id").alias("document_id"), F.explode("noise").alias("noise")).distinct()


def p4_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repaired texts of kb_documents."""
    return repair_scans(common.table(spark, sf_dir, "kb_documents"))


QUERIES = {"p4_found": p4_found, "p4_repaired": p4_repaired}
SQL: dict[str, str] = {}
